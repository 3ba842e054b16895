"""Language identification with interpolated Kneser-Ney character models.

Training counts character n-grams of order ``ORDER`` per language over all
training documents.  Words are lower-cased runs of letters, padded with
``ORDER - 1`` start marks and one end mark, so n-grams never cross words.  A
task counts its words first and its n-grams from the distinct words, so what
is shuffled is bounded by distinct n-grams per task.  Spark derives the
lower orders: the count of a shorter n-gram is the number of its distinct left
extensions (Kneser-Ney continuation counts).

The model holds every n-gram.  Up to ``BROADCAST_CELLS`` it is gathered
(``Model``): for each order the union of the languages' n-grams as sorted
64-bit hash arrays, with the interpolated log-probability of every language
beside each, and the back-off weights of the contexts likewise.  Beyond that
the orders stay tables in Spark (``Tables``): the n-grams of the corpus's
distinct words are joined with them, summed per word, and the words' scores
are joined back to the texts.  Both give the same probabilities.  Characters
never seen get a uniform floor.

A text is scored over all its letters: the cross-entropy per character is
computed once per distinct word of a batch.  The language of the lowest
cross-entropy wins; ``score`` is its calibrated probability, and ``accepted``
says whether the probability reaches the threshold that keeps
``KEEP`` of the training documents that are right.  For both, every training
document is scored by the model of the half of them that it is not in; the
model that is used has the counts of all training documents.

Cases: null text and text without a letter: ``und``, score 0, not accepted.
Ties fall to the first language by name.  Null languages are not learned
from.  No training document: every text is ``und``.  Repeated rows are scored
alike.  Extra columns are kept by ``identify``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, cut_lineage, documents, stored

ORDER = 5
HELD_OUT = 2
#: n-grams of the highest order times languages, up to which the model is gathered
BROADCAST_CELLS = 2_000_000
#: a word with more than one in so many of the (text, word) rows is joined by broadcast
HOT_WORDS = 1_000
DISCOUNT = 0.75
KEEP = 0.995
TEMPERATURES = (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4)
#: values, or bins of them, that are looked at together to find one by its rank
RANK_BINS = 4_096
START, END = "\x02", "\x03"
_LETTERS = re.compile(r"[^\W\d_]+")
#: a word's part beyond this many letters starts a new word (junk without blanks)
LONGEST = 64
KEPT_WORDS = 200_000


#: for each byte of Latin-1 the byte itself if it is a letter, else a blank
_LATIN = bytes(i if chr(i).isalpha() else 32 for i in range(256))


def letter_words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    try:
        found = text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        found = _LETTERS.findall(text)
        if not all(map(str.isalpha, found)):             # numbers like one half
            found = [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]
    if found and max(map(len, found)) > LONGEST:
        found = [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


# ---------------------------------------------------------------- training
def _count(batches):
    """Per task: the highest-order n-grams of each language with their counts,
    those of the rows apart (``aside``) on their own."""
    words: dict[tuple[str, bool], Counter] = {}
    for b in batches:
        for lang, text, aside in zip(b["lang"].to_pylist(), b["text"].to_pylist(), b["aside"].to_pylist()):
            words.setdefault((lang, aside), Counter()).update(letter_words(text))
        if sum(map(len, words.values())) > 1_000_000:      # bounded memory: hand out and go on
            yield _grams(words)
            words = {}
    yield _grams(words)


def _grams(words: dict[tuple[str, bool], Counter]):
    langs, asides, grams, counts = [], [], [], []
    for (lang, aside), c in words.items():
        got: Counter = Counter()
        for w, n in c.items():
            p = START * (ORDER - 1) + w + END
            for i in range(len(p) - ORDER + 1):
                got[p[i:i + ORDER]] += n
        langs += [lang] * len(got)
        asides += [aside] * len(got)
        grams += got.keys()
        counts += got.values()
    return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()),
                                       "aside": pa.array(asides, pa.bool_()),
                                       "gram": pa.array(grams, pa.string()),
                                       "n": pa.array(counts, pa.int64())})


def top_counts(docs: DataFrame) -> DataFrame:
    """Table (lang, gram, n, n_rest) of the highest order: the counts over all
    ``docs`` (lang, text, aside) and over those that are not ``aside``."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.select("lang", "text", "aside").mapInArrow(
        _count, "lang string, aside boolean, gram string, n long")
    return cut_lineage(counts.groupBy("lang", "gram").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("aside"), 0).otherwise(F.col("n"))).alias("n_rest")))


def ngram_counts(top: DataFrame) -> list[DataFrame]:
    """Tables (lang, gram, n) for the orders ORDER down to 1 from that of the
    highest; ``n`` is the count there and the continuation count below it."""
    tables = [top]
    for _ in range(ORDER - 1):
        tables.append(tables[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram"))
                      .agg(F.count("*").alias("n")))
    return tables


def hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of an integer matrix of code points."""
    h = np.full(len(codes), np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def _codes(grams: list[str], width: int) -> np.ndarray:
    return (np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, width)
            if grams else np.zeros((0, width), np.uint32))


@dataclass
class Model:
    """Sorted hash arrays per order: keys, log-probabilities and back-off weights."""
    langs: list[str]
    keys: list[np.ndarray]            # order 1..ORDER: sorted hashes of the n-grams
    logp: list[np.ndarray]            # float32 (n-grams, languages)
    contexts: list[np.ndarray]        # order 1..ORDER: sorted hashes of the contexts
    backoff: list[np.ndarray]
    floor: np.ndarray                 # log-probability of an unseen character
    temperature: float = 1.0
    threshold: float = 0.0

    def char_logp(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability per language of the last character of each row."""
        n, order = codes.shape
        out = np.zeros((n, len(self.langs)), np.float64)
        todo = np.arange(n)
        for k in range(order, 0, -1):
            part = codes[todo, order - k:]
            keys = self.keys[k - 1]
            if len(keys):
                h = hashes(part)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[todo[hit]] += self.logp[k - 1][at[hit]]
                todo, part = todo[~hit], part[~hit]
            if not len(todo):
                break
            ctx = self.contexts[k - 1]
            if k > 1 and len(ctx):
                h = hashes(part[:, :-1])
                at = np.minimum(np.searchsorted(ctx, h), len(ctx) - 1)
                hit = ctx[at] == h
                out[todo[hit]] += self.backoff[k - 1][at[hit]]
        if len(todo):
            out[todo] += self.floor
        return out

    def word_logp(self, words: list[str]) -> np.ndarray:
        """Sum over the characters and the end mark of each word."""
        lens = np.array([len(w) + 1 for w in words], np.int64)
        pad = START * (ORDER - 1)
        flat = np.frombuffer("".join([pad + w + END for w in words]).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lens + ORDER - 1) - (lens + ORDER - 1)
        first = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        codes = flat[first[:, None] + np.arange(ORDER)]
        return np.add.reduceat(self.char_logp(codes), np.cumsum(lens) - lens, axis=0)


def with_sums(table: DataFrame, k: int) -> DataFrame:
    """The n-grams of order ``k`` with the total and kinds of their context."""
    ctx = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
    table = table.withColumn("ctx", ctx)
    sums = table.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return table.join(sums, ["lang", "ctx"])


def build(docs: DataFrame) -> Model | Tables | None:
    """The model of all ``docs`` (lang, text)."""
    return from_counts(ngram_counts(top_counts(docs.withColumn("aside", F.lit(False))).drop("n_rest")))


def from_counts(tables: list[DataFrame]) -> Model | Tables | None:
    """The model of the counts of the orders ORDER down to 1."""
    found = {r["lang"]: r["count"] for r in tables[0].groupBy("lang").count().collect()}
    if not found:
        return None
    langs = sorted(found)
    if sum(found.values()) * len(langs) > BROADCAST_CELLS:
        return spread(tables, langs)
    return gathered(tables, langs)


def gathered(tables: list[DataFrame], langs: list[str]) -> Model:
    """The model as arrays."""
    rows = [(k, with_sums(t, k).select("lang", "gram", "n", "total", "kinds").toArrow())
            for k, t in zip(range(ORDER, 0, -1), tables)]
    no = {x: i for i, x in enumerate(langs)}
    n_langs = len(langs)
    alphabet = len(set(rows[-1][1]["gram"].to_pylist())) + 1
    floor = np.full(n_langs, -np.log(alphabet))
    keys, logp, ctxs, back = [], [], [], []
    for k, t in reversed(rows):                                 # order 1 first
        grams = t["gram"].to_pylist()
        lang = np.array([no[x] for x in t["lang"].to_pylist()])
        n, total, kinds = (t[c].to_numpy().astype(float) for c in ("n", "total", "kinds"))
        names = sorted(set(grams))
        at = {g: i for i, g in enumerate(names)}
        row = np.array([at[g] for g in grams])
        codes = _codes(names, k)
        # contexts: back-off weight D * kinds / total; 1 for a context never seen
        cname = sorted({g[:-1] for g in names})
        cat = {g: i for i, g in enumerate(cname)}
        weight = np.zeros((len(cname), n_langs))
        crow = np.array([cat[g[:-1]] for g in grams])
        weight[crow, lang] = np.log(np.minimum(1.0, DISCOUNT * kinds / total))
        own = np.zeros((len(names), n_langs))
        own[row, lang] = np.maximum(n - DISCOUNT, 0) / total
        if k == 1:
            lower = np.repeat(floor[None, :], len(names), axis=0)
            uni = np.zeros(n_langs)
            uni[lang] = weight[crow, lang]
            floor = floor + uni                                 # an unseen character backs off too
            w = np.repeat(uni[None, :], len(names), axis=0)
        else:
            lower = Model(langs, keys, logp, ctxs, back, floor).char_logp(codes[:, 1:])
            w = weight[np.array([cat[g[:-1]] for g in names])]
        p = np.log(own + np.exp(w + lower))
        h = hashes(codes)
        order = np.argsort(h)
        keys.append(h[order])
        logp.append(p[order].astype(np.float32))
        ch = hashes(_codes(cname, k - 1)) if k > 1 else np.zeros(0, np.uint64)
        order = np.argsort(ch)
        ctxs.append(ch[order])
        back.append(weight[order].astype(np.float32) if k > 1 else np.zeros((0, n_langs), np.float32))
    return Model(langs, keys, logp, ctxs, back, floor)


# ------------------------------------------------------- the model as tables
@dataclass
class Tables:
    """Per order a table of n-grams and one of contexts; arrays follow ``langs``."""
    langs: list[str]
    own: list[DataFrame]              # order 1..ORDER: (gram, own), discounted shares, 0 if absent
    back: list[DataFrame | None]      # order 1..ORDER: (ctx, weight), logs, 0 if absent; none for order 1
    floor: list[float]                # log-probability of an unseen character
    temperature: float = 1.0
    threshold: float = 0.0

    def gram_logp(self, grams: DataFrame) -> DataFrame:
        """(gram, p): log-probabilities per language of the last character of
        distinct n-grams of the highest order."""
        need = [grams]
        for _ in range(ORDER - 1):
            need.insert(0, need[0].select(F.expr("substring(gram, 2)").alias("gram")).distinct())
        low = None
        for k in range(1, ORDER + 1):
            t = need[k - 1].join(self.own[k - 1], "gram", "left")
            if low is None:
                base = F.array(*map(F.lit, self.floor))
            else:
                t = (t.withColumns({"ctx": F.substring("gram", 1, k - 1), "end": F.expr("substring(gram, 2)")})
                     .join(self.back[k - 1], "ctx", "left")
                     .join(low.withColumnsRenamed({"gram": "end", "p": "low"}), "end"))
                base = F.when(F.col("weight").isNull(), F.col("low")).otherwise(
                    F.zip_with("weight", "low", lambda w, x: w + x))
            own = lambda i: F.get(F.col("own"), i)
            low = t.withColumn("base", base).select("gram", F.transform(
                "base", lambda b, i: F.when(own(i) > 0, F.log(own(i) + F.exp(b))).otherwise(b)).alias("p"))
        return low

    def summed(self, times: Column) -> Column:
        return F.array(*[F.sum(F.col("p")[i] * times) for i in range(len(self.langs))])

    def totals(self, docs: DataFrame) -> DataFrame:
        """``docs`` with __total (log-probability per language) and __chars;
        both null for a text without a letter."""
        docs = docs.withColumn("__key", F.unhex(F.md5(F.col("text").cast("binary"))))
        pairs = docs.select("__key", "text").mapInArrow(_pairs, "key binary, word string, n long")
        words = stored(pairs.groupBy("word").agg(F.count("*").alias("rows")), "langid-words")
        padded = F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END))
        grams = words.select("word", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("word") + 1),
            lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))
        distinct = stored(grams.select("gram").distinct(), "langid-grams")
        of_word = grams.join(self.gram_logp(distinct), "gram").groupBy("word").agg(
            self.summed(F.lit(1)).alias("p"))
        of_word = stored(of_word, "langid-scores")
        limit = (words.agg(F.sum("rows")).first()[0] or 0) / HOT_WORDS
        hot = F.broadcast(of_word.join(F.broadcast(words.filter(F.col("rows") > limit).select("word")),
                                       "word", "left_semi"))
        scored = pairs.join(hot, "word").unionByName(
            pairs.join(hot.select("word"), "word", "left_anti").join(of_word, "word"))
        # a text that occurs m times has m times the sums
        times = docs.groupBy(F.col("__key").alias("key")).agg(F.count("*").alias("m"))
        sums = scored.groupBy("key").agg(
            self.summed(F.col("n")).alias("s"),
            F.sum((F.length("word") + 1) * F.col("n")).alias("c")).join(times, "key")
        m = F.col("m")
        sums = sums.select(F.col("key").alias("__key"), F.transform("s", lambda x: x / m).alias("__total"),
                           (F.col("c") / m).alias("__chars"))
        return docs.join(sums, "__key", "left").drop("__key")


def _pairs(batches):
    """The distinct words of each text with their counts."""
    for b in batches:
        keys, words, counts = [], [], []
        for key, text in zip(b["__key"], b["text"]):
            c = Counter(letter_words(text.as_py()))
            keys += [key.as_py()] * len(c)
            words += c.keys()
            counts += c.values()
            if len(keys) > 100_000:
                yield _pair_batch(keys, words, counts)
                keys, words, counts = [], [], []
        yield _pair_batch(keys, words, counts)


def _pair_batch(keys, words, counts):
    return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "word": pa.array(words, pa.string()),
                                       "n": pa.array(counts, pa.int64())})


def spread(tables: list[DataFrame], langs: list[str]) -> Tables:
    """The model as tables."""
    no = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int")
    every = F.sequence(F.lit(0), F.lit(len(langs) - 1))

    def vector(value: Column) -> Column:
        of = F.map_from_entries(F.collect_list(F.struct(no, value)))
        return F.transform(every, lambda i: F.coalesce(F.try_element_at(of, i), F.lit(0.0)))

    own, back, floor = [], [], []
    for k, t in zip(range(1, ORDER + 1), reversed(tables)):
        t = stored(with_sums(t, k), f"langid-order{k}")
        share = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        weight = F.log(F.least(F.lit(1.0), DISCOUNT * F.col("kinds") / F.col("total")))
        of_ctx = t.select("lang", "ctx", weight.alias("w")).distinct()
        if k == 1:
            alphabet = t.select("gram").distinct().count() + 1
            of_lang = {r["lang"]: r["w"] for r in of_ctx.collect()}
            floor = [float(-np.log(alphabet)) + of_lang[x] for x in langs]
            back.append(None)
        else:
            back.append(stored(of_ctx.groupBy("ctx").agg(vector(F.col("w")).alias("weight")), f"langid-back{k}"))
        own.append(stored(t.groupBy("gram").agg(vector(share).alias("own")), f"langid-own{k}"))
    return Tables(langs, own, back, floor)


class Scorer:
    """Cross-entropies of texts; words are scored once and kept, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.row, self.table = model, {}, np.zeros((0, len(model.langs)))

    def totals(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability per language, characters) of each text of an array."""
        parts = [self._totals(some) for some in by_size(texts)]
        if not parts:
            return np.zeros((0, len(self.model.langs))), np.zeros(0)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.row) > KEPT_WORDS:
            self.row, self.table = {}, self.table[:0]
        cut = [letter_words(t) for t in texts]
        coded = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.row]
        base = len(self.row)
        self.row.update(zip(new, range(base, base + len(new))))
        parts = [self.table[:base]]
        for i in range(0, len(new), 20_000):
            parts.append(self.model.word_logp(new[i:i + 20_000]))
        self.table = np.concatenate(parts)
        total = np.zeros((len(texts), len(self.model.langs)))
        chars = np.zeros(len(texts))
        found = np.fromiter(map(len, cut), np.int64, len(cut))
        some = np.flatnonzero(found)
        if len(some):
            code = coded.indices.to_numpy()
            first = (np.cumsum(found) - found)[some]
            at = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
            total[some] = np.add.reduceat(self.table[at[code]], first, axis=0)
            chars[some] = np.add.reduceat(pc.utf8_length(coded.dictionary).to_numpy()[code] + 1, first)
        return total, chars


def probabilities(total: np.ndarray, chars: np.ndarray, temperature: float) -> np.ndarray:
    """Softmax of the length-normalised log-probabilities; short texts stay unsure."""
    x = total / np.maximum(chars, 1)[:, None] * (temperature * np.sqrt(np.minimum(chars, 400)))[:, None]
    x -= x.max(axis=1, keepdims=True)
    p = np.exp(x)
    return p / p.sum(axis=1, keepdims=True)


def _totals_of(model: Model):
    def run(batches):
        s = Scorer(model)
        for b in batches:
            total, chars = s.totals(b["text"])
            yield pa.RecordBatch.from_pydict({
                "lang": b["lang"], "chars": pa.array(chars),
                "total": pa.array(total.tolist(), pa.list_(pa.float64()))})
    return run


def totals_of(model: Model | Tables, docs: DataFrame) -> DataFrame:
    """(truth, chars, total) of the ``docs`` (lang, text) with a letter and a
    language that the model knows; ``truth`` is its number."""
    if isinstance(model, Tables):
        rows = model.totals(docs).select("lang", F.col("__chars").alias("chars"), F.col("__total").alias("total"))
    else:
        rows = docs.select("lang", "text").mapInArrow(
            _totals_of(model), "lang string, chars double, total array<double>")
    truth = (F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")) - 1).cast("int")
    return rows.select(truth.alias("truth"), "chars", "total").filter("truth >= 0 AND chars > 0")


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array(batch["total"].to_pylist(), np.float64).reshape(len(batch), -1),
            batch["chars"].to_numpy(zero_copy_only=False), batch["truth"].to_numpy(zero_copy_only=False))


def _losses(batches):
    """Summed loss of each temperature and the rows."""
    for b in batches:
        total, chars, truth = _arrays(b)
        pick = np.arange(len(truth))
        loss = [float(-np.log(probabilities(total, chars, t)[pick, truth] + 1e-9).sum()) for t in TEMPERATURES]
        yield pa.RecordBatch.from_pydict({"t": pa.array(TEMPERATURES, pa.float64()),
                                          "loss": pa.array(loss, pa.float64()),
                                          "n": pa.array([len(truth)] * len(loss), pa.int64())})


def _right(temperature: float):
    def run(batches):
        """The probability of the answers that are right."""
        for b in batches:
            total, chars, truth = _arrays(b)
            p = probabilities(total, chars, temperature)
            yield pa.RecordBatch.from_pydict({"p": pa.array(p.max(axis=1)[p.argmax(axis=1) == truth], pa.float64())})
    return run


def nth_smallest(values: DataFrame, n: int) -> float:
    """The value of rank ``n`` (from 0) of the column ``p``, exactly: the values
    are counted in bins, and those of the bin that holds it again, until they
    are few or equal."""
    while True:
        count, low, high = values.agg(F.count("p"), F.min("p"), F.max("p")).first()
        if low == high:
            return low
        if count <= RANK_BINS:
            return sorted(r["p"] for r in values.collect())[n]
        bin_ = F.least(F.floor((F.col("p") - F.lit(low)) / F.lit(high - low) * RANK_BINS), F.lit(RANK_BINS - 1))
        for r in values.groupBy(bin_.alias("b")).count().orderBy("b").collect():
            if n < r["count"]:
                values = values.filter(bin_ == r["b"])
                break
            n -= r["count"]


def calibration(scored: list[tuple[Model | Tables, DataFrame]]) -> tuple[float, float]:
    """Temperature and acceptance threshold from all documents (lang, text) of
    ``scored``, each frame beside the model that scores it."""
    frames = [cut_lineage(totals_of(model, docs)) for model, docs in scored]
    if not frames:
        return 1.0, 0.0
    sums = reduce(DataFrame.unionAll, (x.mapInArrow(_losses, "t double, loss double, n long") for x in frames))
    loss = {r["t"]: r["loss"] / r["n"] for r in
            sums.groupBy("t").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect() if r["n"]}
    if not loss:
        return 1.0, 0.0
    temperature = min(TEMPERATURES, key=loss.get)
    right = cut_lineage(reduce(DataFrame.unionAll, (x.mapInArrow(_right(temperature), "p double") for x in frames)))
    found = right.count()
    return temperature, float(nth_smallest(right, int((1 - KEEP) * found))) if found else 0.0


def predict(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, accepted> of whole texts."""
    shared = model

    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = Scorer(shared)
        for texts in batches:
            total, chars = s.totals(texts)
            yield answers(total, chars, shared.langs, shared.temperature, shared.threshold)

    return run(text)


def answers(total: np.ndarray, chars: np.ndarray, langs: list[str], temperature: float,
            threshold: float) -> pa.StructArray:
    p = probabilities(total, chars, temperature)
    best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(p), int)
    top = np.where(chars > 0, p[np.arange(len(p)), best], 0.0)
    names = [langs[b] if c else "und" for b, c in zip(best, chars)]
    return pa.StructArray.from_arrays(
        [pa.array(names, pa.string()), pa.array(top, pa.float64()),
         pa.array((top >= threshold) & (chars > 0))],
        ["lang_pred", "score", "accepted"])


def predict_totals(model: Tables) -> Column:
    """The same struct of the columns __total and __chars."""
    langs, temperature, threshold = model.langs, model.temperature, model.threshold

    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for total, chars in batches:
            x = np.array(total.to_pylist(), np.float64).reshape(-1, len(langs))
            yield answers(x, chars.to_numpy(zero_copy_only=False), langs, temperature, threshold)

    return run(F.coalesce("__total", F.array(*[F.lit(0.0)] * len(langs))),
               F.coalesce("__chars", F.lit(0.0)))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4


def train(docs: DataFrame) -> Model | Tables | None:
    """Model of all documents of the training folds; temperature and threshold
    from all of them too, each scored by the model of the other half."""
    rest = docs.filter(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "lang", "text")
    h = F.md5(F.concat(F.lit("lid:"), F.col("doc_id").cast("string")))
    aside = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 2 == 1
    rest = rest.withColumn("aside", F.coalesce(aside, F.lit(False)))
    top = top_counts(rest)
    scored = []
    for half, n in ((True, F.col("n_rest")), (False, F.col("n") - F.col("n_rest"))):
        other = from_counts(ngram_counts(top.select("lang", "gram", n.alias("n")).filter("n > 0")))
        if other is not None:
            scored.append((other, rest.filter((F.col("aside") == half) & F.col("lang").isNotNull())
                           .select("lang", "text")))
    model = from_counts(ngram_counts(top.drop("n_rest")))
    if model is not None:
        model.temperature, model.threshold = calibration(scored)
    return model


def identify(docs: DataFrame, model: Model | Tables | None) -> DataFrame:
    """``docs`` with lang_pred, score and accepted."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0),
                                 "accepted": F.lit(False)})
    if isinstance(model, Tables):
        out = model.totals(docs).withColumn("__lid", predict_totals(model)).drop("__total", "__chars")
    else:
        out = docs.withColumn("__lid", predict(F.col("text"), model))
    return out.withColumns({c: F.col("__lid")[c] for c in ("lang_pred", "score", "accepted")}).drop("__lid")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
                                "text"), model).drop("text")
