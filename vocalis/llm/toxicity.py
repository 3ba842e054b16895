"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to letters
(``FOLD``), and leaves words of letters between single spaces.  A lexicon
entry is a whole word or a word stem (``stem*``); per word the longest entry
counts.  Hits inside an exception phrase do not count.  The weighted hits of a
text, normalised by its length, become a probability.

``fit`` learns entries, exceptions and the probability from a bounded sample
of labelled documents (about ``SAMPLE_ROWS``, chosen by a hash of the id);
the documents of ``HELD_OUT`` are never read.  Entries come from one part of
the sample, the probability from the other.  Near copies would let one text
speak many times, so documents that share their smallest long-word hash count
once in the fit.

Cases: a null or empty text has no hits and gets the score of a text without
any.  Repeated rows are scored alike.  Conflicting labels of a doc_id: the
higher one counts; null labels are ignored.  Without labelled documents of
both classes the lexicon is empty and every score is the prior of the labels
(0 without labels).  Extra columns are kept by ``score``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, documents, read_table
from .pii import sample_by_hash

HELD_OUT = 2
SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6, 7, 8)
MIN_HITS, MIN_RATIO, MIN_G2 = 8, 1.5, 40.0
MAX_ENTRIES, MAX_EXCEPTIONS = 2_000, 1_000
#: one document adds at most so many occurrences of a word to the statistics
PER_DOCUMENT = 3
THRESHOLD = 0.3

# Look-alikes of Latin letters: Cyrillic, Greek, full-width forms come by NFKC
# of single characters below; digits and signs that stand for letters.
_CYRILLIC = dict(zip("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВН", "aeopcyxijsdhkmtbnaeopcyxijskmtbn"))
_GREEK = dict(zip("αεορτυχικνΑΕΟΡΤΥΧΙΚΝΒΜΗΖ", "aeoptuxiknaeoptyxiknbmhz"))
_DIGITS = dict(zip("0134578", "oieastb"))
FOLD = str.maketrans({**_CYRILLIC, **_GREEK, **_DIGITS,
                      **{chr(0xFF21 + i): chr(97 + i) for i in range(26)},
                      **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_SIGN = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def folded_words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    if "@" in low or "$" in low:
        low = _SIGN.sub(lambda m: "a" if m.group() == "@" else "s", low)
    return _WORD.findall(low.translate(FOLD))


@dataclass
class Lexicon:
    """entries: word or stem* -> weight; coef: intercept and feature weights."""
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)

    def automaton(self):
        """Entries with twice the letters they fix, a whole word before the stem
        it consists of; exceptions with 0."""
        import ahocorasick
        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            key = " " + e[:-1] if e.endswith("*") else f" {e} "
            a.add_word(key, (2 * len(e) - e.endswith("*") * 3, w, len(key)))
        for p in self.exceptions:
            a.add_word(f" {p} ", (0, 0.0, len(p) + 2))
        if len(a):
            a.make_automaton()
        return a


def weighted_hits(words: list[str], automaton) -> tuple[float, int, list[int]]:
    """Sum of weights, number of words and the word offsets that were hit."""
    n = len(words)
    if not n or not len(automaton):
        return 0.0, n, []
    text = " " + " ".join(words) + " "
    best: dict[int, tuple[int, float]] = {}
    excepted: list[tuple[int, int]] = []
    for end, (size, w, length) in automaton.iter(text):
        start = end - length + 1
        if not size:
            excepted.append((start, end))
        elif best.get(start, (0, 0.0))[0] < size:
            best[start] = (size, w)
    if excepted and best:
        inside = set()
        for a, b in excepted:
            inside.update(range(a, b))
        best = {s: v for s, v in best.items() if s not in inside}
    return sum(v[1] for v in best.values()), n, list(best)


def length_normalised(hits, n) -> np.ndarray:
    """Features of the probability: hits on a log scale, per root length, per length."""
    hits, n = np.asarray(hits, float), np.asarray(n, float)
    return np.stack([np.ones_like(hits), np.log1p(hits), hits / np.sqrt(n + 20.0),
                     np.log1p(100.0 * hits / (n + 20.0))], axis=1)


def _crc_rest(doc_id) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4


def _signature(words: list[str]) -> str:
    long = {w for w in words if len(w) >= 9} or set(words)
    return min((hashlib.md5(w.encode()).hexdigest() for w in long), default="")


def _signed(batches):
    for b in batches:
        joined, sigs = [], []
        for t in b["text"]:
            words = folded_words(t.as_py())
            joined.append(" ".join(words))
            sigs.append(_signature(words))
        yield pa.RecordBatch.from_pydict({
            "doc_id": b["doc_id"], "toxic": b["toxic"], "part": b["part"],
            "words": pa.array(joined, pa.string()), "sig": pa.array(sigs, pa.string())})


def _texts(b):
    return zip(b["words"].to_pylist(), b["toxic"].to_pylist())


def _two_counts(rows: dict[str, list[int]]):
    return pa.RecordBatch.from_pydict({
        "entry": pa.array(list(rows), pa.string()),
        "clean": pa.array([v[0] for v in rows.values()], pa.int64()),
        "toxic": pa.array([v[1] for v in rows.values()], pa.int64())})


def _word_stats(batches):
    """Capped occurrences of every word and stem in toxic and clean documents."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b in batches:
        for words, toxic in _texts(b):
            c = Counter(words.split())
            counts[int(toxic)].update({w: min(k, PER_DOCUMENT) for w, k in c.items()})
    rows: dict[str, list[int]] = {}
    for cls in (0, 1):
        for w, k in counts[cls].items():
            for e in [w, *(w[:n] + "*" for n in STEMS if len(w) > n)]:
                rows.setdefault(e, [0, 0])[cls] += k
    rows[""] = [sum(counts[0].values()), sum(counts[1].values())]
    yield _two_counts(rows)


def _phrase_stats(lexicon: Lexicon):
    def run(batches):
        a, counts = lexicon.automaton(), {}
        for b in batches:
            for joined, toxic in _texts(b):
                words = joined.split()
                hit = set(weighted_hits(words, a)[2])
                at, seen = 0, set()
                for i, w in enumerate(words):
                    if at in hit:
                        seen.add(w)
                        if i:
                            seen.add(f"{words[i - 1]} {w}")
                        if i + 1 < len(words):
                            seen.add(f"{w} {words[i + 1]}")
                    at += len(w) + 1
                for p in seen:
                    counts.setdefault(p, [0, 0])[int(toxic)] += 1
        yield _two_counts(counts)
    return run


def _feature_rows(lexicon: Lexicon):
    def run(batches):
        a = lexicon.automaton()
        for b in batches:
            h = [weighted_hits(w.split(), a)[:2] for w in b["words"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "hits": pa.array([x[0] for x in h], pa.float64()),
                "n": pa.array([x[1] for x in h], pa.int64()), "toxic": b["toxic"]})
    return run


def g2(a: float, b: float, na: float, nb: float) -> float:
    """Log-likelihood ratio of a in na against b in nb."""
    p = (a + b) / (na + nb)
    term = lambda k, n: k * math.log(k / (n * p)) if k else 0.0
    return 2 * (term(a, na) + term(b, nb))


def choose_entries(stats: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Entries by significance; a stem counts only what accepted longer
    entries of it leave, and nothing under an accepted stem is added."""
    ratio = lambda c, t: (math.log((t + 0.5) / (toxic + 1))
                          - math.log((c + 0.5) / (clean + 1)))
    left = sorted(stats, key=lambda s: (-g2(s[2], s[1], toxic, clean), s[0].endswith("*"),
                                        -len(s[0]), s[0]))
    chosen: dict[str, tuple[float, int, int]] = {}
    for entry, c, t in left:
        stem = entry.rstrip("*")
        if any(e.endswith("*") and stem.startswith(e[:-1]) for e in chosen):
            continue
        if entry.endswith("*"):
            for e, (_, ec, et) in chosen.items():
                if e.startswith(stem):
                    c, t = c - ec, t - et
        if t >= MIN_HITS and ratio(c, t) >= MIN_RATIO and g2(t, max(c, 0), toxic, clean) >= MIN_G2:
            chosen[entry] = (ratio(max(c, 0), t), max(c, 0), t)
            if len(chosen) >= MAX_ENTRIES:
                break
    return {e: v[0] for e, v in chosen.items()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method; columns of x are features, the first the constant."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (),
        sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    known = (labels.filter((_crc_rest(F.col("doc_id")) != HELD_OUT) & F.col("toxic").isNotNull()
                           & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    ids = sample_by_hash(known, F.concat(F.lit("tox:"), F.col("doc_id").cast("string")), sample_rows)
    rest = _crc_rest(F.col("doc_id"))
    sample = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
              .withColumn("part", F.when(rest == 3, "rate").otherwise("words")))
    sample = cut_lineage(sample.mapInArrow(
        _signed, "doc_id long, toxic int, part string, words string, sig string"))
    once = sample.groupBy("sig", "toxic").agg(F.min("doc_id").alias("doc_id"))
    train = (sample.filter("part = 'words'").drop("sig")
             .join(F.broadcast(once.select("doc_id").distinct()), "doc_id", "left_semi"))
    kind = "entry string, clean long, toxic long"
    stats = (train.mapInArrow(_word_stats, kind).groupBy("entry")
             .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    whole = stats.filter("entry = ''").first()
    lexicon = Lexicon(exceptions=[" ".join(folded_words(p)) for p in exceptions])
    if whole is not None and whole.toxic and whole.clean:
        hopeful = stats.filter((F.col("entry") != "") & (F.col("toxic") >= MIN_HITS) & (
            F.col("toxic") / whole.toxic > F.lit(math.exp(MIN_RATIO) / 2) * F.col("clean") / whole.clean))
        top = hopeful.orderBy(F.desc("toxic"), "entry").limit(20 * MAX_ENTRIES).collect()
        lexicon.entries = choose_entries([(r.entry, r.clean, r.toxic) for r in top],
                                         whole.clean, whole.toxic)
    if lexicon.entries:
        phrases = (train.mapInArrow(_phrase_stats(lexicon), kind).groupBy("entry")
                   .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
                   .filter((F.col("clean") >= 5) & (
                       F.col("toxic") / whole.toxic < F.col("clean") / whole.clean))
                   .orderBy(F.desc("clean"), "entry").limit(MAX_EXCEPTIONS).collect())
        lexicon.exceptions += [r.entry for r in phrases]
    rows = sample.filter("part = 'rate'").mapInArrow(
        _feature_rows(lexicon), "hits double, n long, toxic int").toPandas()
    if len(rows) and rows.toxic.nunique() == 2:
        lexicon.coef = logistic(length_normalised(rows.hits, rows.n), rows.toxic.to_numpy(float))
    elif len(rows):
        prior = (rows.toxic.sum() + 0.5) / (len(rows) + 1)
        lexicon.coef = (math.log(prior / (1 - prior)), 0.0, 0.0, 0.0)
    return lexicon


def score(text: Column, lexicon: Lexicon) -> Column:
    """Probability that the text is toxic, for whole texts of any length."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = lexicon.automaton()
        for texts in batches:
            h = [weighted_hits(folded_words(t.as_py()), a)[:2] for t in texts]
            x = length_normalised([v[0] for v in h], [v[1] for v in h])
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(lexicon.coef), -30, 30))),
                           pa.float64())

    return run(text)


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored at ``threshold`` or above."""
    return (docs.withColumn("__toxicity", score(F.col("text"), lexicon))
            .filter(F.col("__toxicity") < threshold).drop("__toxicity"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = fit(docs, read_table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", (_crc_rest(F.col("doc_id")) == HELD_OUT).alias("held_out"),
                        score(F.col("text"), lexicon).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
