"""Personal data: broad candidate generators, boosted trees, calibrated thresholds.

``base_spans`` are the four fixed detectors (email, ip, card, phone); every
match that passes its check is always a span.

``candidates`` come from looser generators per kind (defanged and spelled-out
addresses, digit groups with odd separators, numbers without a country
prefix); they overlap freely.  Each candidate gets features of its format and
of its context.  Gradient-boosted trees (MLlib), one model per kind, learn
from a bounded sample of documents: the values that the fixed detectors
confirm there are rewritten into the loose forms in their own context
(``rewritten``), with and without a cue, whole and broken.  The label is how an
example was made: a whole value in a form that tells its kind, or after a cue,
is personal data; a broken value, one grown to a digit, or one without anything
that tells its kind is not.  Other runs of the sample that the generators find
are negatives, but for those that ``doubtful`` can't rule out: they may be what
is to be found.  The trees see all features of format and context.  On
documents that they have not seen a threshold per kind is calibrated: the
lowest score from which on at least ``PRECISION`` of the examples are personal
data; a kind without enough evidence keeps a
threshold above 1, so nothing is added.  The trees
are written out as column expressions and run inside the row, so the
documents are never shuffled.

Main path: DataFrame functions and MLlib only, no Python on the executors.
Offsets count code points; the end is exclusive.

Cases: a null text is empty and has no spans.  Repeated rows and null ids are
scored row by row.  Ties: spans sort by start, then kind as listed, then end.
Of added spans that overlap, the first by start, then the longer stays.  Very
long texts are folded in runs of ``RUN`` matches.  An empty table gives an
empty result (no model is fitted).  Extra columns are kept by ``detect`` and
ignored by the query; columns of its own replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, documents, stored

KINDS = ("email", "ip", "card", "phone")
RUN = 256
#: characters in a chunk of a text, and chunks in a block
CHUNK, BLOCK = 4096, 256
#: expected number of documents in the fitting sample, chosen by a hash of the text
SAMPLE_DOCS = 6000
#: candidates of a kind in the fitting sample, at most
SAMPLE_CANDIDATES = 4000
PRECISION, MIN_CONFIRMED = 0.97, 20
TREES, DEPTH = 8, 4
CONTEXT = 24

# Each pattern matches what the plain one does.  Possessive quantifiers and the
# look-behind only avoid starts and retreats that cannot succeed, so a long run
# costs linear time.  \G allows the start right after the previous match.
_EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
          r"(?:\.[A-Za-z0-9-]++)++")
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"        # runs of under 14 digits never pass
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: cheap tests of a text: without these nothing of the kind can match
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?:\+|\b00)?\(?[0-9]{1,4}+\)?(?:[\x20.()/-]{1,2}+[0-9]{2,4}+){2,5}+",
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Does the digit string pass the Luhn check?"""
    back = F.reverse(c)
    n = F.length(back)

    def value(i):
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)
    return (n > 0) & (total % 10 == 0)


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(m))
    return n.between(10, 15)


def _check(kind: str):
    return lambda s: _passes(kind, s.value)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>>: all matches with their code point offsets.

    The pieces between the matches and the matches themselves add up to the
    offsets.  Runs of ``RUN`` matches are folded on their own and then moved,
    so a text with many matches is not copied for each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                       lambda g, v: F.struct(g.alias("g"), v.alias("v")))

    def fold(part):
        zero = F.struct(F.lit(0).alias("p"),
                        F.array().cast("array<struct<start:int,end:int,value:string>>").alias("o"))
        return F.aggregate(part, zero, lambda a, x: F.struct(
            (a.p + x.g + F.length(x.v)).alias("p"),
            F.concat(a.o, F.array(F.struct((a.p + x.g).alias("start"),
                                           (a.p + x.g + F.length(x.v)).alias("end"),
                                           x.v.alias("value")))).alias("o")))

    # an array of one names the pairs, so that the text is cut once and not for each run
    runs = F.flatten(F.transform(F.array(pairs), lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")),
        lambda k: fold(F.slice(x, k * RUN + 1, F.lit(RUN))))))
    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("o"))
    offsets = lambda rs: F.aggregate(rs, zero, lambda a, r: F.struct(
        (a.p + r.p).alias("p"), F.concat(a.o, F.array(a.p)).alias("o"))).o
    moved = lambda rs: F.flatten(F.zip_with(rs, offsets(rs), lambda r, o: F.transform(
        r.o, lambda s: F.struct((s.start + o).alias("start"), (s.end + o).alias("end"),
                                s.value.alias("value")))))
    # a one-element transform names the runs, so that they are folded once
    named = F.flatten(F.transform(F.array(runs), moved))
    return F.when(text.rlike(pattern), named).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>"))


_SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def _tagged(kind: str, matches: Column) -> Column:
    no = KINDS.index(kind)
    return F.transform(matches, lambda s: F.struct(
        s.start.alias("start"), F.lit(no).alias("kind_no"), s.end.alias("end"),
        F.lit(kind).alias("kind"), s.value.alias("value")))


def base_spans(text: Column) -> Column:
    """The spans of the four fixed detectors, by start and kind."""
    parts = []
    for kind, pattern in zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE)):
        tagged = _tagged(kind, F.filter(located(text, pattern), _check(kind)))
        if _NEEDS[kind]:
            tagged = F.when(F.contains(text, F.lit(_NEEDS[kind])), tagged).otherwise(
                F.array().cast(_SPANS))
        parts.append(tagged)
    return F.array_sort(F.concat(*parts))


# ------------------------------------------------------------ candidates
#: words that announce a kind, in the text just before a candidate
CUES = {"email": r"(?i)\b(e-?mail|mail|contact|write)", "ip": r"(?i)\b(ip|host|server|addr)",
        "card": r"(?i)\b(card|visa|credit|account)", "phone": r"(?i)\b(phone|tel|call|fax|mobile)"}
CUE_WORD = {"email": "mail", "ip": "host", "card": "card", "phone": "phone"}

FEATURES = ("length", "n_digits", "digit_share", "n_groups", "first_group", "last_group", "n_seps",
            "n_kinds_of_sep", "n_dots", "n_spaces", "parens", "plus", "at", "cue_before",
            "alnum_before", "alnum_after", "digit_after", "line_start", "sound", "spelled", "zeros")


_SPELLED = r"[\[(](at|dot|\.)[\])]"


def _sound(kind: str, v: Column) -> Column:
    """Does a loose value keep what its kind demands?"""
    if kind == "email":
        return ~v.rlike(r"\x20\.|\.\x20")
    if kind == "ip":
        return F.regexp_replace(v, r"[\x20()\[\]]", "").rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    n = F.length(_digits(v))
    return n.between(13, 19) & luhn(_digits(v)) if kind == "card" else n.between(10, 15)


def doubtful(x: Column, before: Column, after: Column) -> Column:
    """May a run of the sample be personal data?  It stands alone, keeps what
    its kind demands, and has a form or a cue that tells its kind.  Such a run
    is no example of either class."""
    v, of_kind = x.value, lambda f: reduce(lambda a, k: F.when(x.kind == k, f(k)).otherwise(a), KINDS, F.lit(False))
    form = {"email": F.lit(True), "ip": v.rlike(_SPELLED), "card": F.length(_digits(v)) >= 14,
            "phone": v.rlike(r"^00|[+(]")}
    return (~before.rlike("[A-Za-z0-9]$") & ~after.rlike("[A-Za-z0-9]")
            & of_kind(lambda k: _sound(k, v) & (form[k] | before.rlike(CUES[k]))))


def rewritten(b: str, text: Column) -> Column:
    """array<struct<kind,value,start,end,context,label>>: the base spans of a
    text in loose forms, each without a cue, with one before it, and grown to a
    digit; labelled by how they were made."""
    def made(whole, tells, *values):
        return [F.struct(v.alias("v"), F.lit(whole).alias("whole"), F.lit(tells).alias("tells")) for v in values]

    def forms(s):
        v, d = s.value, _digits(s.value)
        name, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        dots = lambda x: F.replace(host, F.lit("."), F.lit(x))
        fours = lambda x, y: F.regexp_replace(x, "(.{4})(?=.)", f"$1{y}")
        checked = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(
            F.substring(d, 1, n - 1), i.cast("string"))), luhn)[0]
        bumped = F.concat(F.substring(d, F.lit(1), F.length(d) - 1),
                          ((F.substring(d, -1, 1).cast("int") + 1) % 10).cast("string"))
        plain = F.regexp_replace(v, r"^\+", "")
        # phones of several lengths, so that the length of the confirmed ones tells nothing
        threes = lambda n, y: F.regexp_replace(F.substring(F.concat(d, d), 1, n), "(.{3})(?=..)", f"$1{y}")
        return (F.when(s.kind == "email", F.array(
                    *made(True, True, F.concat(name, F.lit(" (at) "), host), F.concat(name, F.lit(" (at) "), dots(" (dot) ")),
                          F.concat(name, F.lit("[at]"), dots("[dot]")), F.concat(name, F.lit(" @ "), host)),
                    *made(False, True, F.concat(name, F.lit(" @ "), dots(". ")), F.concat(name, F.lit(" (at) "), dots(". ")))))
                .when(s.kind == "ip", F.array(
                    *made(True, True, F.replace(v, F.lit("."), F.lit("[.]")), F.replace(v, F.lit("."), F.lit("(.)"))),
                    *made(True, False, F.replace(v, F.lit("."), F.lit(" . "))),
                    *made(False, True, F.replace(F.regexp_replace(v, "[0-9]+$", "999"), F.lit("."), F.lit("[.]")),
                          F.replace(F.regexp_replace(v, "^[0-9]+", "391"), F.lit("."), F.lit("(.)")))))
                .when(s.kind == "card", F.array(
                    *made(True, True, fours(d, "."), fours(d, "/"), fours(d, "--"), fours(checked(14), ".")),
                    *made(True, False, checked(13), fours(checked(13), " ")),
                    *made(False, True, fours(bumped, "."), fours(bumped, " "), bumped)))
                .otherwise(F.array(
                    *made(True, True, F.concat(F.lit("00"), plain), *[F.concat(F.lit("00"), threes(n - 2, x))
                                                                      for n, x in ((10, " "), (12, "-"), (14, " "))],
                          *[F.concat(F.lit("00"), F.substring(d, 1, 2), F.lit(" "), fours(F.substring(F.concat(d, d), 3, n - 4), " "))
                            for n in (12, 14)],
                          *[F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), threes(n - 3, x))
                            for n, x in ((10, "-"), (12, " "))]),
                    F.struct(plain.alias("v"), F.lit(True).alias("whole"), F.contains(v, F.lit("(")).alias("tells")),
                    *made(True, False, *[threes(n, x) for n, x in ((10, "-"), (11, " "), (12, " "), (13, "-"), (14, " "))],
                          *[fours(F.substring(F.concat(d, d), 1, n), " ") for n in (12, 14)]),
                    *made(False, True, fours(F.substring(F.concat(d, d), 1, 16), " "),
                          fours(F.substring(F.concat(d, d), 1, 18), "."),
                          threes(8, " ")))))

    def placed(s, x, cue, end=""):
        v = x.v
        left = F.substring(text, F.greatest(F.lit(1), s.start - CONTEXT + 1), F.least(F.lit(CONTEXT), s.start))
        told = lambda of: reduce(lambda a, k: F.when(s.kind == k, of(k)).otherwise(a), KINDS, left)
        if cue:
            left = told(lambda k: F.concat(left, F.lit(f" {CUE_WORD[k]} {end}")))
        else:
            left = told(lambda k: F.concat(F.regexp_replace(left, CUES[k], "of"), F.lit(end)))
        return F.struct(s.kind.alias("kind"), v.alias("value"), F.length(left).alias("start"),
                        (F.length(left) + F.length(v)).alias("end"),
                        F.concat(left, v, F.substring(text, s.end + 1, F.lit(CONTEXT))).alias("context"),
                        (x.whole & (x.tells | F.lit(cue)) & F.lit(not end)).alias("label"))

    return F.flatten(F.transform(b, lambda s: F.flatten(F.transform(forms(s), lambda x: F.array(
        placed(s, x, False), placed(s, x, True), placed(s, x, True, "7"))))))


_PLACED = _SPANS[:-2] + ",before:string,after:string,clear:boolean>>"


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def in_place(found: Column, base: Column, text: Column) -> Column:
    """Candidates with the ``CONTEXT`` characters before them, the one after
    them, and whether they are clear of the base spans.

    A cut at an offset walks the text up to it, so the text is cut once into
    chunks, and the base spans are listed by the chunks they reach into (by
    blocks of ``BLOCK`` chunks first): a candidate looks at its chunks only.
    """
    chunks = chunked(text)
    reaches = lambda s, lo, hi: (s.start < hi) & (s.end > lo)

    def by_chunk(n: Column) -> Column:
        wide = BLOCK * CHUNK
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
                             lambda j: F.filter(base, lambda s: reaches(s, j * wide, (j + 1) * wide)))
        return F.flatten(F.transform(blocks, lambda spans, j: F.transform(
            F.sequence(j * BLOCK, F.least(n, (j + 1) * BLOCK) - 1),
            lambda k: F.filter(spans, lambda s: reaches(s, k * CHUNK, (k + 1) * CHUNK)))))

    def one(c: Column, t: Column) -> Column:
        at = lambda i: F.floor(i / CHUNK).cast("int")
        first, last, end = at(c.start), at(c.end - 1), at(c.end)
        left = F.concat(F.coalesce(F.get(t.chunks, first - 1), F.lit("")),
                        F.left(F.get(t.chunks, first), c.start - first * CHUNK))
        near = F.slice(t.spans, first + 1, last - first + 1)
        return F.struct(*[c[x].alias(x) for x in ("start", "kind_no", "end", "kind", "value")],
                        F.right(left, F.lit(CONTEXT)).alias("before"),
                        F.coalesce(F.substring(F.get(t.chunks, end), c.end - end * CHUNK + 1, F.lit(1)),
                                   F.lit("")).alias("after"),
                        (~F.exists(near, lambda spans: F.exists(spans, lambda s: reaches(s, c.start, c.end))))
                        .alias("clear"))

    # arrays of one name the chunks and the lists, so that they are made once
    named = F.transform(F.array(chunks), lambda x: F.struct(x.alias("chunks"), by_chunk(F.size(x)).alias("spans")))
    return F.when(F.size(found) > 0, F.flatten(F.transform(named, lambda t: F.transform(found, lambda c: one(c, t))))) \
        .otherwise(F.array().cast(_PLACED))


def features(c: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of one candidate as doubles, in the order of FEATURES."""
    v = c.value
    n, nd = F.length(v), F.length(_digits(v))
    seps = F.regexp_replace(v, "[A-Za-z0-9]", "")
    groups = F.filter(F.split(v, "[^0-9]+"), lambda x: x != "")
    size_at = lambda i: F.coalesce(F.length(F.get(groups, i)), F.lit(0))
    count = lambda ch: F.length(v) - F.length(F.replace(v, F.lit(ch), F.lit("")))
    of_kind = lambda f: reduce(lambda a, k: F.when(c.kind == k, f(k)).otherwise(a), KINDS, F.lit(False))
    cue = of_kind(lambda k: before.rlike(CUES[k]))
    cols = [n, nd, nd / n, F.size(groups), size_at(F.lit(0)), size_at(F.size(groups) - 1),
            F.length(seps), F.size(F.array_distinct(F.split(seps, ""))), count("."), count(" "),
            count("("), count("+"), count("@"), cue,
            before.rlike("[A-Za-z0-9]$"), after.rlike("[A-Za-z0-9]"), after.rlike("[0-9]"),
            (c.start == 0) | before.rlike("\n$"), of_kind(lambda k: _sound(k, v)),
            v.rlike(_SPELLED), v.startswith("00")]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in cols]


def candidates(text: Column) -> Column:
    """array<struct<start,kind_no,end,kind,value>> of all generators."""
    parts = [_tagged(k, located(text, LOOSE[k])) for k in KINDS]
    return F.when(text.rlike(r"[0-9@]|\(at\)|\[at\]"), F.concat(*parts)).otherwise(
        F.array().cast(_SPANS))


class Model:
    """Per kind: the boosted trees as nested tuples, and the threshold."""

    def __init__(self, trees: dict[str, list], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, kind: str, f: list[Column]) -> Column:
        def walk(node):
            if len(node) == 1:
                return F.lit(node[0])
            i, cut, low, high = node
            return F.when(f[i] <= F.lit(cut), walk(low)).otherwise(walk(high))

        margin = reduce(lambda a, b: a + b, [F.lit(w) * walk(t) for w, t in self.trees[kind]])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return (node.prediction(),)
    s = node.split()
    return (s.featureIndex(), s.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def sample_by_hash(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """Rows whose hash falls under a share that makes about ``rows`` of them."""
    n = df.count()
    share = min(1.0, rows / max(1, n))
    return df.filter(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
                     < F.lit(int(share * (1 << 32))))


def fit(docs: DataFrame) -> Model | None:
    """Trees and thresholds from a bounded sample; None without candidates."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    text = F.col("text")
    key = F.coalesce(F.col("doc_id").cast("string"), text, F.lit(""))
    some = sample_by_hash(docs.select("doc_id", "text"), F.concat(F.lit("pii:"), key), SAMPLE_DOCS)
    held = F.substring(F.md5(text), 1, 1).isin("0", "1", "2", "3", "4").alias("held")
    one = (some.filter(F.col("text").isNotNull())
           .select("text", held, candidates(text).alias("c"), base_spans(text).alias("b"))
           .filter(F.size("c") > 0))
    x = F.col("x")
    hashed = lambda t: F.md5(F.concat(x.value, F.substring(t, 1, 64)))
    found = (one.select(F.substring("text", 1, 64).alias("t"), "held",
                        in_place(F.col("c"), F.col("b"), text).alias("c"))
             .select("t", "held", F.explode("c").alias("x")).filter(x.clear & ~doubtful(x, x.before, x.after))
             .select(F.lit(0).alias("made"), "held", x.kind.alias("kind"), F.lit(0.0).alias("label"),
                     F.array(*features(x, x.before, x.after)).alias("f"), hashed(F.col("t")).alias("h")))
    made = (one.select("held", F.explode(rewritten("b", text)).alias("x"))
            .select(F.lit(1).alias("made"), "held", x.kind.alias("kind"), x.label.cast("double").alias("label"),
                    F.array(*features(
                        x, F.substring(x.context, F.greatest(F.lit(1), x.start - CONTEXT + 1), F.least(F.lit(CONTEXT), x.start)),
                        F.substring(x.context, x.end + 1, F.lit(1)))).alias("f"), hashed(x.context).alias("h")))
    rows = stored(found.unionByName(made), "pii-candidates")
    kept = []
    for kind in KINDS:
        for origin in (0, 1):
            kept.append(rows.filter((F.col("kind") == kind) & (F.col("made") == origin))
                        .orderBy("h").limit(SAMPLE_CANDIDATES // 2))
    rows = cut_lineage(reduce(DataFrame.unionByName, kept))
    held = F.col("held")
    counted = {r.kind: r for r in rows.groupBy("kind").agg(
        F.sum(F.when(~held, F.col("label"))).alias("pos"),
        F.sum(F.when(~held, 1 - F.col("label"))).alias("neg")).collect()}
    trees, thresholds = {}, {}
    for kind, r in counted.items():
        if (r.pos or 0) < MIN_CONFIRMED or not r.neg:
            continue                       # one class only: nothing to tell apart
        train = rows.filter((F.col("kind") == kind) & ~held).select(
            array_to_vector("f").alias("features"), "label")
        gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3, cacheNodeIds=False)
        model = gbt.fit(train.coalesce(2))
        java = model._java_obj
        trees[kind] = [(float(w), _tree(t.rootNode()))
                       for w, t in zip(model.treeWeights, list(java.trees()))]
        thresholds[kind] = 1.01
    if not trees:
        return None
    model = Model(trees, thresholds)
    f = [F.col("f")[i] for i in range(len(FEATURES))]
    for kind in trees:
        scored = (rows.filter((F.col("kind") == kind) & held)
                  .select((F.floor(model.score(kind, f) * 1000) / 1000).alias("s"), "label")
                  .groupBy("s").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
                  .orderBy(F.desc("s")).collect())
        pos = n = 0
        for r in scored:
            pos, n = pos + r.pos, n + r.n
            if pos >= MIN_CONFIRMED / 2 and pos / n >= PRECISION:
                thresholds[kind] = r.s
    return model


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with base (array of spans) and spans (base and added ones)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("base", base_spans(text))
    if model is None or all(t > 1 for t in model.thresholds.values()):
        return out.withColumn("spans", F.col("base"))
    out = out.withColumn("_c", candidates(text))
    # the features of a candidate are an array of its own, made once
    known = F.transform(F.filter(in_place(F.col("_c"), F.col("base"), text), lambda c: c.clear), lambda c: F.struct(
        c.start.alias("start"), (-c.end).alias("e"),
        F.struct(*[c[x].alias(x) for x in ("start", "kind_no", "end", "kind", "value")]).alias("c"),
        F.array(*features(c, c.before, c.after)).alias("f")))

    def selected(x):
        f = [F.get(x.f, F.lit(i)) for i in range(len(FEATURES))]
        ok = F.lit(False)
        for kind, t in model.thresholds.items():
            if t <= 1:
                ok = F.when(x.c.kind == kind, model.score(kind, f) >= F.lit(t)).otherwise(ok)
        return ok

    longest_first = F.array_sort(F.transform(F.filter(known, selected), lambda x: F.struct(x.start, x.e, x.c)))
    out = out.withColumn("_n", F.when(F.size("_c") > 0, longest_first).otherwise(
        F.array().cast(f"array<struct<start:int,e:int,c:{_SPANS[6:-1]}>>")))
    # from the left, the longest first; in runs, so that no long list is copied for each span
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(_SPANS).alias("o"))
    of_run = lambda end, run: F.aggregate(run, F.struct(end.alias("end"), F.array().cast(_SPANS).alias("o")),
                                          lambda a, x: F.when(x.start >= a.end, F.struct(
                                              x.c.end.alias("end"), F.concat(a.o, F.array(x.c)).alias("o"))).otherwise(a))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / RUN).cast("int")),
                       lambda k: F.slice("_n", k * RUN + 1, F.lit(RUN)))
    greedy = F.aggregate(runs, zero, lambda a, run: F.get(F.transform(F.array(of_run(a.end, run)), lambda r: F.struct(
        r.end.alias("end"), F.concat(a.o, r.o).alias("o"))), F.lit(0))).o
    out = out.withColumn("spans", F.when(F.size("_n") > 0, F.array_sort(F.concat("base", greedy)))
                         .otherwise(F.col("base")))
    return out.drop("_c", "_n")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by [KIND]; spans that
    overlap are replaced as one, under the kind of the first."""
    columns = docs.columns
    own = {c: f"__own_{c}" for c in ("base", "spans") if c in columns}
    found = detect(docs.withColumnsRenamed(own), model)
    zero = lambda p: F.struct(p.alias("p"), F.array().cast("array<string>").alias("o"))
    text = F.col("text")

    def piece(t, a, b):
        """Characters a to b of the text in chunks ``t``."""
        first = F.floor(a / CHUNK).cast("int")
        whole = F.array_join(F.slice(t, first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
        return F.substring(whole, a - first * CHUNK + 1, b - a)

    def of_run(t, p, run):
        return F.aggregate(run, zero(p), lambda a, s: F.when(s.start >= a.p, F.struct(
            s.end.alias("p"), F.concat(a.o, F.array(piece(t, a.p, s.start), F.concat(
                F.lit("["), F.upper(s.kind), F.lit("]")))).alias("o")))
            .otherwise(F.struct(F.greatest(a.p, s.end).alias("p"), a.o.alias("o"))))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("spans") - 1) / RUN).cast("int")),
                       lambda k: F.slice("spans", k * RUN + 1, F.lit(RUN)))
    steps = lambda t: F.aggregate(runs, zero(F.lit(0)), lambda a, run: F.get(F.transform(
        F.array(of_run(t, a.p, run)), lambda r: F.struct(
            r.p.alias("p"), F.concat(a.o, F.array(F.array_join(r.o, ""))).alias("o"))), F.lit(0)))
    cleaned = F.transform(F.transform(F.array(chunked(text)), steps), lambda a: F.concat(
        F.array_join(a.o, ""), F.substring(text, a.p + 1, F.length(text))))[0]
    out = found.withColumn("text", F.when(F.size("spans") > 0, cleaned).otherwise(text))
    return out.drop("base", "spans").withColumnsRenamed({v: k for k, v in own.items()}).select(*columns)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = detect(docs, fit(docs))
    n = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS],
                        F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))
