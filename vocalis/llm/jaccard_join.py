"""N-gram Jaccard join with set-relation skipping.

Sets: the distinct ``width``-word shingles of a text.  Two sets link when
``100 * |x & y| >= threshold * |x | y|``.

1. Shingles are counted over the corpus in hash buckets (``groups``).  Each
   document learns how frequent its shingles are.  A set can only link with a
   different set, or be a copy of one, if at least the threshold's share of its
   shingles occurs elsewhere; the others are done.  The rest are kept sorted
   by (frequency class, hash), rare first.
2. Equal sets become one node.  A node's links are found through the prefix of
   its sorted set (prefix filter).
3. *Answers from a similar set.*  In every inverted list a leader, the node of
   the smallest document, is compared first.  Each node is verified against
   the leader it shares most lists with.  A node's answer against other nodes
   then follows incrementally from its leader's: nodes already joined through
   leaders need no comparison, and with Jaccard distances to the same leader
   d(x), d(y), |d(x) - d(y)| > 1 - t rules a pair out.
4. *Skipping by position.*  The remaining lists are cut into blocks of equal
   (set size, position).  A pair of blocks whose sizes or remaining lengths
   cannot reach the overlap is skipped as a whole; only then are pairs of
   different components listed and verified.  A long list is dealt out in
   pairs of parts.
5. Components of the links (alternating stars).

All links between different components are verified on the full sets (64-bit
shingle hashes).

Cases: a null text or one without words has an empty set and links with
nothing.  A text of fewer than ``width`` words is one shingle.  Rows that
repeat a doc_id are one document with several texts: they share a component.
A null doc_id has a null component and links nothing.  Extra columns are
ignored by ``link`` and kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, documents, stored
from .components import components
from .groups import BLOBS, bucket_bits, group_count, sizes
from .hashing import buffers, lower_table, mix, pack32, unpack32, windows, word_hashes, words

WIDTH, THRESHOLD = 5, 75
#: nodes of an inverted list that one task lists pairs of; longer lists are dealt in parts
LIST_PART = 2_000
#: ids (8 bytes each) of dropped documents up to which they are broadcast
BROADCAST_IDS = 3_000_000


# --------------------------------------------------------------- shingle sets
class _Sets:
    """Distinct shingles of a group's texts: token, owner; sorted by owner, token."""

    def __init__(self, table: pa.Table, width: int):
        data, offsets = buffers(table["raw"])
        s, e, first = words(data, offsets)
        h = word_hashes(data, s, e, lower_table())
        n = np.diff(first)
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        owner = np.repeat(np.arange(len(n), dtype=np.int32), count)
        before = np.cumsum(count) - count
        at = np.arange(len(owner)) - before[owner] + first[:-1][owner]
        token = np.zeros(len(owner), np.uint64)
        full = n[owner] >= width
        if full.any():
            token[full] = windows(h, width)[at[full]]
        for k in range(1, width):                 # whole short texts, by their length
            some = n[owner] == k
            if some.any():
                token[some] = mix(windows(h, k)[at[some]] + np.uint64(k))
        del h, at
        by = np.lexsort((token, owner))
        token, owner = token[by], owner[by]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.token, self.owner = token[fresh], owner[fresh]
        self.size = np.bincount(self.owner, minlength=len(n))


def _counted(token: np.ndarray, bits: int) -> np.ndarray:
    """What a shingle is counted by: its bucket and 32 more bits of its hash.
    Two shingles that share them are counted together, which can only make
    them look more frequent: the order stays one order, and nothing that could
    link is left out."""
    return token >> np.uint64(32 - bits)


def _send(width: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, n = np.unique(_counted(_Sets(table, width).token, bits), return_counts=True)
        names, first = np.unique(t >> np.uint64(32), return_index=True)
        blobs = [pack32(t[a:b] & np.uint64(0xFFFFFFFF)) + np.minimum(n[a:b], 255).astype(np.uint8).tobytes()
                 for a, b in zip(first, np.append(first[1:], len(t)))]
        return pa.table({"bucket": pa.array(names.astype(np.int64), pa.int32()),
                         "g": pa.array(np.full(len(names), key[0].as_py()), pa.int32()),
                         "blob": pa.array(blobs, pa.binary())})
    return run


def _frequency_classes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each blob: per hash 0 if it occurs in one text, else 1 + log2 of how many."""
    hs, ns = [], []
    for b in table["blob"].to_pylist():
        n = len(b) // 5
        hs.append(unpack32(b[:4 * n]))
        ns.append(np.frombuffer(b, np.uint8, n, 4 * n))
    h = np.concatenate(hs)
    names, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, np.concatenate(ns).astype(float))
    cls = np.floor(np.log2(total)).astype(np.uint8) + (total > 1)
    parts = np.split(cls[back].astype(np.uint8), np.cumsum([len(x) for x in hs])[:-1])
    return pa.table({"bucket": table["bucket"], "g": table["g"],
                     "blob": pa.array([p.tobytes() for p in parts], pa.binary())})


def _prune(width: int, threshold: int, bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _Sets(table, width)
        names, back = np.unique(_counted(sets.token, bits), return_inverse=True)
        order = np.argsort(answers["bucket"].to_numpy(), kind="stable")
        blobs = answers["blob"].to_pylist()
        cls = np.frombuffer(b"".join([blobs[i] for i in order]), np.uint8)
        assert len(cls) == len(names)
        mine = cls[back]
        shared = np.bincount(sets.owner, mine > 0, minlength=len(sets.size))
        alive = (100 * shared >= threshold * sets.size) & (sets.size > 0)
        ends = np.cumsum(sets.size)
        rare_first = np.lexsort((sets.token, mine, sets.owner))
        token = sets.token[rare_first].view(np.int64)
        sig, toks, seen = [], [], set()
        for k, (n, end) in enumerate(zip(sets.size.tolist(), ends.tolist())):
            if not alive[k]:
                sig.append(None)
                toks.append(None)
                continue
            t = token[end - n:end]
            s = int.from_bytes(hashlib.blake2b(t.tobytes(), digest_size=8).digest(), "big", signed=True)
            sig.append(s)
            toks.append(None if s in seen else t.tobytes())
            seen.add(s)
        return pa.table({"doc_id": table["doc_id"], "n": pa.array(sets.size, pa.int64()),
                         "sig": pa.array(sig, pa.int64()), "toks": pa.array(toks, pa.binary())})
    return run


def shingle_sets(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n (set size), sig (names the set; null: it can link with
    nothing), toks (its hashes, rare first; at least once per sig)."""
    _, n_bytes = sizes(docs)
    n_groups, bits = group_count(n_bytes), bucket_bits(n_bytes)
    raw = F.col("text").cast("binary")
    rows = docs.select(F.pmod(F.xxhash64("doc_id", raw), F.lit(n_groups)).cast("int").alias("g"),
                       "doc_id", raw.alias("raw"))
    sent = rows.groupBy("g").applyInArrow(_send(width, bits), BLOBS)
    classes = sent.groupBy("bucket").applyInArrow(_frequency_classes, BLOBS)
    return (rows.groupBy("g").cogroup(classes.groupBy("g"))
            .applyInArrow(_prune(width, threshold, bits), "doc_id long, n long, sig long, toks binary"))


# ------------------------------------------------------------------ postings
def prefix_length(n, threshold: int):
    """Tokens of a set of size n of which a partner must share one."""
    return n - (threshold * n + 99) // 100 + 1


def _postings(threshold: int):
    def run(batches):
        for b in batches:
            toks, sig, doc, n, pos = [], [], [], [], []
            for s, d, k, raw in zip(b["sig"].to_pylist(), b["doc"].to_pylist(), b["n"].to_pylist(),
                                    b["toks"].to_pylist()):
                p = prefix_length(k, threshold)
                toks.append(np.frombuffer(raw, np.int64, p))
                pos.append(np.arange(p, dtype=np.int32))
                sig.append(np.full(p, s))
                doc.append(np.full(p, d))
                n.append(np.full(p, k))
            for lo in range(0, len(toks), 2000):
                cut = slice(lo, lo + 2000)
                yield pa.RecordBatch.from_pydict({
                    "tok": pa.array(np.concatenate(toks[cut])), "sig": pa.array(np.concatenate(sig[cut])),
                    "doc": pa.array(np.concatenate(doc[cut])), "n": pa.array(np.concatenate(n[cut])),
                    "pos": pa.array(np.concatenate(pos[cut]))})
    return run


def _overlaps(batches):
    """|a & b| of two token lists per row."""
    for b in batches:
        out = []
        for x, y in zip(b["ta"].to_pylist(), b["tb"].to_pylist()):
            out.append(len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64),
                                          assume_unique=True)))
        yield pa.RecordBatch.from_pydict({"a": b["a"], "b": b["b"], "na": b["na"], "nb": b["nb"],
                                          "both": pa.array(out, pa.int64())})


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, both, either: sizes of intersection and union."""
    one = lambda x: nodes.select(F.col("sig").alias(x), F.col("n").alias("n" + x),
                                 F.col("toks").alias("t" + x))
    # the second side holds the more frequent node of a pair (a leader): its sets join last
    joined = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "nb", "ta", "tb")
    counted = joined.mapInArrow(_overlaps, "a long, b long, na long, nb long, both long")
    return counted.select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"))


# ---------------------------------------------------- remaining pairs, by blocks
def block_pairs(n: np.ndarray, pos: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Blocks of equal (size, position) of one inverted list and the pairs of
    blocks (first <= second) that can reach the overlap.  The bound holds
    where the token is the first one both sets share."""
    key = np.stack([n, pos], axis=1)
    blocks, of = np.unique(key, axis=0, return_inverse=True)
    of = of.ravel()
    bn, bp = blocks[:, 0].astype(np.int64), blocks[:, 1].astype(np.int64)
    found_a, found_b = [], []
    for i in range(len(bn)):
        # |x & y| >= t / (1 + t) * (|x| + |y|)
        need = -(-threshold * (bn[i] + bn[i:]) // (100 + threshold))
        reach = 1 + np.minimum(bn[i] - bp[i] - 1, bn[i:] - bp[i:] - 1)
        size_ok = 100 * np.minimum(bn[i], bn[i:]) >= threshold * np.maximum(bn[i], bn[i:])
        j = np.flatnonzero((reach >= need) & size_ok) + i
        found_a.append(np.full(len(j), i))
        found_b.append(j)
    return of, np.concatenate(found_a), np.concatenate(found_b)


def _list_pairs(threshold: int):
    slack = 1 - threshold / 100 + 1e-9

    def one(sig, n, pos, comp, lead, dist, part, cell):
        of, a, b = block_pairs(n, pos, threshold)
        members = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of))
        out = []
        for i, j in zip(a.tolist(), b.tolist()):
            x = members[(ends[i - 1] if i else 0):ends[i]]
            y = members[(ends[j - 1] if j else 0):ends[j]]
            for lo in range(0, len(x), 500):
                p, q = np.meshgrid(x[lo:lo + 500], y, indexing="ij")
                p, q = p.ravel(), q.ravel()
                ok = (comp[p] != comp[q]) & ((sig[p] < sig[q]) | (i != j))
                if cell[0] != cell[1]:
                    ok &= part[p] != part[q]
                ok &= ~((lead[p] == lead[q]) & (np.abs(dist[p] - dist[q]) > slack))
                p, q = p[ok], q[ok]
                if len(p):
                    out.append(np.stack([np.minimum(sig[p], sig[q]), np.maximum(sig[p], sig[q])]))
        return out

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in table.column_names}
        order = np.lexsort((col["p2"], col["p1"], col["tok"]))
        col = {c: v[order] for c, v in col.items()}
        change = np.flatnonzero((np.diff(col["tok"]) != 0) | (np.diff(col["p1"]) != 0)
                                | (np.diff(col["p2"]) != 0)) + 1
        found = []
        for lo, hi in zip(np.append(0, change), np.append(change, len(col["tok"]))):
            c = {k: v[lo:hi] for k, v in col.items()}
            found += one(c["sig"], c["n"], c["pos"], c["comp"], c["lead"], c["dist"], c["part"],
                         (c["p1"][0], c["p2"][0]))
        pairs = (np.unique(np.concatenate(found, axis=1), axis=1) if found
                 else np.zeros((2, 0), np.int64))
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})
    return run


# ------------------------------------------------------------------- the join
def link(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    rows = stored(shingle_sets(docs, width, threshold), "sets")
    alive = rows.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
    # one node per distinct set; a copy's hashes may have come with a null id
    sets = rows.filter("toks IS NOT NULL").groupBy("sig").agg(
        F.first("toks").alias("toks"), F.first("n").alias("n"))
    nodes = stored(alive.groupBy("sig").agg(F.min("doc_id").alias("doc")).join(sets, "sig"), "nodes")
    post = nodes.mapInArrow(_postings(threshold), "tok long, sig long, doc long, n long, pos int")
    heads = post.groupBy("tok").agg(F.min(F.struct("doc", "sig", "n")).alias("head"),
                                    F.count("*").alias("len")).filter("len > 1")
    post = stored(post.join(heads, "tok").select(
        "tok", "sig", "n", "pos", "len", F.col("head.sig").alias("lead"), F.col("head.n").alias("ln")),
        "postings")
    near = (100 * F.least("n", "ln") >= threshold * F.greatest("n", "ln")) & (F.col("sig") != F.col("lead"))
    votes = post.filter(near).groupBy("sig", "lead").agg(F.count("*").alias("v"))
    best = votes.groupBy("sig").agg(F.max(F.struct("v", "lead")).alias("m"))
    first = cut_lineage(verify(best.select(F.col("sig").alias("a"), F.col("m.lead").alias("b")), nodes))
    linked = 100 * F.col("both") >= threshold * F.col("either")
    edges = first.filter(linked).select("a", "b")
    # rows of one doc_id with different texts are one document
    same = (alive.select("doc_id", "sig").distinct().groupBy("doc_id")
            .agg(F.min("sig").alias("a"), F.max("sig").alias("b"), F.count("*").alias("k"))
            .filter("k > 1").select("doc_id", "a"))
    same = same.join(alive.select("doc_id", F.col("sig").alias("b")).distinct(), "doc_id").select("a", "b")
    edges = cut_lineage(edges.unionAll(same))
    comp = components(edges).withColumnRenamed("node", "sig")
    known = first.select(F.col("a").alias("sig"), F.col("b").alias("l"),
                         (1 - F.col("both") / F.col("either")).alias("d"))
    state = cut_lineage(
        nodes.select("sig").join(comp, "sig", "left").join(known, "sig", "left")
        .select("sig", F.coalesce("component", "sig").alias("comp"),
                F.coalesce("l", "sig").alias("lead"), F.coalesce("d", F.lit(0.0)).alias("dist")))
    lists = post.drop("lead", "ln").join(state, "sig")
    mixed = lists.groupBy("tok").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2")
    lists = lists.join(mixed.select("tok"), "tok", "left_semi")
    parts = F.ceil(F.col("len") / LIST_PART).cast("int")
    lists = lists.withColumn("part", F.pmod(F.xxhash64("sig"), parts).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    lists = lists.select("tok", "sig", "n", "pos", "comp", "lead", "dist", "part",
                         F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"))
    n_lists = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = (lists.withColumn("cell", F.pmod(F.xxhash64("tok", "p1", "p2"), F.lit(4 * n_lists)))
             .groupBy("cell").applyInArrow(_list_pairs(threshold), "a long, b long").distinct())
    second = verify(pairs, nodes).filter(linked).select("a", "b")
    final = components(edges.unionAll(second)).withColumnRenamed("node", "sig")
    named = nodes.select("sig", "doc").join(final, "sig", "left").withColumn(
        "component", F.coalesce("component", "sig"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_set = named.join(smallest, "component").select("sig", "component_id")
    return (rows.drop("toks").join(of_set, "sig", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
                    .alias("component_id")))


def keep_first(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the smallest document of each component; rows with a null id stay."""
    found = link(docs.select("doc_id", "text"), width, threshold)
    out = cut_lineage(found.filter("doc_id <> component_id").select("doc_id").distinct())
    # ids only, counted: up to the bound no text is shuffled for them
    if out.count() <= BROADCAST_IDS:
        out = F.broadcast(out)
    return docs.join(out, "doc_id", "left_anti")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir).select("doc_id", "text"))
