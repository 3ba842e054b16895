"""Substring dedup: repeated windows of words, as maximal removal intervals.

1. Documents are put into groups by ranges of doc_id, so a smaller group
   number means smaller ids.
2. Each group hashes every window of ``width`` consecutive words of a document
   (Rabin-Karp) and sends the distinct hashes to buckets of hash space.
3. A bucket finds, for each hash, the smallest group that has it, and answers
   every later group with the hashes it must remove.  That first group keeps
   the windows of its smallest document and removes the others by itself.
4. Each group hashes again, marks the removed windows and merges them into
   maximal intervals of words.

A hash occurs once per group in a bucket, so a passage that a third of all
documents share costs no more than one entry per group.  Hashes have 64 bits;
texts with equal hashes are taken as equal.

Cases: a null or empty text has no words and nothing to remove.  A text with
fewer than ``width`` words keeps them all.  Within one document repeats stay.
Rows that repeat a doc_id do not remove each other's words.  A null doc_id
counts as larger than all others, and such rows do not remove each other's
words.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .groups import BLOBS, bucket_bits, group_count, sizes, to_buckets
from .hashing import buffers, pack, unpack, windows, word_hashes, words

WIDTH = 50
#: quantiles of the ids that the driver asks for, at most
MAX_RANGES = 4_096


def by_id_range(docs: DataFrame, n_groups: int) -> tuple[DataFrame, int]:
    """(g, doc_id, raw) and the number of ranges: groups are ranges of doc_id;
    null ids go to groups of their own behind all others, dealt by text."""
    n_cuts = min(n_groups, MAX_RANGES)
    cuts: list[float] = []
    if n_cuts > 1:
        steps = [i / n_cuts for i in range(1, n_cuts)]
        cuts = sorted(set(docs.approxQuantile("doc_id", steps, 0.25 / n_cuts)))
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("raw"),
                        F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("_k"))
    if cuts:
        keyed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_k",
                           outputCol="_g").transform(keyed)
    else:
        keyed = keyed.withColumn("_g", F.lit(0.0))
    # a corpus of more groups than quantiles are asked for: each range is cut
    # into steps of equal width
    parts = -(-n_groups // n_cuts)
    n_ranges = (len(cuts) + 1) * parts
    g = F.col("_g").cast("int")
    if parts > 1:
        ends = docs.agg(F.min("doc_id").cast("double").alias("lo"), F.max("doc_id").cast("double").alias("hi")).first()
        edges = F.split(F.lit(",".join(map(repr, [ends.lo or 0.0, *cuts, (ends.hi or 0.0) + 1]))), ",").cast("array<double>")
        lo, hi = F.get(edges, g), F.get(edges, g + 1)
        step = F.floor((F.col("_k") - lo) / F.greatest(hi - lo, F.lit(1e-9)) * parts).cast("int")
        g = g * parts + F.greatest(F.lit(0), F.least(step, F.lit(parts - 1)))
    behind = F.lit(n_ranges) + F.pmod(F.xxhash64("raw"), F.lit(n_groups)).cast("int")
    return keyed.select(F.when(F.col("doc_id").isNull(), behind).otherwise(g).alias("g"),
                        "doc_id", "raw"), n_ranges


class _Group:
    """The windows of a group's documents: hash, document and first word."""

    def __init__(self, table: pa.Table, width: int):
        self.data, self.offsets = buffers(table["raw"])
        s, e, first = words(self.data, self.offsets)
        self.first = first
        self.n_words = np.diff(first)
        h = windows(word_hashes(self.data, s, e), width)
        doc = np.repeat(np.arange(len(self.n_words)), np.maximum(self.n_words - width + 1, 0))
        before = np.cumsum(np.maximum(self.n_words - width + 1, 0))
        before = before - np.maximum(self.n_words - width + 1, 0)
        self.at = np.arange(len(doc)) - before[doc] + first[:-1][doc]
        self.doc = doc
        self.hash = h[self.at]
        # order of the ids; rows of one id are equal, null ids count as one
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if isinstance(
            table["doc_id"], pa.Array) else table["doc_id"].combine_chunks().to_numpy(
                zero_copy_only=False)
        self.null = np.array(table["doc_id"].is_null().to_numpy(zero_copy_only=False)
                             if isinstance(table["doc_id"], pa.Array)
                             else table["doc_id"].combine_chunks().is_null().to_numpy(
                                 zero_copy_only=False), bool)
        filled = np.where(self.null, 0, ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.order = np.unique(filled, return_inverse=True)[1] if len(ids) else filled


def _send(width: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return to_buckets(key[0].as_py(), np.unique(_Group(table, width).hash), bits)
    return run


def _answer(n_ranges: int):
    """Groups from ``n_ranges`` on hold null ids, which do not precede each other."""
    def run(table: pa.Table) -> pa.Table:
        gs = table["g"].to_numpy()
        order = np.argsort(gs, kind="stable")
        parts = [unpack(table["blob"][int(k)].as_py()) for k in order]
        group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        by_hash = np.argsort(h, kind="stable")               # groups ascend within a hash
        sh, sg = h[by_hash], group[by_hash]
        fresh = np.ones(len(sh), bool)
        fresh[1:] = sh[1:] != sh[:-1]
        lead = sg[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(sh) else sg
        later = (sg != lead) & (gs[order][lead] < n_ranges)
        out_g, out_b = [], []
        late_g, late_h = sg[later], sh[later]
        pick = np.argsort(late_g, kind="stable")             # hashes stay ascending
        late_g, late_h = late_g[pick], late_h[pick]
        names, first = np.unique(late_g, return_index=True)
        for k, a, b in zip(names, first, np.append(first[1:], len(late_g))):
            out_g.append(int(gs[order][k]))
            out_b.append(pack(late_h[a:b]))
        return pa.table({"g": pa.array(out_g, pa.int32()), "blob": pa.array(out_b, pa.binary())})
    return run


def _remove(width: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        grp = _Group(table, width)
        blobs = [unpack(b) for b in answers["blob"].to_pylist()]
        drop = np.sort(np.concatenate(blobs)) if blobs else np.zeros(0, np.uint64)
        gone = np.zeros(len(grp.hash), bool)
        if len(drop):
            at = np.minimum(np.searchsorted(drop, grp.hash), len(drop) - 1)
            gone = drop[at] == grp.hash
        if len(grp.hash):                                     # copies inside the group
            rank = grp.order[grp.doc]
            by = np.lexsort((rank, grp.hash))
            sh = grp.hash[by]
            fresh = np.ones(len(sh), bool)
            fresh[1:] = sh[1:] != sh[:-1]
            least = rank[by][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            gone[by] |= (rank[by] > least) & ~grp.null[grp.doc[by]]
        # removed windows -> covered words -> maximal intervals
        edge = np.zeros(int(grp.first[-1]) + 1, np.int32)
        np.add.at(edge, grp.at[gone], 1)
        np.add.at(edge, grp.at[gone] + width, -1)
        covered = np.cumsum(edge)[:-1] > 0
        kept, n_removed, spans = [], [], []
        raw = grp.data.tobytes()
        for k, (a, b) in enumerate(zip(grp.first, grp.first[1:])):
            ws = raw[grp.offsets[k]:grp.offsets[k + 1]].split()
            c = covered[a:b]
            n = int(c.sum())
            if n:
                d = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(d[::2], d[1::2])])
                ws = [w for w, x in zip(ws, c.tolist()) if not x]
            else:
                spans.append([])
            n_removed.append(n)
            kept.append(b" ".join(ws))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(grp.n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "removed": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})
    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of word intervals), kept (UTF-8 bytes)."""
    _, n_bytes = sizes(docs)
    n_groups, bits = group_count(n_bytes), bucket_bits(n_bytes)
    rows, n_ranges = by_id_range(docs, n_groups)
    sent = rows.groupBy("g").applyInArrow(_send(width, bits), BLOBS)
    answers = sent.groupBy("bucket").applyInArrow(_answer(n_ranges), "g int, blob binary")
    return (rows.groupBy("g").cogroup(answers.groupBy("g"))
            .applyInArrow(_remove(width), "doc_id long, n_words long, n_removed long, "
                          "removed array<struct<first:long,end:long>>, kept binary"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
