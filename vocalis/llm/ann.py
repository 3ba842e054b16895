"""Approximate nearest neighbours by multi-index hashing.

1. ``learn`` fits, on a bounded sample of at most ``SAMPLE_ROWS`` vectors,
   rotations that make the signs of the rotated vectors close to the vectors
   (iterative quantisation from several random starts) until there are
   ``BITS`` bits, and the Hamming radius that held ``COVER`` of the sample's
   true neighbours.
2. Every vector is coded; a block of ``BLOCK_ROWS`` codes is indexed once per
   substring of ``SUB_BITS`` bits: the rows in the order of their substring
   values, with the place of each value.
3. A query enumerates, for every table, the values within its share of the
   radius and looks each of them up.  By the pigeonhole principle two codes
   within Hamming radius r of each other are within floor(r / m) on one of m
   substrings (one less on the substrings beyond the remainder), so every code
   within r is retrieved.  Only retrieved codes are compared: those outside r
   are dropped, the others reranked by the float vectors.
4. While fewer than k codes of a block lie within r, the radius grows by a bit
   for each table and the values of that distance are looked up as well, so k
   results are always found.
5. Each block returns its k best per query; the k best of those remain.

The queries go to the blocks in packed batches (a stated query set against all
rows, in blocks).

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, as do rows without an id.  Vectors are compared with vectors of
the same length.  The query's own id is no candidate.  Rows that repeat an id
count once, the smallest vector.  Ties in distance fall to the smaller id.  Fewer
than k candidates: all are returned.  No query or no vector: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table
from .pii import sample_by_hash

BITS, SUB_BITS = 128, 16
SAMPLE_ROWS, COVER, ROUNDS = 4_000, 0.93, 30
BLOCK_ROWS, QUERY_ROWS = 8_192, 256
K = 10


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def vectors(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, dim, v (array of doubles): one usable vector per id."""
    return (table.filter(F.col("vec_id").isNotNull() & usable(F.col(vec)))
            .groupBy("vec_id").agg(F.min(F.col(vec).cast("array<double>")).alias("v"))
            .select("vec_id", F.size("v").alias("dim"), "v"))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an array<double> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Codes:
    """Sign codes: bits of (x - mean) @ planes; radius for probing."""
    mean: np.ndarray
    planes: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """uint16 substrings, (rows, BITS / SUB_BITS)."""
        bits = (x - self.mean) @ self.planes > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn(sample: np.ndarray, k: int = K, seed: int = 11) -> Codes:
    n, dim = sample.shape
    mean = sample.mean(axis=0)
    x = sample - mean
    axes = np.linalg.svd(x, full_matrices=False)[2] if n > 1 else np.eye(1, dim)
    y = x @ axes.T
    rng = np.random.default_rng(seed)
    planes = []
    while sum(p.shape[1] for p in planes) < BITS:
        turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(y @ turn).T @ y)
            turn = (u @ vt).T
        planes.append(axes.T @ turn)
    codes = Codes(mean, np.concatenate(planes, axis=1)[:, :BITS], BITS)
    some = sample[:: max(1, n // 400)]
    c, cs = codes.of(sample), codes.of(some)
    gaps = []
    for i in range(len(some)):
        d = ((sample - some[i]) ** 2).sum(axis=1)
        near = np.argsort(d, kind="stable")[1:k + 1]
        gaps.append(hamming(cs[i:i + 1], c[near])[0])
    if gaps and n > k:
        codes.radius = int(np.quantile(np.concatenate(gaps), COVER))
    return codes


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    a, b = (np.ascontiguousarray(z).view(np.uint64) for z in (a, b))
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    return out


#: all substring differences, those of fewer bits first, and how many have at most so many bits
MASKS = np.argsort(np.bitwise_count(np.arange(1 << SUB_BITS, dtype=np.uint32)), kind="stable")
UP_TO = np.concatenate([[0], np.cumsum(np.bincount(np.bitwise_count(MASKS), minlength=SUB_BITS + 1))])


class MultiIndex:
    """Substring tables over a block of codes: for each substring value the
    rows that have it, as one array of rows with the place of every value."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.rows = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.first = [np.searchsorted(c[r], np.arange((1 << SUB_BITS) + 1)).astype(np.int32)
                      for c, r in zip(codes.T, self.rows)]

    def look_up(self, t: int, value: int, lo: int, hi: int) -> np.ndarray:
        """Rows whose substring t differs from the value in lo to hi bits: each
        such value is looked up in the table."""
        probes = MASKS[UP_TO[lo]:UP_TO[min(hi, SUB_BITS) + 1]] ^ value
        first = self.first[t][probes]
        n = self.first[t][probes + 1] - first
        hit = np.flatnonzero(n)
        first, n = first[hit], n[hit]
        ends = np.cumsum(n)
        return self.rows[t][np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)]

    def search(self, q: np.ndarray, radius: int, k: int, allowed: np.ndarray | None = None):
        """Rows of the codes within the radius of one code, and how many rows
        the tables named.  While fewer than k rows are inside, the radius grows
        by a bit for each table; then the k nearest codes (and ties) are taken."""
        m, asked = len(self.rows), radius
        word, named = q.view(np.uint64), np.zeros(len(self.words), bool)
        done = [-1] * m
        while True:
            share, rest = divmod(radius, m)
            for t in range(m):
                reach = share if t <= rest else share - 1
                if reach > done[t]:
                    named[self.look_up(t, int(q[t]), done[t] + 1, reach)] = True
                    done[t] = reach
            rows = np.flatnonzero(named if allowed is None else named & allowed)
            ham = np.bitwise_count(self.words[rows] ^ word).sum(axis=1, dtype=np.int32)
            inside = ham <= radius
            if inside.sum() >= k or radius >= m * SUB_BITS:
                break
            radius = min(radius + m, m * SUB_BITS)
        if radius > asked and inside.sum() > k:
            inside = ham <= np.partition(ham, k - 1)[k - 1]
        return rows[inside], int(named.sum())


def nearest_in_block(ids, x, codes: Codes, q_ids, q, k: int):
    """The k best of a block for each query: query, vector id, distance."""
    index = MultiIndex(codes.of(x))
    out_q, out_v, out_d = [], [], []
    for q_id, v, code in zip(q_ids, q, codes.of(q)):
        rows, _ = index.search(code, codes.radius, k, ids != q_id)
        dist = np.sqrt(((x[rows] - v) ** 2).sum(axis=1))
        top = np.lexsort((ids[rows], dist))[:k]
        out_q.append(np.full(len(top), q_id, np.int64))
        out_v.append(ids[rows[top]])
        out_d.append(dist[top])
    return tuple(np.concatenate(z) if z else np.zeros(0) for z in (out_q, out_v, out_d))


def _search(codes: dict[int, Codes], k: int):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(block) and len(queries):
            dim = block["dim"][0].as_py()
            ids, x = block["vec_id"].to_numpy(), matrix(block["v"], dim)
            q_ids = np.frombuffer(b"".join(queries["ids"].to_pylist()), np.int64)
            q = np.frombuffer(b"".join(queries["vs"].to_pylist()), np.float64).reshape(-1, dim)
            for o, z in zip(out, nearest_in_block(ids, x, codes[dim], q_ids, q, k)):
                o.append(z)
        a, b, c = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)),
                         "score": pa.array(c.astype(np.float64))})
    return run


def _packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    return pa.table({"dim": pa.array([dim], pa.int32()),
                     "ids": pa.array([table["vec_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "vs": pa.array([np.ascontiguousarray(matrix(table["v"], dim)).tobytes()], pa.binary())})


def nearest(table: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``table`` (vec_id,
    embedding) that satisfy ``queries``, against all rows."""
    spark = table.sparkSession
    all_rows = cut_lineage(vectors(table))
    counts = {r.dim: r for r in all_rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q")).collect()}
    kind = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], kind)
    # vectors of another length are another index; there are as many as lengths
    for dim, r in sorted(counts.items()):
        rows = all_rows.filter(F.col("dim") == dim)
        sample = sample_by_hash(rows, F.concat(F.lit("ann:"), F.col("vec_id").cast("string")),
                                SAMPLE_ROWS)
        codes = learn(matrix(sample.orderBy("vec_id").limit(2 * SAMPLE_ROWS).toArrow()["v"]
                             if r.n > SAMPLE_ROWS else rows.orderBy("vec_id").toArrow()["v"], dim), k)
        n_blocks = -(-r.n // BLOCK_ROWS)
        blocks = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
        batches = max(1, -(-r.q // QUERY_ROWS))
        packed = (rows.filter(queries)
                  .withColumn("_p", F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int"))
                  .groupBy("_p").applyInArrow(_packed, "dim int, ids binary, vs binary"))
        asked = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        found = found.unionAll(blocks.groupBy("block").cogroup(asked.groupBy("block"))
                               .applyInArrow(_search({dim: codes}, k), kind))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                   F.col("vec_id") % 100 == 0)
