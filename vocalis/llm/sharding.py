"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

A ring of 2^32 positions carries ``virtual`` points per shard.  The points
cut it into arcs; an arc belongs to the shard of the point that ends it.  A
document's key (its id) hashes to a position, thus to an arc.  Every shard
has a bounded load; what overflows a full shard continues clockwise to the
next shard with room.

Only the arcs' loads (shards x virtual rows, whatever the size of the
corpus) reach the driver.  There the overflow is decided arc by arc: in round
r the arcs, in ring order, offer what they still hold to their r-th distinct
shard clockwise, which takes it up to its bound.  The result, a cut of every
arc into segments, is joined back by the running load inside the arc.

``load='rows'``: bounds add up to the number of documents and differ by at
most one, so counts do too.  ``load='bytes'``: bounds are (1 + epsilon) times
the mean size; a document goes where its first byte falls.  Either way a new
shard takes over arcs all round the ring, and keys that overflow nowhere stay.

Cases: a null text has size 1 and the checksum of no bytes.  A null doc_id is
placed by its text.  Rows that repeat a doc_id share a position and are
ordered by id, checksum and size; equal rows are interchangeable.  Equal
texts have equal checksums.  An empty table gives an empty result.  Extra
columns are ignored.  No Python runs on the executors.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, cut_lineage, documents, running_total

SHARDS, VIRTUAL, EPSILON = 16, 64, 0.0
RING_BITS, CELL_BITS = 32, 12


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order."""
    return sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16), s)
                  for s in range(shards) for v in range(virtual))


def cut_arcs(loads: dict[int, int], points: list[tuple[int, int]],
             bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which part of each arc's running load goes where."""
    room, n = list(bounds), len(points)
    held = {arc: 0 for arc in loads}              # how much of the arc is placed
    walk = {}
    for arc in loads:
        seen: list[int] = []
        for k in range(n):
            s = points[(arc + k) % n][1]
            if s not in seen:
                seen.append(s)
                if len(seen) == len(room):
                    break
        walk[arc] = seen
    out = []
    for r in range(len(room)):
        for arc in sorted(loads):
            left = loads[arc] - held[arc]
            if left and r < len(walk[arc]):
                s = walk[arc][r]
                got = min(left, room[s])
                if got:
                    out.append((arc, held[arc], held[arc] + got, s))
                    held[arc] += got
                    room[s] -= got
    return out


def _literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of longs from one string literal."""
    text = "|".join(",".join(map(str, r)) for r in rows)
    cells = F.split(F.col("_r"), ",")
    one = spark.range(1).select(F.explode(F.split(F.lit(text), r"\|")).alias("_r")).filter("_r <> ''")
    return one.select(*[cells[i].cast("long").alias(c) for i, c in enumerate(names)])


def _cells(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """Per cell of the ring: the points in it and how many lie before it."""
    width = RING_BITS - CELL_BITS
    inside: list[list[int]] = [[] for _ in range(1 << CELL_BITS)]
    for p, _ in points:
        inside[p >> width].append(p)
    rows, before = [], 0
    for c, ps in enumerate(inside):
        rows.append(f"{c},{before},{':'.join(map(str, ps))}")
        before += len(ps)
    one = spark.range(1).select(F.explode(F.split(F.lit("|".join(rows)), r"\|")).alias("_r"))
    part = F.split("_r", ",")
    listed = F.filter(F.split(part[2], ":"), lambda x: x != "")
    return one.select(part[0].cast("long").alias("_cell"), part[1].cast("int").alias("_before"),
                      listed.cast("array<long>").alias("_points"))


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, load: str = "rows",
          epsilon: float = EPSILON) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    points = ring(shards, virtual)
    width = RING_BITS - CELL_BITS
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long").alias("_h"))
    at = rows.withColumn("_cell", F.floor(F.col("_h") / (1 << width))).join(
        F.broadcast(_cells(spark, points)), "_cell")
    # the first point at or after the key ends its arc; past the last one, the first
    arc = (F.col("_before") + F.size(F.filter("_points", lambda p: p < F.col("_h")))) % len(points)
    at = cut_lineage(at.select("doc_id", "size", "text_crc32", "_h", arc.alias("arc")))
    weight = F.lit(1).cast("long") if load == "rows" else F.col("size")
    counted = at.groupBy("arc").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()
    n_rows, whole = sum(r.n for r in counted), sum(r.w for r in counted)
    if load == "rows" and not epsilon:
        bounds = [whole // shards + (s < whole % shards) for s in range(shards)]
    else:
        bounds = [math.ceil((1 + epsilon) * whole / shards)] * shards
    segments = cut_arcs({r.arc: r.w for r in counted}, points, bounds)
    cuts = F.broadcast(_literal_rows(spark, segments, ["arc", "_from", "_to", "shard"]))
    bits = min(RING_BITS, max(0, math.ceil(math.log2(buckets_for(n_rows)))))
    at = at.withColumn("_b", F.floor(F.col("_h") / (1 << (RING_BITS - bits))))
    order = ["_h", "doc_id", "text_crc32", "size"]
    run = running_total(at, ["arc"], "_b", order, weight, "_at")
    placed = run.join(cuts, "arc").filter("_at >= _from AND _at < _to")
    slotted = running_total(placed, ["shard"], "_b", order, F.lit(1).cast("long"), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                          F.col("slot").cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (shard(documents(spark, sf_dir))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
