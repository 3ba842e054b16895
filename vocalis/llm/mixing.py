"""Mixing sources to target weights with a low-discrepancy schedule.

1. Every source gets a target number of words: the share of the whole that
   its weight asks for, at most ``cap`` times its own words; what a capped
   source leaves is shared again by weight (``targets``).
2. The documents of a source, in a hashed order, form an endless stream of
   words cut into blocks of ``block_words`` (``pieces``).
3. ``slots`` lists the schedule: slot i takes the golden-ratio point
   ``i * a mod m`` (m slots, a next to m / phi and coprime to m), and the
   cumulative block counts of the sources map the point to a source.  The
   points are a permutation, so each source gets exactly the blocks its
   target needs, spread evenly over the schedule.
4. The k-th slot of a source is joined with the k-th block of its stream.
   ``mixed_documents`` gives the rows in the order of the slots, each at the
   slot that takes its first words, so a reader of the result meets the
   sources in their proportions all along.

Cases: a null text or a text without words has size 0 and nothing is taken
from it; ``mixed_documents`` keeps such rows once, after the last slot.  A null source is a source of its own, last in the order.  A
repeated doc_id is another row with words of its own.  Ties in the hashed
order fall to doc_id and size.  An empty table gives an empty mix, a corpus
without words targets of 0.  Extra columns are ignored.  Reruns agree: every
step depends on the rows alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, buckets_for, cut_lineage, documents, running_total, word_count

SHARE, WEIGHTS, CAP, BLOCK_WORDS, SEED = 1.5, (5, 2, 1), 2, 4096, "mix-1"
#: the source table is broadcast up to this many counted rows
BROADCAST_SOURCES = 20_000
#: order-preserving buckets come from the first hex digits of the hash
HASH_SPACE = 1 << 24


def targets(sources: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> source, source_size, source_no, weight, target.

    ``lam`` is the level at which min(cap * size, lam * weight) adds up to
    ``share`` of all words: the largest of the levels reached by capping the
    sources one after the other in the order of cap * size / weight.
    One row per source goes through these windows.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = sources.withColumn("source_no", F.row_number().over(by_code_point))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                            ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    capped_first = (Window.orderBy(F.col("_cap") / F.col("weight"), "source_no")
                    .rowsBetween(Window.unboundedPreceding, -1))
    level = ((F.sum("source_size").over(everything) * F.lit(share)
              - F.coalesce(F.sum("_cap").over(capped_first), F.lit(0.0)))
             / (F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(capped_first), F.lit(0.0))))
    w = w.withColumn("_level", level)
    lam = F.max("_level").over(everything)
    return (w.withColumn("target", F.least(F.col("_cap"), lam * F.col("weight")))
            .drop("_cap", "_level"))


def _coprime_step(m: int) -> int:
    a = max(1, round(m * (math.sqrt(5) - 1) / 2))
    while math.gcd(a, m) != 1:
        a += 1
    return a


def slots(spark: SparkSession, plan: DataFrame, m: int) -> DataFrame:
    """The schedule: slot, source_no, block (rank of the slot in its source).

    ``plan`` holds source_no, first_point and n_blocks.  Points are made from
    the sources' ranges, in runs of at most 8192, and mapped back to slots
    with the inverse of the step.
    """
    run = 8192
    back = pow(_coprime_step(m), -1, m) if m > 1 else 0
    points = (plan.filter("n_blocks > 0")
              .select("source_no", "first_point", "n_blocks",
                      F.explode(F.sequence(F.lit(0).cast("long"),
                                           F.floor((F.col("n_blocks") - 1) / run))).alias("_run"))
              .repartition("source_no", "_run")
              .select("source_no", F.explode(F.sequence(
                  F.col("first_point") + F.col("_run") * run,
                  F.col("first_point") + F.least(F.col("_run") * run + run,
                                                 F.col("n_blocks")) - 1)).alias("point")))
    # the product of a point and the step can be beyond a long
    slot = F.col("point").cast("decimal(18,0)") * F.lit(back).cast("decimal(18,0)") % F.lit(max(m, 1))
    at = points.select("source_no", slot.cast("long").alias("slot"))
    at = at.withColumn("_b", F.floor(F.col("slot") / 65536))
    return running_total(at, ["source_no"], "_b", ["slot"], F.lit(1).cast("long"), "block").drop("_b")


class Mix:
    """rows: doc_id, source, source_no, size, source_size, target, start;
    schedule: slot, source_no, block; pieces: the words that a slot takes."""

    def __init__(self, rows: DataFrame, schedule: DataFrame, pieces: DataFrame):
        self.rows, self.schedule, self.pieces = rows, schedule, pieces

    def taken(self) -> DataFrame:
        """Per document the words that all slots take from it, and the first
        of these slots (null where nothing is taken)."""
        got = (self.pieces.groupBy("source_no", "start")
               .agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot")))
        some = self.rows.filter("size > 0").join(got, ["source_no", "start"], "left")
        none = self.rows.filter("size = 0").withColumns({"taken": F.lit(None).cast("long"),
                                                         "first_slot": F.lit(None).cast("long")})
        return some.unionByName(none).select("doc_id", "source", "size", "source_size", "target",
                                             F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mix(docs: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: int = CAP,
        block_words: int = BLOCK_WORDS, seed: str = SEED, keep: tuple[str, ...] = ()) -> Mix:
    """Plan and schedule the mix of ``docs`` (doc_id, text, source); ``keep``
    names further columns that ``rows`` carries."""
    spark = docs.sparkSession
    sized = cut_lineage(docs.select(
        "doc_id", "source", *keep, word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"),
                                                     F.lit("null")))).alias("_h")))
    by_source = cut_lineage(targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")),
        share, weights, cap))
    take = F.floor(F.col("target") + 0.5).cast("long")
    need = F.ceil(take / block_words).cast("long")
    totals = by_source.agg(F.count("*"), F.sum("_n"), F.sum(need)).first()
    n_sources, n_rows, m = (int(x or 0) for x in totals)
    earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    plan = by_source.select("source_no", "source", "source_size", "target", take.alias("_take"),
                            need.alias("n_blocks"),
                            F.coalesce(F.sum(need).over(earlier), F.lit(0)).alias("first_point"))
    plan = cut_lineage(plan)
    per_bucket = HASH_SPACE // min(HASH_SPACE, buckets_for(n_rows))
    sized = sized.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 6), 16, 10).cast("long")
                                           / per_bucket))
    small = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    rows = (sized.join(small.withColumnRenamed("source", "_src"),
                       F.col("source").eqNullSafe(F.col("_src"))).drop("_src"))
    rows = running_total(rows, ["source_no"], "_b", ["_h", "doc_id", "size", *keep], F.col("size"), "start")
    rows = cut_lineage(rows.select("doc_id", "source", *keep, "source_no", "size", "source_size", "target",
                                   "_take", "start"))
    schedule = slots(spark, plan, m)
    rounds = rows.filter("size > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))))
    lo = F.col("epoch") * F.col("source_size") + F.col("start")
    rounds = (rounds.withColumn("_lo", lo)
              .withColumn("_hi", F.least(lo + F.col("size"), F.col("_take")))
              .filter("_hi > _lo"))
    blocks = rounds.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("_lo") / block_words), F.floor((F.col("_hi") - 1) / block_words))))
    first = F.greatest(F.col("_lo"), F.col("block") * block_words)
    last = F.least(F.col("_hi"), (F.col("block") + 1) * block_words)
    pieces = (blocks.select("source_no", "block", "doc_id", "start", "epoch",
                            (first - F.col("_lo")).alias("from_word"), (last - first).alias("n_words"))
              .join(schedule, ["source_no", "block"]))
    return Mix(rows.drop("_take"), schedule, pieces)


def mixed_documents(docs: DataFrame, slot_column: str | None = None, **params) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``, in the order
    of the schedule; ``slot_column`` names a further column for the slot.

    A document appears once per round in which words of it are taken, at the
    slot of the first of them, so a source's words add up to what the mix
    takes.  Where a source's target ends inside a document, that row's text
    holds the first words taken, joined by a blank, and n_chars (if there is
    one) their length.  Rows without words cost nothing: each appears once,
    behind the last slot (null).
    """
    columns = docs.columns
    keyed = docs.withColumn("__h", F.md5("text"))
    made = mix(keyed.select("doc_id", "source", "text", "__h"), keep=("__h",), **params)
    # rows alike in id, source and text are interchangeable: they are numbered,
    # and the texts only where there are any such rows
    alike = Window.partitionBy("doc_id", "source", "__h").orderBy("start")
    spans = made.rows.filter("size > 0").select(
        "source_no", "start", F.col("doc_id").alias("__id"), F.col("source").alias("__src"),
        F.col("__h").alias("__hash"), F.col("size").alias("__size"), F.row_number().over(alike).alias("__c"))
    copies = spans.agg(F.max("__c")).first()[0] or 1
    taken = (made.pieces.groupBy("source_no", "start", "epoch")
             .agg(F.sum("n_words").alias("__n"), F.min("slot").alias("__slot"))
             .withColumnsRenamed({"source_no": "__no", "start": "__start", "epoch": "__epoch"})
             .join(spans.withColumnsRenamed({"source_no": "__no", "start": "__start"}), ["__no", "__start"]))
    match = (F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__src"))
             & (F.col("__h") == F.col("__hash")))
    if copies > 1:
        keyed = keyed.withColumn("__copy", F.row_number().over(
            Window.partitionBy("doc_id", "source", "__h").orderBy("__h")))
        match = match & (F.col("__copy") == F.col("__c"))
    wordless = F.col("text").isNull() | ~F.col("text").rlike(WORD)
    rows = (keyed.join(taken, match, "left").filter(F.col("__n").isNotNull() | wordless)
            .orderBy(F.col("__slot").asc_nulls_last(), "__epoch", "__start", "doc_id"))
    # below, the text is cut after the sort, whose sampling would cut it twice
    cut = F.col("__n") < F.col("__size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1),
                                 F.col("__n").cast("int")), " ")
    rows = rows.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long"))
                               .otherwise(F.col("n_chars")))
    if slot_column:
        return rows.select(*columns, F.col("__slot").alias(slot_column))
    return rows.select(*columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mix(documents(spark, sf_dir)).taken()
            .select("doc_id", "size", "source_size", "target", "taken", "first_slot"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
v AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             (source_size * 2)::DOUBLE AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER before, 0.0)) /
                (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS lev
      FROM v WINDOW before AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT no, source, source_size, least(cap, max(lev) OVER () * weight) AS target FROM l),
b AS (SELECT no, (floor(target + 0.5)::BIGINT + 4095) // 4096 AS n_blocks FROM t),
p AS (SELECT no, n_blocks, coalesce(sum(n_blocks) OVER (ORDER BY no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_point FROM b),
m AS (SELECT sum(n_blocks)::BIGINT AS m, greatest(1, round(sum(n_blocks) * (sqrt(5.0) - 1) / 2))::BIGINT AS a0 FROM b),
a AS (SELECT m, min(x) AS a FROM (SELECT m, unnest(range(a0, a0 + 1000)) AS x FROM m WHERE m > 0)
      WHERE gcd(x, m) = 1 GROUP BY m),
k AS (SELECT i AS slot, (i * a) % m AS point FROM (SELECT m, a, unnest(range(0, m)) AS i FROM a)),
sched AS (SELECT p.no, k.slot, row_number() OVER (PARTITION BY p.no ORDER BY k.slot) - 1 AS block
          FROM k JOIN p ON k.point >= p.first_point AND k.point < p.first_point + p.n_blocks),
r AS (SELECT d.doc_id, d.size, t.no, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS take,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, take - start)) + greatest(0, least(size, take - source_size - start)))::BIGINT AS taken,
       sched.slot AS first_slot
FROM r LEFT JOIN sched ON sched.no = r.no
  AND sched.block = CASE WHEN r.size > 0 AND r.start < r.take THEN r.start // 4096 END
"""
