"""Variant merge of names (ENT-6) as distributed rounds.

Semantics (greedy, not transitive): names of a scope are ranked by count
desc, then first seen.  Walking the ranking, a name not yet absorbed keeps
its label and absorbs every later, unabsorbed name whose word *set* equals,
contains or is contained in its own.  Absorbed names never absorb.

That is the lexicographically-first maximal independent set of the
"word-set inclusion" graph in rank order, with each absorbed node owned by
its earliest kept neighbour.  It is computed in rounds:

* edges come from an exact equi-join (JOIN-3): a name's whole word set
  against every subset of the other name's word set (<= 7 per name);
* a node is absorbed as soon as one earlier neighbour is known to be kept, and
  kept once all its earlier neighbours are absorbed;
* each round joins the edges between *undecided* nodes only; whom it absorbs
  and the edges left are written to the reliable checkpoint folder, and the loop
  ends when no edge is left (each round decides at least the earliest node
  left, so it does end);
* owners (earliest kept earlier neighbour) follow from one join after the loop.

Names without an edge never enter the loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .mentions import WS_RE


def word_set(name_col="name"):
    """Sorted distinct lower-case words of a name (its word *set*)."""
    return F.array_sort(F.array_distinct(
        F.split(F.trim(F.regexp_replace(F.lower(F.col(name_col)), WS_RE, " ")), " ")))


def subset_keys(words: str) -> F.Column:
    """Every non-empty subset of a (sorted) word set, as a space-joined key.
    Names have at most 3 words, so at most 7 keys per name."""
    return F.expr(f"transform(sequence(1, shiftleft(1, size({words})) - 1), "
                  f"m -> array_join(filter({words}, (x, i) -> (shiftright(m, i) & 1) = 1), ' '))")


def inclusion_edges(nodes: DataFrame) -> DataFrame:
    """Undirected edges ``(scope, a, b)`` (both directions) between names whose
    word sets are equal or nested.  ``nodes``: (scope, name, words).

    Exact equi-join: ``a``'s whole word set is a key; ``b`` emits all subsets
    of its word set; a key match means set(a) is a subset of set(b).  Only
    true pairs are produced -- no candidate blow-up on common words."""
    small = nodes.select("scope", F.col("name").alias("a"), F.array_join("words", " ").alias("key"))
    large = nodes.select("scope", F.col("name").alias("b"), F.explode(subset_keys("words")).alias("key"))
    sub = (small.join(large, ["scope", "key"])
           .filter(F.col("a") != F.col("b"))
           .select("scope", "a", "b"))
    both = sub.unionByName(sub.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    return both.distinct()


def merge_variants(nodes: DataFrame) -> DataFrame:
    """Merge name variants.

    ``nodes``: ``(scope, name, cnt long, platforms array<string>, rk)`` where
    ``rk`` is an orderable rank key (larger = earlier in the ranking; unique
    per scope).  Returns the kept names with summed counts and unioned
    platforms: ``(scope, name, cnt, platforms, rk, n_variants)``.  Word sets
    have at most 3 words (the extraction pattern), so subset keys stay <= 7.
    """
    base = nodes.withColumn("words", word_set())
    base = cut_lineage(base)
    edges = inclusion_edges(base)
    rk = base.select("scope", "name", "rk")
    # directed: e (earlier) -> l (later)
    directed = (edges.join(rk.withColumnRenamed("name", "a").withColumnRenamed("rk", "rk_a"),
                           ["scope", "a"])
                     .join(rk.withColumnRenamed("name", "b").withColumnRenamed("rk", "rk_b"),
                           ["scope", "b"])
                     .filter(F.col("rk_a") > F.col("rk_b"))
                     .select("scope", F.col("a").alias("e"), F.col("rk_a").alias("rk_e"),
                             F.col("b").alias("l")))
    directed = cut_lineage(directed)

    # A round keeps the names without an earlier neighbour left and absorbs
    # their neighbours; edges of absorbed names leave, what is never absorbed is kept.
    gone = []
    left = directed.select("scope", "e", "l")
    while not left.isEmpty():
        heads = left.select("scope", "e").distinct().join(
            left.select("scope", F.col("l").alias("e")).distinct(), ["scope", "e"], "left_anti")
        absorbed = cut_lineage(left.join(heads, ["scope", "e"]).select("scope", "l").distinct())
        gone.append(absorbed)
        left = cut_lineage(left.join(absorbed, ["scope", "l"], "left_anti")
                           .join(absorbed.withColumnRenamed("l", "e"), ["scope", "e"], "left_anti"))
    lost = reduce(DataFrame.unionAll, gone) if gone else directed.select("scope", "l")
    # owner: the earliest kept one of the earlier neighbours
    found = (directed.join(lost, ["scope", "l"])
             .join(lost.withColumnRenamed("l", "e"), ["scope", "e"], "left_anti")
             .groupBy("scope", F.col("l").alias("name"))
             .agg(F.max(F.struct("rk_e", "e")).alias("best_k"))
             .select("scope", "name", F.lit("A").alias("status"), F.col("best_k.e").alias("owner")))
    status = (base.select("scope", "name").join(found, ["scope", "name"], "left")
              .select("scope", "name", F.coalesce("status", F.lit("K")).alias("status"), "owner"))

    owner = F.when(F.col("status") == "K", F.col("name")).otherwise(F.col("owner"))
    assigned = base.join(status, ["scope", "name"]).withColumn("label", owner)
    kept = base.select("scope", F.col("name").alias("label"), F.col("rk").alias("rk_label"))
    counts = assigned.groupBy("scope", "label").agg(F.sum("cnt").alias("cnt"),
                                                    F.count(F.lit(1)).alias("n_variants"))
    # platform union: explode + collect_set keeps each group bounded by the
    # number of distinct platforms, however many names a label absorbed
    plats = (assigned.select("scope", "label", F.explode("platforms").alias("platform"))
             .groupBy("scope", "label").agg(F.array_sort(F.collect_set("platform")).alias("platforms")))
    return (counts.join(plats, ["scope", "label"], "left").join(kept, ["scope", "label"])
            .select("scope", F.col("label").alias("name"), "cnt",
                    F.coalesce("platforms", F.array().cast("array<string>")).alias("platforms"),
                    F.col("rk_label").alias("rk"), "n_variants"))
