"""Periodic runs of words by maximal pairs.

A run is a stretch of words with smallest period q and at least ``MIN_POWER``
periods and ``MIN_WORDS`` words that no neighbouring word extends.  Documents
are judged one by one, so the work is a single pass without a shuffle; a task
works on batches of about ``BATCH_BYTES`` of text.

1. Words become 64-bit hashes mixed with their document, and prefix doubling
   sorts the suffixes of all documents of the batch at once.  Only suffixes
   that still share their prefix inside their document go to the next round.
2. Suffixes that share at least ``shortest_pair`` words with another one of
   their document are the leaves of the LCP-interval tree.  An interval whose
   positions lie too far apart for its longest common prefix is left out whole.
3. The tree is walked bottom-up.  A node holds the positions of its leaves in
   order, each with its class: the word on its left.  A child's positions are
   merged into the larger list.  Two positions i < j from different children
   share exactly the node's lcp l, so the pair cannot grow to the right, and
   if their classes differ it cannot grow to the left: it is a maximal pair,
   and [i, j + l) is maximal with period j - i.  The pair is a run if the
   distance meets the length constraints, nothing has to be extended.

Only neighbours in a node's list are compared: with three periods or more, a
position between i and j would give the run a smaller period.  So a merge
costs the smaller list's length times a search, whatever the classes.

Cases: a null or empty text has no words and no runs, its collapsed text is
empty.  Words are compared by 64-bit hashes.  Rows are independent: repeated
rows and null ids give one row each.  Runs may overlap.  An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents
from .hashing import buffers, mix, word_hashes, words

MIN_WORDS, MIN_POWER = 6, 4
BATCH_BYTES = 4 << 20
#: positions in one part of an ordered list
PART = 512

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def shortest_pair(min_words: int, min_power: int) -> int:
    """Words that the two suffixes of a run's pair share at least."""
    return min(max(min_words - q, (min_power - 1) * q) for q in range(1, min_words + 2))


class Positions:
    """Numbers in order, in parts of bounded size, so that an insertion moves
    few of them."""

    __slots__ = ("parts", "size")

    def __init__(self, p: int):
        self.parts, self.size = [[p]], 1

    def _part(self, p: int) -> int:
        """The last part whose first number is below p, else the first part."""
        lo, hi = 0, len(self.parts)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.parts[mid][0] < p:
                lo = mid + 1
            else:
                hi = mid
        return max(lo - 1, 0)

    def around(self, p: int) -> tuple[int, int]:
        """The numbers next to p on both sides; -1 for none."""
        k = self._part(p)
        part = self.parts[k]
        at = bisect_left(part, p)
        before = part[at - 1] if at else -1
        if at < len(part):
            return before, part[at]
        return before, self.parts[k + 1][0] if k + 1 < len(self.parts) else -1

    def add(self, p: int) -> None:
        k = self._part(p)
        part = self.parts[k]
        insort(part, p)
        self.size += 1
        if len(part) > 2 * PART:
            self.parts[k:k + 1] = [part[:PART], part[PART:]]

    def __iter__(self):
        for part in self.parts:
            yield from part


def sorted_suffixes(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Positions of the suffixes that share ``least`` keys or more with another
    one, in suffix order, the lcp of each with the one before it, and the
    ranks by prefix length.  Equal keys must belong to one document and a
    document's keys must be consecutive."""
    n = len(keys)
    order = np.argsort(keys)
    fresh = np.ones(n, bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, -1
    again = ~fresh
    again[:-1] |= ~fresh[1:]
    live = order[again]
    levels = [(1, rank.astype(np.int32))]
    leaves, k = live, 1
    while len(live):
        # a suffix that ends here is followed by another document, whose ranks
        # are others than those inside this document
        key = rank[live] * (n + 1) + rank[np.minimum(live + k, n)] + 1
        o = np.argsort(key)
        at, key = live[o], key[o]
        base = rank[at]
        group, part = np.ones(len(at), bool), np.ones(len(at), bool)
        group[1:] = base[1:] != base[:-1]
        part[1:] = key[1:] != key[:-1]
        i = np.arange(len(at))
        rank[at] = base + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        again = ~part
        again[:-1] |= ~part[1:]
        live, k = at[again], 2 * k
        levels.append((k, rank.astype(np.int32)))
        if k <= least:
            leaves = live
    leaves = leaves[np.argsort(rank[leaves])]
    lcp = np.zeros(len(leaves), np.int64)
    if len(leaves) > 1:
        x, y = leaves[:-1].copy(), leaves[1:].copy()
        for k, ranks in reversed(levels):
            same = ranks[np.minimum(x, n)] == ranks[np.minimum(y, n)]
            same &= (x < n) & (y < n)
            step = same * k
            x += step
            y += step
            lcp[1:] += step
    return leaves, lcp, levels


def maximal_pairs(at: list[int], lcp: list[int], left, min_words: int, min_power: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one interval of the tree: ``at`` in
    suffix order, ``lcp[k]`` of at[k] and at[k + 1]."""
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, l: int) -> None:
        q = j - i
        if (min_power - 1) * q <= l and q + l >= min_words and left[i] != left[j]:
            known = found.get((i, q + l))
            if known is None or q < known:
                found[i, q + l] = q

    def merged(a: Positions, b: Positions, l: int) -> Positions:
        big, small = (a, b) if a.size >= b.size else (b, a)
        new = list(small)
        for k, p in enumerate(new):
            before, after = big.around(p)
            if before >= 0 and (k == 0 or new[k - 1] < before):
                pair(before, p, l)
            if after >= 0 and (k + 1 == len(new) or new[k + 1] > after):
                pair(p, after, l)
        for p in new:
            big.add(p)
        return big

    stack: list[tuple[Positions, int]] = []
    for k, p in enumerate(at):
        node, l = Positions(p), lcp[k] if k < len(lcp) else 0
        while stack and stack[-1][1] >= l:
            below, shared = stack.pop()
            node = merged(below, node, shared)
        stack.append((node, l))
    return [(i, length, q) for (i, length), q in found.items()]


def runs_of_batch(h: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS,
                  min_power: int = MIN_POWER) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by document of the word hashes ``h``; document d has the words
    first[d] to first[d + 1]."""
    n = len(h)
    least = shortest_pair(min_words, min_power)
    if n <= least:
        return {}
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    leaves, lcp, levels = sorted_suffixes(keys, least)
    if not len(leaves):
        return {}
    # intervals of suffixes that share ``least`` words or more
    inside = lcp >= least
    part = np.cumsum(~inside)
    starts = np.flatnonzero(~inside)
    longest = np.maximum.reduceat(np.where(inside, lcp, 0), starts)
    by_place = np.lexsort((leaves, part))
    gap = np.full(len(leaves), n, np.int64)
    gap[1:] = np.where(part[by_place[1:]] == part[by_place[:-1]], np.diff(leaves[by_place]), n)
    nearest = np.minimum.reduceat(gap, starts)
    ends = np.append(starts[1:], len(leaves))
    words_left = levels[0][1]
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k in np.flatnonzero(nearest * (min_power - 1) <= longest):
        a, b = starts[k], ends[k]
        at = leaves[a:b]
        d = int(doc[at[0]])
        begin = int(first[d])
        # the word on the left; the first word of a document has none
        classes = np.where(at > begin, words_left[at - 1], -1)
        left = dict(zip((at - begin).tolist(), classes.tolist()))
        pairs = maximal_pairs((at - begin).tolist(), lcp[a + 1:b].tolist(), left, min_words, min_power)
        if pairs:
            out.setdefault(d, []).extend(pairs)
    for pairs in out.values():
        pairs.sort(key=lambda r: (r[0], r[2], r[1]))
    return out


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repetitions of runs, joined by one space."""
    w = text.split()
    if runs:
        drop = np.zeros(len(w) + 1, np.int32)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        w = [w[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return b" ".join(w)


def find_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS,
              min_power: int = MIN_POWER) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed text) per row of
    ``docs``; a word is left out of the collapsed text if a run holds it after
    its first period.  ``min_power`` is a whole number of at least 3."""
    if min_power < 3:
        raise ValueError("min_power must be at least 3")

    def work(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                          ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                          ("collapsed", pa.string())])
        for batch in batches:
            raw = batch.column("raw")
            sizes = np.cumsum(np.diff(buffers(raw)[1]))
            at = 0
            while at < len(raw):
                done = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, side="right")))
                some = raw.slice(at, end - at)
                data, offsets = buffers(some)
                s, e, first = words(data, offsets)
                runs = runs_of_batch(word_hashes(data, s, e), first, min_words, min_power)
                texts = [collapsed(t.as_py() or b"", runs.get(d, [])) for d, t in enumerate(some)]
                lists = [[dict(zip(("start", "length", "period"), r)) for r in runs.get(d, [])]
                         for d in range(len(some))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, end - at), pa.array(np.diff(first), pa.int64()),
                     pa.array(lists, kind.field("runs").type), pa.array(texts, pa.binary()).cast(pa.string())],
                    schema=kind)
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(text).cast("binary").alias("raw")).mapInArrow(work, RUNS)


def looped(text: Column, doc_id: Column) -> Column:
    """The texts of the contract: where crc32 of the decimal id is a multiple
    of 10, each word from a on becomes original word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        rounds = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), rounds), F.lit(1), n), " ")

    # as a lambda's argument the words are cut once and not once per word
    cut = F.array(F.regexp_extract_all(text, F.lit(f"({WORD})")))
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0),
                  F.get(F.transform(cut, turned), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_runs(docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text")))

    def better(x: Column, y: Column) -> Column:
        by_power = y.length * x.period - x.length * y.period
        return F.when(by_power != 0, F.signum(by_power)).when(x.start != y.start, F.signum(x.start - y.start)) \
            .otherwise(F.signum(x.period - y.period)).cast("int")

    best = F.get(F.array_sort("runs", better), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"),
                                                      r.period.cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
