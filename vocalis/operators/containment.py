"""Substring join: posts x names on ``contains(lower(text), lower(name))``
(JOIN-2), by one walk over each text.

A name has at least two words of at least two characters.  A task makes one
Aho-Corasick automaton of the lower-cased names of each scope and walks a text
through that of its scope once (``places``), so a text costs its length and its
occurrences, not names times length.  Fused joins use the *anchor* around the
name's first space: the 3 characters on each side when both neighbouring words
have 3 or more ("apache license" -> "che lic"), else 2 ("al gore" -> "al go").
No text goes through an exchange, whatever the number of names:

* up to ``BROADCAST_ANCHOR_ROWS`` names, ``name_hits`` gives one row per
  (post, name) with the number, the first and the last place of its
  occurrences and counters of words near them, in the scan stage.  Rows leave
  with the number of the name; the broadcast names follow by it.
* beyond that, ``occurrences`` walks the texts once for each part of
  ``BROADCAST_KEY_ROWS`` names.  An occurrence leaves the scan as ids,
  per-post fields and the characters around it, which are bounded by the name
  and the asked margin.  These windows meet the names on ``(scope, nl)``.
* work that is a column expression over the whole text per pair (``pair_fn``)
  runs as fused joins over parts of the names: the explode references the post
  text without copying it in whole-stage codegen.

The result equals the nested-loop join (checked in the tests).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_

# Anchor rows are (scope, key, name, nl): ~80 bytes each.  200k rows ~ 16 MB.
BROADCAST_ANCHOR_ROWS = 200_000
# Names of a part of ``occurrences``, (scope, nl): ~40 bytes each, about 320
# in a task's automaton.  400k rows ~ 130 MB.
BROADCAST_KEY_ROWS = 400_000
# Rows of found names that leave a task at once, about.
FOUND_ROWS = 50_000
# Candidates of a post that are verified in one row, about.
RUN_CANDIDATES = 1_000

TEXT_KEYS_RE_2 = r"(?s)(?=([^ ]{2} [^ ]{2}))"
TEXT_KEYS_RE_3 = r"(?s)(?=([^ ]{3} [^ ]{3}))"


def anchor_key(nl) -> Column:
    """The 7 (or 5) characters around the first space of a lower-cased name."""
    n = col_(nl)
    i = F.instr(n, " ")
    wide = ((i - 1 >= 3) & (F.length(n) - i >= 3)
            & (F.instr(F.substring(n, i + 1, 3), " ") == 0)
            & (F.instr(F.substring(n, i - 3, 3), " ") == 0))
    return F.when(wide, F.substring(n, i - 3, 7)).otherwise(F.substring(n, i - 2, 5))


def text_keys(tl, narrow: bool = True, wide: bool = True) -> Column:
    """The windows of a text; a pass is left out when no anchor has its width."""
    t = col_(tl)
    passes = [F.regexp_extract_all(t, F.lit(r), 1) for r, want in
              ((TEXT_KEYS_RE_2, narrow), (TEXT_KEYS_RE_3, wide)) if want]
    if not passes:
        return F.array().cast("array<string>")
    return F.array_distinct(F.concat(*passes))


def spread(posts: DataFrame) -> DataFrame:
    """Deal the posts anew when the scan has fewer partitions than there are
    cores; a large scan stays as it is."""
    cores = posts.sparkSession.sparkContext.defaultParallelism
    return posts.repartition(2 * cores) if posts.rdd.getNumPartitions() < cores else posts


def anchor_sizes(names: DataFrame) -> tuple[int, bool, bool]:
    """(rows, any narrow anchor, any wide anchor) of a name table."""
    n = F.length("key")
    r = anchors_of(names).agg(F.count(F.lit(1)).alias("n"), F.max(n < 7).alias("narrow"),
                              F.max(n >= 7).alias("wide")).first()
    return int(r["n"]), bool(r["narrow"]), bool(r["wide"])


def anchors_of(names: DataFrame) -> DataFrame:
    return (names.select("scope", "name")
                 .withColumn("nl", F.lower("name"))
                 .withColumn("key", anchor_key("nl")))


PairFn = Callable[[Column, Column], Column]


def fused_join(posts: DataFrame, names: DataFrame, narrow: bool, wide: bool, post_columns=("platform",),
               pair_fn: PairFn | None = None,
               post_fn: Callable[[Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """The join in the scan stage, for a broadcast name table."""
    tl = F.col("tl")
    base = spread(posts).select("post_id", "scope", *post_columns, F.lower("text").alias("tl"))
    keyed = base.select(*base.columns, F.explode(text_keys(tl, narrow, wide)).alias("key"))
    anchors = F.broadcast(anchors_of(names))
    j = keyed.join(anchors, (keyed.scope == anchors.scope) & (keyed.key == anchors.key)
                   & (F.instr(keyed.tl, anchors.nl) > 0)).drop(anchors.scope).drop("key")
    extra = post_fn(tl, F.col("scope")) if post_fn is not None else {}
    cols = ["post_id", "scope", *post_columns, *[v.alias(k) for k, v in extra.items()], "name", "nl"]
    if pair_fn is not None:
        cols.append(pair_fn(tl, F.struct("name", "nl")).alias("x"))
    return j.select(*cols)


def index_maker():
    """``name_index``; an inner function, which goes to the tasks by value, as
    those of ``text_walk``."""
    def name_index(scopes: list, names: list) -> dict:
        """scope -> (automaton of its lower-cased names, their lengths, their
        numbers), of names numbered as they come."""
        import ahocorasick
        numbers: dict = {}
        for k, (scope, nl) in enumerate(zip(scopes, names)):
            i = -1 if nl is None or scope is None else nl.find(" ")
            left, right = (nl[:i], nl[i + 1:]) if i >= 0 else ("", "")
            if min(len(left), len(right)) < 2 or " " in right[:2]:
                continue
            numbers.setdefault(scope, {}).setdefault(nl, []).append(k)
        index = {}
        for scope, of in numbers.items():
            walk = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for j, nl in enumerate(of):
                walk.add_word(nl, j)
            walk.make_automaton()
            index[scope] = (walk, [len(nl) for nl in of], list(of.values()))
        return index

    return name_index


name_index = index_maker()


def text_walk():
    """``places``, ``word_places`` and ``any_inside``; inner functions, which go
    to the tasks by value, so these need no copy of the package."""
    def places(t: str, keys: tuple) -> dict[int, list[int]]:
        """Number of a name -> where it starts in ``t`` (from 0), overlaps too."""
        found: dict = {}
        walk, lengths, numbers = keys
        for end, j in walk.iter(t):
            for k in numbers[j]:
                found.setdefault(k, []).append(end + 1 - lengths[j])
        return found

    def word_places(t: str, words: list[str]) -> list[tuple[list[int], int]]:
        """(places, length) of each word that ``t`` holds."""
        out = []
        for w in words:
            at, i = [], t.find(w)
            while i >= 0:
                at.append(i)
                i = t.find(w, i + 1)
            if at:
                out.append((at, len(w)))
        return out

    def any_inside(spots: list[tuple[list[int], int]], lo: int, hi: int) -> bool:
        """Whether one of the words lies in [lo, hi)."""
        for at, n in spots:
            i = bisect_left(at, lo)
            if i < len(at) and at[i] + n <= hi:
                return True
        return False

    return places, word_places, any_inside


def inside_maker():
    """``inside``; an inner function, as those of ``text_walk``."""
    def inside(words: list, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether a word of each list lies in [lo, hi), by occurrence."""
        every = np.ones(len(lo), bool)
        for spots in words:
            some = np.zeros(len(lo), bool)
            for at, n in spots:
                at = np.array([*at, np.iinfo(np.int64).max - n])
                some |= at[np.searchsorted(at, lo)] + n <= hi
            every &= some
        return every

    return inside


#: counters of occurrences: (radius, [array<string> columns]); one counts when
#: the characters up to radius around it hold a word of each array
Near = dict[str, tuple[int, list[Column]]]


def name_hits(posts: DataFrame, names: DataFrame, post_columns=("platform",), near: Near | None = None,
              post_fn: Callable[[Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """One row per post and name in it: ``(post_id, scope, *post_columns,
    *post fields, name, nl, n, first, last, *near)`` with the number, the first
    and the last place (from 1) of its occurrences.  The names are broadcast."""
    spark = posts.sparkSession
    near = near or {}
    table = names.select("scope", "name").withColumn("nl", F.lower("name")).toArrow()
    folded = table["nl"].to_pylist()
    shared = spark.sparkContext.broadcast((table["scope"].to_pylist(), folded))
    numbered = spark.createDataFrame(
        pa.table({"_k": pa.array(range(len(table)), pa.int32()), "name": table["name"].cast(pa.string()),
                  "nl": table["nl"].cast(pa.string())})
        if len(table) else [], "_k int, name string, nl string")
    extra = post_fn(F.col("tl"), F.col("scope")) if post_fn is not None else {}
    lists = {f"_w{i}_{j}": c for i, (_, words) in enumerate(near.values()) for j, c in enumerate(words)}
    base = spread(posts).select("post_id", "scope", *post_columns, F.lower("text").alias("tl"))
    base = base.select(*base.columns, *[v.alias(k) for k, v in extra.items()], *[v.alias(k) for k, v in lists.items()])
    kept = ["post_id", "scope", *post_columns, *extra]
    counted = ["_k", "n", "first", "last", *near]
    schema = T.StructType([base.schema[c] for c in kept] + [T.StructField(c, T.IntegerType()) for c in counted])
    indexed, (_, word_places, _), inside = index_maker(), text_walk(), inside_maker()
    radii = [(r, [f"_w{i}_{j}" for j in range(len(words))]) for i, (r, words) in enumerate(near.values())]

    def as_arrays(keys):
        """A scope's automaton, the lengths of its names and, name by name,
        where their numbers begin, how many there are, and the numbers."""
        walk, sizes, numbers = keys
        times = np.array([len(x) for x in numbers], np.int64)
        return walk, np.array(sizes, np.int64), np.cumsum(times) - times, times, np.array([*chain(*numbers)], np.int64)

    def run(batches):
        index = {scope: as_arrays(keys) for scope, keys in indexed(*shared.value).items()}
        lengths = np.array([len(x or "") for x in shared.value[1]], np.int64)
        for b in batches:
            held, size, scopes = [], 0, b["scope"].to_pylist()
            for row, (scope, t) in enumerate(zip(scopes, b["tl"])):
                keys = index.get(scope)
                text = t.as_py() if keys else None
                if not text:
                    continue
                walk, sizes, begin, times, numbers = keys
                found = np.fromiter(chain.from_iterable(walk.iter(text)), np.int64).reshape(-1, 2)
                if not len(found):
                    continue
                name, n = found[:, 1], times[found[:, 1]]
                # an occurrence counts for each name of the same letters
                k = numbers[np.repeat(begin[name] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                start = np.repeat(found[:, 0] + 1 - sizes[name], n)
                hits = np.zeros((len(radii), len(k)), np.int64)
                for i, (r, words) in enumerate(radii):
                    spots = [word_places(text, b[c][row].as_py()) for c in words]
                    if all(spots):
                        hits[i] = inside(spots, start - r, start + lengths[k] + r)
                held.append((np.full(len(k), row), k, start, hits))
                size += len(k)
                if size >= FOUND_ROWS:
                    yield batch_of(b, held, len(lengths))
                    held, size = [], 0
            yield batch_of(b, held, len(lengths))

    def batch_of(b, held, names):
        """One row per post and name of the occurrences of whole posts."""
        if not held:
            own = b.select(kept).slice(0, 0)
            return pa.RecordBatch.from_arrays([*own.columns, *[pa.array([], pa.int32())] * len(counted)],
                                              names=[*kept, *counted])
        row, k, start = (np.concatenate([h[i] for h in held]) for i in range(3))
        hits = np.concatenate([h[3] for h in held], axis=1)
        key = row * names + k
        order = np.argsort(key, kind="stable")      # those of one name stay in the order of the text
        key, start = key[order], start[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tail = np.append(head[1:], len(key))
        own = b.select(kept).take(pa.array(key[head] // names, pa.int64()))
        cells = [key[head] % names, tail - head, start[head] + 1, start[tail - 1] + 1,
                 *[np.add.reduceat(h[order], head) for h in hits]]
        return pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c.astype(np.int32)) for c in cells]],
                                          names=[*kept, *counted])

    found = base.mapInArrow(run, schema)
    return found.join(F.broadcast(numbered), "_k").select(*kept, "name", "nl", *counted[1:])


def in_parts(df: DataFrame, rows: int, most: int, *keys: str) -> list[DataFrame]:
    """``df`` dealt by a hash of ``keys`` into parts of about ``most`` rows."""
    n = max(1, -(-rows // most))
    if n == 1:
        return [df]
    part = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [df.filter(part == k) for k in range(n)]


def contains_join(posts: DataFrame, names: DataFrame, name_rows: int | None = None,
                  post_columns=("platform",), pair_fn: PairFn | None = None,
                  post_fn: Callable[[Column, Column], dict[str, Column]] | None = None
                  ) -> DataFrame:
    """Verified pairs ``(post_id, scope, *post_columns, *post fields, name,
    nl[, x])`` where the lower-cased text contains ``nl``.

    ``pair_fn(tl, cand)`` (``cand`` a struct with ``name``, ``nl``) returns a
    struct of per-pair fields computed from the text (column ``x``);
    ``post_fn(tl, scope)`` returns per-post fields.  ``names`` has distinct
    ``(scope, name)``.
    """
    counted, narrow, wide = anchor_sizes(names)
    name_rows = counted if name_rows is None else name_rows
    if pair_fn is not None:
        if name_rows <= BROADCAST_ANCHOR_ROWS:
            return fused_join(posts, names, narrow, wide, post_columns, pair_fn, post_fn)
        parts = in_parts(names, name_rows, BROADCAST_ANCHOR_ROWS, "scope", "name")
        return reduce(DataFrame.unionByName, (
            fused_join(posts, part, narrow, wide, post_columns, pair_fn, post_fn) for part in parts))
    if name_rows <= BROADCAST_ANCHOR_ROWS:
        return name_hits(posts, names, post_columns, None, post_fn).drop("n", "first", "last")
    found = occurrences(posts, names, 0, post_columns, post_fn)
    fields = [c for c in found.columns if c not in ("before", "after", "lead")]
    return found.select(*fields).distinct()


def occurrences(posts: DataFrame, names: DataFrame, margin: int, post_columns=("platform",),
                post_fn: Callable[[Column, Column], dict[str, Column]] | None = None,
                wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per occurrence of a name: ``(post_id, scope, *post_columns, *post
    fields, name, nl, lead, before, after)``.  ``before`` and ``after`` are the
    text around the name's first space, ``lead`` the characters of the name
    before it; both reach ``margin`` characters beyond the name, where the text
    does.  Texts for which ``wanted(tl)`` is false leave without the margin."""
    spark = posts.sparkSession
    anchors = (names.select("scope", "name").withColumn("nl", F.lower("name"))
               .withColumn("lead", F.instr("nl", " ") - 1))
    folded = anchors.select("scope", "nl").distinct()
    tl = F.col("tl")
    extra = post_fn(tl, F.col("scope")) if post_fn is not None else {}
    base = posts.select("post_id", "scope", *post_columns, F.lower("text").alias("tl"))
    base = base.select(*base.columns, *[v.alias(k) for k, v in extra.items()],
                       (F.lit(True) if wanted is None else wanted(tl)).alias("_wanted"))
    kept = ["post_id", "scope", *post_columns, *extra]
    text = ["nl", "before", "after"]
    indexed, (places, _, _) = index_maker(), text_walk()
    schema = T.StructType([base.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in text])

    def windows(part: DataFrame) -> DataFrame:
        table = part.toArrow()
        of = table["nl"].to_pylist()
        shared = spark.sparkContext.broadcast((table["scope"].to_pylist(), of))

        def run(batches):
            index, names = indexed(*shared.value), shared.value[1]
            for b in batches:
                rows, cells, scopes = [], [], b["scope"].to_pylist()
                for row, (scope, t) in enumerate(zip(scopes, b["tl"])):
                    keys = index.get(scope)
                    whole = t.as_py() if keys else None
                    if not whole:
                        continue
                    m = margin if b["_wanted"][row].as_py() else 0
                    for k, at in places(whole, keys).items():
                        nl = names[k]
                        lead = nl.index(" ")
                        for s in at:
                            rows.append(row)
                            cells.append((nl, whole[max(0, s - m):s + lead], whole[s + lead:s + len(nl) + m]))
                    if len(rows) >= FOUND_ROWS:
                        yield batch_of(b, rows, cells)
                        rows, cells = [], []
                yield batch_of(b, rows, cells)

        return base.mapInArrow(run, schema)

    def batch_of(b, rows, cells):
        own = b.select(kept).take(pa.array(rows, pa.int64()))
        new = [pa.array(c, pa.string()) for c in (zip(*cells) if cells else [[]] * 3)]
        return pa.RecordBatch.from_arrays([*own.columns, *new], names=[*kept, *text])

    parts = [windows(part) for part in in_parts(folded, folded.count(), BROADCAST_KEY_ROWS, "scope", "nl")]
    found = reduce(DataFrame.unionByName, parts).join(anchors, ["scope", "nl"])
    # the characters that came with the row are those of the name it met
    name = F.concat(F.right("before", F.col("lead")), F.left("after", F.length("nl") - F.col("lead")))
    return found.filter(name == F.col("nl")).select(
        "post_id", "scope", *post_columns, *extra, "name", "nl", "lead", "before", "after")


def around(radius: int) -> Column:
    """The text of an occurrence with ``radius`` characters on each side."""
    return F.concat(F.right("before", F.col("lead") + radius),
                    F.left("after", F.length("nl") - F.col("lead") + radius))


#: found occurrences whose counters a task adds up before they leave it, about
SUMMED_ROWS = 1_000_000


def near_sums(posts: DataFrame, names: DataFrame, near: Near) -> DataFrame:
    """``(scope, name, *near)``: the counters of ``near`` over all occurrences of
    a name in the posts of a scope, rows without any left out.

    ``names`` has ``name``, ``nl`` and ``_of``, the scope whose posts it is
    looked for in (null: all).  They may be of any form and number: the posts
    are read once for each part of ``BROADCAST_KEY_ROWS`` names.  An occurrence
    that counts lies around a word of its counter, so only these stretches of a
    text go through the automaton, and a task adds the counters up by name: no
    row per post and name, no text leaves it."""
    spark = posts.sparkSession
    lists = {f"_w{i}_{j}": c for i, (_, words) in enumerate(near.values()) for j, c in enumerate(words)}
    base = spread(posts).select("scope", F.lower("text").alias("tl"))
    base = base.select("scope", "tl", *[v.alias(k) for k, v in lists.items()])
    schema = T.StructType([base.schema["scope"], T.StructField("name", T.StringType())]
                          + [T.StructField(c, T.LongType()) for c in near])
    (_, word_places, _), inside = text_walk(), inside_maker()
    radii = [(r, [f"_w{i}_{j}" for j in range(len(words))]) for i, (r, words) in enumerate(near.values())]
    columns, most = ["scope", "name", *near], SUMMED_ROWS

    def automata(keys, scopes):
        """scope of the posts (None: all) -> (automaton, lengths by number)."""
        import ahocorasick
        index = {}
        for k, (nl, scope) in enumerate(zip(keys, scopes)):
            walk = index.setdefault(scope, ahocorasick.Automaton())
            walk.add_word(nl, [*walk.get(nl, []), k])
        for walk in index.values():
            walk.make_automaton()
        return index

    def stretches(spots, longest, size):
        """The merged stretches of a text that hold all counting occurrences."""
        at = sorted((max(0, a + n - r - longest), min(size, a + r + longest))
                    for r, words in spots for places, n in words[0] for a in places)
        merged = []
        for lo, hi in at:
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        return merged

    def of_part(part: DataFrame) -> DataFrame:
        table = part.toArrow()
        shared = spark.sparkContext.broadcast(tuple(table[c].to_pylist() for c in ("name", "nl", "_of")))

        def run(batches):
            names, keys, scopes = shared.value
            index = automata(keys, scopes)
            lengths = np.array([len(x) for x in keys], np.int64)
            longest = int(lengths.max(initial=0))
            held, size = {}, 0
            for b in batches:
                for row, (scope, t) in enumerate(zip(b["scope"].to_pylist(), b["tl"])):
                    walks = [index[x] for x in {None, scope} if x in index]
                    text = t.as_py() if walks else None
                    if not text:
                        continue
                    spots = [(r, [word_places(text, b[c][row].as_py()) for c in words]) for r, words in radii]
                    k, end = [], []
                    for lo, hi in stretches([x for x in spots if all(x[1])], longest, len(text)):
                        for walk in walks:
                            for e, numbers in walk.iter(text, lo, hi):
                                k += numbers
                                end += [e + 1] * len(numbers)
                    if not k:
                        continue
                    k, end = np.array(k, np.int64), np.array(end, np.int64)
                    start = end - lengths[k]
                    hits = np.array([inside(words, start - r, end + r) if all(words) else np.zeros(len(k), bool)
                                     for r, words in spots])
                    some = hits.any(axis=0)
                    held.setdefault(scope, []).append((k[some], hits[:, some]))
                    size += int(some.sum())
                    if size >= most:
                        yield from added_up(names, held)
                        held, size = {}, 0
            yield from added_up(names, held)

        return base.mapInArrow(run, schema)

    def added_up(names, held):
        for scope, found in held.items():
            k, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
            hits = np.concatenate([x[1] for x in found], axis=1)
            sums = [np.bincount(at, h, len(k)).astype(np.int64) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array([scope] * len(k), pa.string()), pa.array([names[x] for x in k], pa.string()),
                 *[pa.array(x) for x in sums]], names=columns)

    parts = [of_part(part) for part in in_parts(names, names.count(), BROADCAST_KEY_ROWS, "name", "nl", "_of")]
    return reduce(DataFrame.unionByName, parts).groupBy("scope", "name").agg(*[F.sum(c).alias(c) for c in near])


def supplied_names(names: DataFrame) -> DataFrame:
    """``(name, nl, _of)``, distinct, of supplied names with or without a scope."""
    of = F.col("scope") if "scope" in names.columns else F.lit(None).cast("string")
    return names.filter(F.length("name") > 0).select("name", F.lower("name").alias("nl"), of.alias("_of")).distinct()


def contains_join_small(posts: DataFrame, names: DataFrame, pair_fn: PairFn | None = None,
                        post_fn: Callable[[Column, Column], dict[str, Column]] | None = None,
                        broadcast_rows: int | None = None) -> DataFrame:
    """For user-supplied names of any form and number (single words allowed,
    so no anchor around a space).  ``names`` has ``name`` and optionally
    ``scope`` (then a name only matches posts of its scope).  Output as
    ``contains_join``: ``(post_id, scope, platform, [post fields], name, nl[, x])``.

    Up to ``broadcast_rows`` (``BROADCAST_ANCHOR_ROWS``) names a name's first ``min(3, length)``
    characters are its key, probed in the scan stage.  Beyond that the texts'
    distinct windows of these lengths become postings of ids, a name's key is
    its rarest window by their counts, and the texts join the verified-to-be
    candidates once, a post's candidates in rows of about ``RUN_CANDIDATES``.
    """
    heads = supplied_names(names).withColumn("key", F.substring("nl", 1, 3))
    n_rows, widths = heads.agg(F.count(F.lit(1)), F.collect_set(F.length("key"))).first()
    tl = F.col("tl")
    base = posts.select("post_id", "scope", "platform", F.lower("text").alias("tl"))

    def windows(t: Column) -> Column:
        cut = [F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{w}}}))"), 1) for w in sorted(widths)]
        return F.array_distinct(F.concat(*cut)) if cut else F.array().cast("array<string>")

    matches = lambda n: F.instr(tl, n) > 0
    extra = post_fn(tl, F.col("scope")) if post_fn is not None else {}
    cols = ["post_id", "scope", "platform", *[v.alias(k) for k, v in extra.items()], "name", "nl"]
    if pair_fn is not None:
        cols.append(pair_fn(tl, F.struct("name", "nl")).alias("x"))
    if n_rows <= (BROADCAST_ANCHOR_ROWS if broadcast_rows is None else broadcast_rows):
        base = spread(posts).select("post_id", "scope", "platform", F.lower("text").alias("tl"))
        keyed = base.select(*base.columns, F.explode(windows(tl)).alias("key"))
        j = keyed.join(F.broadcast(heads), "key").filter(
            matches(F.col("nl")) & (F.col("_of").isNull() | (F.col("_of") == F.col("scope"))))
        return j.select(*cols)

    postings = posts.select("post_id", "scope", F.explode(windows(F.lower("text"))).alias("key"))
    counts = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # every window of a name, and the rarest one; a window that no text has
    # leaves the name without candidates
    own = heads.select("name", "nl", "_of", F.explode(F.array_distinct(F.regexp_extract_all(
        "nl", F.concat(F.lit("(?s)(?=(.{"), F.length("key").cast("string"), F.lit("}))")), F.lit(1)))).alias("key"))
    rarest = (own.join(counts, "key", "left").groupBy("name", "nl", "_of")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key").alias("key"))).alias("_k"))
              .filter("_k.n > 0").select("name", "nl", "_of", F.col("_k.key").alias("key")))
    cand = postings.join(rarest, "key").filter(
        F.col("_of").isNull() | (F.col("_of") == F.col("scope"))).select("post_id", "name", "nl")
    per_post = cand.groupBy("post_id").agg(F.ceil(F.count(F.lit(1)) / RUN_CANDIDATES).alias("_runs"))
    runs = (cand.join(per_post, "post_id")
            .groupBy("post_id", F.pmod(F.xxhash64("name"), F.col("_runs")).alias("_run"))
            .agg(F.collect_list(F.struct("name", "nl")).alias("cands")))
    j = runs.join(base, "post_id").select(
        *base.columns, F.explode(F.filter("cands", lambda c: matches(c["nl"]))).alias("_h"))
    return j.select(*base.columns, "_h.name", "_h.nl").select(*cols)
