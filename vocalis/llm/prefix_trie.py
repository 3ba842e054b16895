"""Conversation prefix trie: a burst trie over sequences of turns.

A sequence is a row per turn (seq, d, tid): its d-th turn, d from 1, with the
turn's id (md5 of role and text).

1. Equal sequences become one, the smallest seq of them, with their number:
   two xor sums of 64-bit hashes of (d, tid) and the length tell them apart,
   so no sequence is gathered for it.
2. All sequences start in one container under the root.  A container is the
   set of suffixes below a trie head.  One with more than ``limit`` turns is
   burst: the turns that all its suffixes share are read off counted (d, tid)
   ranges at once, and the suffixes go on by their next turn id to the
   containers of new heads.  So a round is one level of branching, however
   many turns are shared, and a single very long sequence is never gathered.
3. The remaining containers' suffixes are packed, sorted by (head, suffix) and
   swept: a stack holds the open path, and a node leaves when its parent
   closes.  A task holds one container's nodes at most.
4. Totals of subtrees go up from the containers through the heads, a round
   for each level of bursting.

Only counts reach the driver.  Texts are read once and replaced by ids.

Cases: rows without a conv_id take no part.  Turns of one conversation with
equal ``turn`` follow each other by role and turn id; repeated rows are turns
of their own.  A null role or text is empty.  conv_id % 20 has the sign of
conv_id, as in SQL.  An empty table gives an empty result, without a root.
Extra columns are ignored.  Turn ids and heads are 128-bit hashes; equal ids
are taken as equal turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, running_total, stored, word_count

#: turns of a container that is swept in one go
LIMIT = 16_384
#: turns in one sweeping partition, about
PARTITION_TURNS = 1 << 18
#: rows in a bucket of an order, about, and buckets at most
BUCKET_ROWS, MAX_BUCKETS = 100_000, 4_096
WIDTH = 16

NODES = ("conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, end_seq long")


def bucketed(df: DataFrame, order: str, out: str, n_rows: int) -> DataFrame:
    """``out``: a coarse number in the order of the numeric column ``order``."""
    n = min(MAX_BUCKETS, -(-n_rows // BUCKET_ROWS))
    value = F.coalesce(F.col(order).cast("double"), F.lit(-float("inf")))
    if n <= 1:
        return df.withColumn(out, F.lit(0))
    cuts = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 0.25 / n)))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *cuts, float("inf")]
    keyed = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(df.withColumn("_v", value))
    return keyed.withColumn(out, F.col("_b").cast("int")).drop("_v", "_b")


# -- conversations to sequences ------------------------------------------------

def turns_of(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, pos, tid, words) with pos from 0, and the number of rows."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the length tells where the role ends
    tid = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), tid.alias("tid"),
        word_count(text).alias("words"))
    rows = stored(rows, "turns")
    n = rows.count()
    placed = running_total(bucketed(rows, "turn", "_t", n).withColumn("_one", F.lit(1).cast("long")), ["conv_id"], "_t",
                           [F.col("turn").asc_nulls_first(), "role", "tid"], "_one", "pos")
    return stored(placed.select("conv_id", "pos", "tid", "words"), "turns"), n


def borrowed(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> DataFrame:
    """(seq, d, tid, words): the first h turns of conversation c - c % 20, then
    the own ones after the first h."""
    c = F.col("conv_id")
    convs = turns.select("conv_id").distinct().select(
        "conv_id", borrowed(c).alias("h"), (c - c % 20).alias("source"))
    heads = turns.filter("pos < 3").select(c.alias("source"), "pos", "tid", "words")
    # a source lends at most three turns to at most 39 conversations
    lent = convs.filter("h > 0").join(heads, "source").filter("pos < h")
    got = lent.groupBy("conv_id").agg(F.count("*").alias("b"))
    own = (turns.join(convs, "conv_id").filter("pos >= h").join(got, "conv_id", "left")
           .select(c.alias("seq"), (F.coalesce("b", F.lit(0)) + F.col("pos") - F.col("h") + 1).alias("d"),
                   "tid", "words"))
    return own.unionByName(lent.select(c.alias("seq"), (F.col("pos") + 1).alias("d"), "tid", "words"))


# -- the trie ----------------------------------------------------------------------

def distinct_sequences(seqs: DataFrame, turns: DataFrame) -> DataFrame:
    """(seq, rep, len, copies) of all ``seqs``: rep is the smallest equal one."""
    hashed = turns.groupBy("seq").agg(
        F.count("*").alias("len"), F.bit_xor(F.xxhash64("d", "tid")).alias("x"),
        F.bit_xor(F.xxhash64("tid", F.lit(7), "d")).alias("y"))
    all_ = seqs.join(hashed, "seq", "left").na.fill(0, ["len", "x", "y"])
    groups = all_.groupBy("len", "x", "y").agg(F.min("seq").alias("rep"), F.count("*").alias("copies"))
    return all_.join(groups, ["len", "x", "y"]).select("seq", "rep", "len", "copies")


def _sweep(batches):
    """Rows (head, off, up, suffix, words, seq, copies) sorted by head and
    suffix -> NODES and, for the top node of a head, the head itself."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_seq",
             "head"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.binary()]
    out: list[list] = [[] for _ in names]
    # open nodes: [smallest, members, words, children, leaves, saved, end, closed children]
    path: list[list] = []
    head = suffix = None
    off, up = 0, None

    def write(node, depth, parent, of_head):
        for column, value in zip(out, (node[0], depth, parent, node[1], node[3], node[4], node[5], node[6], of_head)):
            column.append(value)

    def close(to):
        """Closes the open nodes below the first ``to``."""
        while len(path) > to:
            node = path.pop()
            if not node[3]:
                node[4] = 1
            node[5] += (node[1] - 1) * node[2]
            for child in node[7]:
                write(child, off + len(path) + 1, node[0], None)
            if path:
                above = path[-1]
                above[0] = min(above[0], node[0])
                above[1] += node[1]
                above[3] += 1
                above[4] += node[4]
                above[5] += node[5]
                node[7] = ()
                above[7].append(node)
            else:
                write(node, off, up, head)

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for h, o, u, s, w, seq, copies, top in zip(*(batch.column(c).to_pylist() for c in (
                "head", "off", "up", "suffix", "words", "seq", "copies", "top_words"))):
            if h != head:
                close(0)
                if len(out[0]) > 10_000:
                    yield flush()
                head, off, up, suffix = h, o, u, b""
                path.append([seq, 0, top, 0, 0, 0, None, []])
            n = len(s) // WIDTH
            same, most = 0, min(n, len(path) - 1)
            while same < most and s[same * WIDTH:(same + 1) * WIDTH] == suffix[same * WIDTH:(same + 1) * WIDTH]:
                same += 1
            close(same + 1)
            for k in range(same, n):
                path.append([seq, 0, w[k], 0, 0, 0, None, []])
            end = path[-1]
            end[0], end[1], end[6], suffix = min(end[0], seq), end[1] + copies, seq, s
    close(0)
    yield flush()


def trie(seqs: DataFrame, turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """NODES of the trie of distinct prefixes: ``seqs`` (seq, copies, len) are
    distinct sequences of ``turns`` (seq, d, tid, words); end_seq is the
    sequence that ends at a node, if any."""
    turns = turns.join(seqs.select("seq"), "seq", "left_semi")
    turns = stored(turns.select("seq", F.col("d").cast("int").alias("d"), "tid", "words"), "turns")
    # members of containers; up is the smallest seq of the node above the head
    live = stored(seqs.select(
        F.lit(b"").alias("head"), F.lit(0).alias("off"), F.lit(None).cast("long").alias("up"),
        F.lit(0).cast("long").alias("top_words"), "seq", "copies", F.col("len").cast("int").alias("len")), "members")
    swept, levels = [], []
    while True:
        size = live.groupBy("head").agg(F.sum(F.col("len") - F.col("off")).alias("_turns"),
                                        F.count("*").alias("_members"), F.sum("copies").alias("_n"),
                                        F.min("seq").alias("_least"))
        large = stored(size.filter(F.col("_turns") > limit), "heads")
        n_large = large.count()
        if not n_large:
            swept.append(live)
            break
        swept.append(live.join(large.select("head"), "head", "left_anti"))
        burst = live.join(large, "head")
        rows = turns.join(burst, "seq").filter("d > off")
        # depths by container: is the turn the same in all members?
        by_depth = rows.groupBy("head", "d").agg(
            F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count("*").alias("c"), F.max("words").alias("words"))
        by_depth = stored(by_depth.join(large.select("head", "_members"), "head").select(
            "head", "d", "words", ((F.col("lo") != F.col("hi")) | (F.col("c") < F.col("_members"))).alias("parts")),
            "depths")
        ends = burst.groupBy("head").agg(F.first("off").alias("off"), F.first("up").alias("up"), F.max("len").alias("_longest"),
                                         F.first("top_words").alias("top_words"))
        parts = by_depth.filter("parts").groupBy("head").agg(F.min("d").alias("_at"))
        # bottom: the deepest node that all members pass
        level = large.join(ends, "head").join(parts, "head", "left").select(
            "head", "off", "up", "top_words", "_n", "_least",
            F.coalesce(F.col("_at") - 1, "_longest").cast("int").alias("bottom"))
        level = stored(level, "level")
        chain = by_depth.join(level.select("head", "bottom"), "head").filter("d <= bottom").select("head", "d", "words")
        members = burst.select("head", "seq", "copies", "len").join(
            level.select("head", "bottom", F.col("_least").alias("up")), "head")
        at_bottom = members.filter("len = bottom").select("head", F.col("seq").alias("end_seq"))
        onward = (members.filter("len > bottom").join(turns, "seq").filter("d = bottom + 1")
                  .select(F.col("head").alias("above"),
                          F.unhex(F.md5(F.concat("head", "tid"))).alias("head"), F.col("d").alias("off"), "up",
                          F.col("words").alias("top_words"), "seq", "copies", "len"))
        onward = stored(onward, "members")
        levels.append((level, stored(chain, "chain"), stored(at_bottom, "ends"),
                       onward.select("above", "head").distinct()))
        live = onward.drop("above")

    todo = swept[0]
    for part in swept[1:]:
        todo = todo.unionByName(part)
    # packed suffixes; an empty one is a sequence that ends at its head
    suffix = (todo.select("head", "off", "seq").join(turns, "seq").filter("d > off").groupBy("seq")
              .agg(F.sort_array(F.collect_list(F.struct("d", "tid", "words"))).alias("s")))
    packed = todo.join(suffix, "seq", "left").select(
        "head", "off", "up", "top_words", "seq", "copies",
        F.coalesce(F.unhex(F.array_join(F.transform("s.tid", lambda t: F.hex(t)), "")), F.lit(b"")).alias("suffix"),
        F.coalesce("s.words", F.array().cast("array<bigint>")).alias("words"))
    n = turns.count()
    parts = max(1, -(-n // PARTITION_TURNS), turns.sparkSession.sparkContext.defaultParallelism)
    nodes = stored(packed.repartition(parts, "head").sortWithinPartitions("head", "suffix")
                   .mapInArrow(_sweep, NODES + ", head binary"), "nodes")
    result = [nodes.drop("head")]
    tops = nodes.filter("head is not null").select("head", "n_leaves", "saved_tokens")
    for level, chain, ends, below in reversed(levels):
        under = below.join(tops, "head").groupBy(F.col("above").alias("head")).agg(
            F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        whole = level.join(under, "head", "left").join(ends, "head", "left").select(
            "head", "off", "up", "top_words", "_n", "_least", "bottom", "end_seq",
            F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("leaves", F.lit(1)).alias("leaves"),
            F.coalesce("saved", F.lit(0)).alias("saved"))
        whole = stored(whole, "level")
        path = chain.unionByName(whole.select("head", F.col("off").alias("d"), F.col("top_words").alias("words")))
        path = path.join(whole.drop("top_words"), "head").withColumn(
            "own", (F.col("_n") - 1) * F.col("words")).withColumn("rise", -F.col("d")).withColumn(
            "step", F.floor(-F.col("d") / BUCKET_ROWS))
        path = running_total(path, ["head"], "step", ["rise"], "own", "deeper")
        last = F.col("d") == F.col("bottom")
        path = stored(path.select(
            F.col("_least").alias("conv_id"), F.col("d").alias("depth"),
            F.when(F.col("d") == F.col("off"), F.col("up")).otherwise(F.col("_least")).alias("parent_conv_id"),
            F.col("_n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("saved") + F.col("deeper") + F.col("own")).cast("long").alias("saved_tokens"),
            F.when(last, F.col("end_seq")).alias("end_seq"),
            F.when(F.col("d") == F.col("off"), F.col("head")).alias("head")), "path")
        result.append(path.drop("head"))
        tops = tops.unionByName(path.filter("head is not null").select("head", "n_leaves", "saved_tokens"))
    out = result[0]
    for part in result[1:]:
        out = out.unionByName(part)
    return out


# -- the ids that end at a node ------------------------------------------------------

def _digests(batches):
    """Rows (rep, bucket, ids) sorted by rep and bucket -> (rep, digest); a
    group passes as a stream."""
    rep = state = None
    for batch in batches:
        reps, digests = [], []
        for r, ids in zip(batch.column("rep"), batch.column("ids")):
            r = r.as_py()
            if r != rep:
                if state is not None:
                    reps.append(rep)
                    digests.append(state.hexdigest())
                rep, state = r, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(digests, pa.string())],
                                         ["rep", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())],
                                         ["rep", "ends_sha256"])


def end_digests(members: DataFrame, n_rows: int) -> DataFrame:
    """(rep, ends_sha256) of ``members`` (rep, seq): SHA-256 of a group's ids in
    order, joined by commas.  Ids are joined per bucket; a group of one bucket
    is hashed where it is, one of many is streamed bucket by bucket."""
    rows = bucketed(members.select("rep", "seq"), "seq", "bucket", n_rows)
    joined = stored(rows.groupBy("rep", "bucket").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("ids")),
        "ids")
    count = joined.groupBy("rep").agg(F.count("*").alias("_n"), F.first("ids").alias("ids"))
    short = count.filter("_n = 1").select("rep", F.sha2("ids", 256).alias("ends_sha256"))
    many = joined.join(count.filter("_n > 1").select("rep"), "rep")
    long = (many.select("rep", "bucket", "ids").repartition("rep").sortWithinPartitions("rep", "bucket")
            .mapInArrow(_digests, "rep long, ends_sha256 string"))
    return short.unionByName(long)


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    turns, n = turns_of(conversations)
    seqs = turns.select(F.col("conv_id").alias("seq")).distinct()
    rows = stored(rebuilt(turns), "rebuilt")
    groups = stored(distinct_sequences(seqs, rows), "sequences")
    reps = groups.filter("seq = rep").select("seq", "copies", "len")
    nodes = trie(reps, rows, limit)
    ends = end_digests(groups, n).select(F.col("rep").alias("end_seq"), "ends_sha256")
    return nodes.join(ends, "end_seq", "left")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie(read_table(spark, sf_dir, "conversations"))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, pos, tid,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM t),
bits AS (
  -- crc32 of the decimal id, a bit a step
  SELECT DISTINCT conv_id AS c, conv_id::varchar AS s, 0 AS k, 4294967295::bigint AS v FROM own
  UNION ALL
  SELECT c, s, k + 1,
         CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, (k // 8 + 1)::int, 1))::bigint) ELSE v END AS w
        FROM bits WHERE k < 8 * length(s))),
convs AS (
  SELECT c, c - c % 20 AS source, xor(v, 4294967295) % 4 AS h FROM bits WHERE k = 8 * length(s)),
lent AS (
  SELECT c AS seq, pos + 1 AS d, tid, words FROM convs JOIN own ON own.conv_id = source WHERE pos < h),
borrowed AS (SELECT seq, count(*) AS b FROM lent GROUP BY seq),
rebuilt AS (
  SELECT * FROM lent UNION ALL
  SELECT c, coalesce(b, 0) + pos - h + 1, tid, words
  FROM own JOIN convs ON c = conv_id LEFT JOIN borrowed ON seq = c WHERE pos >= h),
prefixes AS (
  SELECT seq, d, words, md5(string_agg(tid, '') OVER (PARTITION BY seq ORDER BY d)) AS key FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lengths AS (SELECT seq, max(d) AS n FROM prefixes GROUP BY seq),
nodes AS (
  SELECT key, d AS depth, min(seq) AS conv_id, count(*) AS n_convs, max(words) AS words,
         coalesce(string_agg(CASE WHEN n = d THEN seq::varchar END, ',' ORDER BY seq), '') AS ends
  FROM prefixes JOIN lengths USING (seq) GROUP BY key, d),
up AS (
  SELECT nodes.key, p.key AS parent FROM nodes
  JOIN prefixes p ON p.seq = nodes.conv_id AND p.d = nodes.depth - 1),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent),
below AS (
  SELECT p.key, count(*) FILTER (WHERE kids.key IS NULL) AS n_leaves,
         sum((nodes.n_convs - 1) * nodes.words) AS saved_tokens
  FROM nodes LEFT JOIN kids USING (key)
  JOIN prefixes p ON p.seq = nodes.conv_id AND p.d <= nodes.depth GROUP BY p.key)
SELECT n.conv_id, n.depth::bigint AS depth, parent.conv_id AS parent_conv_id, n.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::bigint AS saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below USING (key) LEFT JOIN kids USING (key)
LEFT JOIN up USING (key) LEFT JOIN nodes parent ON parent.key = up.parent
"""
