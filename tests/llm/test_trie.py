import hashlib
import random
import zlib

import pytest

from tests.llm import cases
from vocalis.llm import prefix_trie

DDL = "conv_id long, turn long, role string, text string"


def words(text):
    return len((text or "").encode().split())


def trie_by_hand(rows):
    """Every prefix of every rebuilt conversation as a node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    def tid(t):
        return hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:3], tid(t)))] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        source = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(source, [])[:h] + ts[h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            n = nodes.setdefault(s[:d], {"members": [], "ends": []})
            n["members"].append(c)
            if d == len(s):
                n["ends"].append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def total(k):
        leaves, saved = (0 if kids.get(k) else 1), (len(nodes[k]["members"]) - 1) * (words(k[-1][1]) if k else 0)
        for child in kids.get(k, []):
            a, b = total(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved
    out = []
    for k, n in nodes.items():
        leaves, saved = total(k)
        out.append((min(n["members"]), len(k), min(nodes[k[:-1]]["members"]) if k else None, len(n["members"]),
                    len(kids.get(k, [])), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=3):
    rng = random.Random(seed)
    turns = [("user", "hello there"), ("assistant", "hi"), ("user", ""), ("user", None), (None, "no role"),
             ("system", "be kind to all"), ("a", "bc"), ("ab", "c")]
    rows = []
    for c in [*range(0, 45), *rng.sample(range(60, 4_000), 60), -7, -20, -39, 2**61 + 3]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, *turns[rng.randrange(len(turns) if t else 2)]))
    for c in (5_000, 5_001, 5_019, 5_020, 5_040, 5_041):                 # copies
        rows += [(c, t, "user", f"turn {t // 3}") for t in range(9)]
    shared = [(t, "user", f"shared {t}") for t in range(70)]             # long common starts
    for c in (6_000, 6_020, 6_040, 6_060):
        rows += [(c, *t) for t in shared] + [(c, 70, "user", f"own {c % 40}"), (c, 71, "user", f"last {c}")]
    rows += [(c, *t) for c in (6_080, 6_100) for t in shared[:60 - c % 80]]
    rows += [(7_000, None, "user", "first"), (7_000, 0, "user", "second"), (7_000, 0, "user", "b"), (7_000, 0, "user", "b"),
             (None, 1, "user", "nobody"), (7_020, None, None, None)]
    return rows


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trie")
    df = cases.clashing(spark.createDataFrame(conversations(), DDL)).withColumn("seq", prefix_trie.F.lit("x")) \
        .withColumn("head", prefix_trie.F.lit("x")).repartition(4)
    df.write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("limit, buckets", [(16_384, 100_000), (40, 7)])
def test_nodes_are_the_brute_force(spark, table, monkeypatch, limit, buckets):
    monkeypatch.setattr(prefix_trie, "LIMIT", limit)
    monkeypatch.setattr(prefix_trie.conversation_trie, "__defaults__", (limit,))
    monkeypatch.setattr(prefix_trie, "BUCKET_ROWS", buckets)
    got = prefix_trie.op12_prefix_trie(spark, table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert all(t == ("ends_sha256", "string") or t[1] == "bigint" for t in got.dtypes)
    assert read(got) == trie_by_hand(conversations())


def test_every_container_bursts(spark):
    rows = [r for r in conversations() if r[0] is not None and r[0] % 20 < 4 and r[0] < 5_000]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, DDL), limit=1).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    assert read(got) == sorted((r[:7] for r in trie_by_hand(rows)), key=repr)


def test_one_conversation_and_none(spark):
    rows = [(3, t, "user", "same words") for t in range(50)]
    df = spark.createDataFrame(rows, DDL)
    got = prefix_trie.conversation_trie(df, limit=4)
    assert got.count() == len({r[1] for r in trie_by_hand(rows)}) == got.select("depth").distinct().count()
    assert prefix_trie.conversation_trie(df.filter("conv_id > 9")).count() == 0


def test_sequences_of_any_table(spark):
    turns = spark.createDataFrame([(1, 1, b"a" * 16, 2), (2, 1, b"a" * 16, 2), (2, 2, b"b" * 16, 5)],
                                  "seq long, d long, tid binary, words long")
    seqs = spark.createDataFrame([(1, 3, 1), (2, 1, 2)], "seq long, copies long, len long")
    got = sorted(tuple(r) for r in prefix_trie.trie(seqs, turns).select(
        "depth", "conv_id", "n_convs", "saved_tokens", "end_seq").collect())
    assert got == [(0, 1, 4, 6, None), (1, 1, 4, 6, 1), (2, 2, 1, 0, 2)]
