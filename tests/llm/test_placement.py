"""Sharding and mixing."""

import collections
import math
import zlib

import pytest

from tests.llm import cases
from vocalis.llm import mixing, sharding


def test_shards_are_even_and_slots_gapless(spark):
    data = cases.rows()
    got = sharding.shard(cases.clashing(cases.frame(spark, data)), shards=5, virtual=8).collect()
    assert len(got) == len(data)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == want


def test_equal_runs_agree(spark):
    docs = cases.frame(spark)
    a = sharding.shard(docs).collect()
    b = sharding.shard(docs.repartition(7)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_bounded_bytes(spark):
    data = [(i, "x" * (i % 97), "en", "a", 1) for i in range(4000)]
    got = sharding.shard(cases.frame(spark, data), shards=8, load="bytes", epsilon=0.05).collect()
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8 + 97 * 64


def test_overflow_goes_clockwise_one_key_at_a_time():
    """Cutting arcs equals placing the keys one by one, round by round."""
    points = sharding.ring(4, 5)
    loads = {a: (a * 7) % 5 for a in range(len(points))}
    whole = sum(loads.values())
    bounds = [whole // 4 + (s < whole % 4) for s in range(4)]
    cuts = sharding.cut_arcs(loads, points, bounds)
    room, placed = list(bounds), {}
    for r in range(4):
        for arc in sorted(loads):
            walk = list(dict.fromkeys(points[(arc + k) % len(points)][1] for k in range(len(points))))
            for key in range(loads[arc]):
                if (arc, key) not in placed and room[walk[r]]:
                    placed[arc, key] = walk[r]
                    room[walk[r]] -= 1
    assert {(a, k): s for a, lo, hi, s in cuts for k in range(lo, hi)} == placed
    assert len(placed) == whole


def test_few_rows_move_when_a_shard_is_added(spark):
    data = [(i, "t", "en", "a", 1) for i in range(3000)]
    docs = cases.frame(spark, data)
    before = {r.doc_id: r.shard for r in sharding.shard(docs, shards=10).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard(docs, shards=11).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.5 * len(before)


def test_sharding_an_empty_table(spark):
    assert sharding.shard(cases.frame(spark, [])).count() == 0


# ------------------------------------------------------------------------ mixing
def targets_by_hand(sizes, share=1.5, weights=(5, 2, 1), cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, capped, left = {}, {}, dict(weight)
    words = share * sum(sizes.values())
    while True:
        rest = words - sum(capped.values())
        goal = {s: rest * w / sum(left.values()) for s, w in left.items()} if left else {}
        above = [s for s in goal if goal[s] > cap * sizes[s]]
        if not above:
            return {**capped, **goal}
        for s in above:
            capped[s] = cap * sizes[s]
            del left[s]


def test_mix_meets_its_targets(spark):
    data = cases.rows()
    made = mixing.mix(cases.clashing(cases.frame(spark, data)), block_words=64)
    got = made.taken().collect()
    assert len(got) == len(data)
    sizes = collections.Counter()
    for d, t, _, s, _ in data:
        sizes[s] += len(cases.words_of(t))
    want = targets_by_hand(sizes)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_schedule_is_a_permutation_and_spread_evenly(spark):
    data = [(i, cases.sentence(__import__("random").Random(i), 200), "en", "abc"[i % 3], 1)
            for i in range(90)]
    made = mixing.mix(cases.frame(spark, data), block_words=50)
    slots = made.schedule.orderBy("slot").collect()
    assert [s.slot for s in slots] == list(range(len(slots)))
    share = collections.Counter(s.source_no for s in slots)
    for half in (slots[:len(slots) // 2], slots[len(slots) // 2:]):
        seen = collections.Counter(s.source_no for s in half)
        assert all(abs(seen[k] - share[k] / 2) <= 2 + 2 * math.log(len(slots)) / 2 for k in share)
    for k in share:
        assert [s.block for s in slots if s.source_no == k] == list(range(share[k]))
    # each slot's pieces fill its block
    filled = collections.Counter()
    for p in made.pieces.collect():
        filled[p.source_no, p.block] += p.n_words
    assert all(v <= 50 for v in filled.values())
    assert sum(v == 50 for v in filled.values()) >= len(filled) - 3


def test_mixed_documents_carry_the_words_taken(spark):
    data = cases.rows()
    docs = cases.frame(spark, data)
    rows = mixing.mixed_documents(docs, block_words=64)
    assert rows.columns == docs.columns
    got = collections.Counter()
    for r in rows.collect():
        got[r.source] += len(cases.words_of(r.text))
    want = collections.Counter()
    for r in mixing.mix(docs, block_words=64).taken().collect():
        want[r.source] += r.taken
    assert +got == +want


def sequential_schedule(blocks):
    """(source, block) of every slot, one slot after the other."""
    m = sum(blocks.values())
    a = max(1, round(m * (math.sqrt(5) - 1) / 2))
    while math.gcd(a, m) != 1:
        a += 1
    ends, out, seen = [], [], collections.Counter()
    for s in sorted(blocks):
        ends.append(((ends[-1][0] if ends else 0) + blocks[s], s))
    for i in range(m):
        s = next(s for end, s in ends if i * a % m < end)
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def test_rows_leave_in_the_order_of_a_sequential_schedule(spark):
    """Slots, the first slot of every document and the order of the mixed rows
    against a walk through the schedule that fills one slot at a time."""
    rng = __import__("random").Random(5)
    data = [(i, cases.sentence(rng, rng.choice([0, 3, 40, 300])), "en", "abcd"[i % 7 % 4], 1)
            for i in range(120)]
    docs, size = cases.frame(spark, data), 64
    made = mixing.mix(docs, block_words=size)
    streams, take = collections.defaultdict(list), {}
    for r in made.rows.orderBy("source_no", "start").collect():
        if r["size"]:
            streams[r.source_no].append(r)
        take[r.source_no] = math.floor(r.target + 0.5)
    schedule = sequential_schedule({s: -(-t // size) for s, t in take.items()})
    assert [(r.source_no, r.block) for r in made.schedule.orderBy("slot").collect()] == schedule
    order, first, given = [], {}, set()
    for slot, (s, block) in enumerate(schedule):
        position = 0
        for epoch in (0, 1):
            for r in streams[s]:
                lo, hi = position, min(position + r["size"], take[s])
                position += r["size"]
                if max(lo, block * size) < min(hi, (block + 1) * size):
                    first.setdefault(r.doc_id, slot)
                    if (r.doc_id, epoch) not in given:
                        given.add((r.doc_id, epoch))
                        order.append((r.doc_id, slot))
    assert {r.doc_id: r.first_slot for r in made.taken().collect() if r.taken} == first
    rows = mixing.mixed_documents(docs, slot_column="at", block_words=size).collect()
    wordless = {d for d, t, *_ in data if not cases.words_of(t)}
    assert [(r.doc_id, r["at"]) for r in rows if r["at"] is not None] == order
    assert sorted(r.doc_id for r in rows if r["at"] is None) == sorted(wordless)
    assert all(r["at"] is None for r in rows[len(order):])


def test_rows_without_words_stay_once(spark):
    data = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t", "en", "a", 2), (None, None, None, None, 0),
            (2, "", "en", None, 0), (5, "one two three", "en", "a", 13)]
    got = mixing.mixed_documents(cases.clashing(cases.frame(spark, data))).collect()
    assert sorted(repr(r.doc_id) for r in got if not cases.words_of(r.text)) == ["1", "2", "2", "3", "None"]


def test_mixing_empty_tables(spark):
    assert mixing.mixed_documents(cases.frame(spark, [])).count() == 0
    assert mixing.mix(cases.frame(spark, [])).taken().count() == 0
    bare = mixing.mix(cases.frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).taken()
    assert [(r.size, r.target, r.taken) for r in bare.collect()] == [(0, 0.0, 0)] * 2
