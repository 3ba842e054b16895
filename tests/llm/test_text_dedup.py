import collections
import hashlib

import pytest

from tests.llm import cases
from vocalis.llm import groups, jaccard_join, substring_dedup


@pytest.fixture(autouse=True)
def small_groups(monkeypatch):
    monkeypatch.setattr(groups, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(groups, "BUCKET_HASHES", 5_000)
    monkeypatch.setattr(jaccard_join, "LIST_PART", 3)


def removed_by_hand(data, width):
    seen = {}
    for d, t, *_ in data:
        w = cases.words_of(t)
        for a in range(len(w) - width + 1):
            k = tuple(w[a:a + width])
            if d is not None:
                seen[k] = min(seen.get(k, d), d)
    out = []
    for d, t, *_ in data:
        w = cases.words_of(t)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            first = seen.get(tuple(w[a:a + width]))
            if first is not None and (d is None or first < d):
                gone[a:a + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [50, 3])
def test_substring_dedup_is_the_brute_force(spark, width):
    data = cases.rows()
    got = substring_dedup.remove_repeats(cases.clashing(cases.frame(spark, data)), width)
    rows = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest())
            for r in got.collect()]
    assert sorted(rows, key=repr) == removed_by_hand(data, width)


def test_ranges_in_equal_steps_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_RANGES", 2)
    data = cases.rows()
    got = substring_dedup.remove_repeats(cases.frame(spark, data), 3)
    rows = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest())
            for r in got.collect()]
    assert sorted(rows, key=repr) == removed_by_hand(data, 3)


def test_removed_intervals_are_maximal(spark):
    got = substring_dedup.remove_repeats(cases.frame(spark)).collect()
    for r in got:
        assert sum(s.end - s.first for s in r.removed) == r.n_removed
        assert all(a.end < b.first for a, b in zip(r.removed, r.removed[1:]))


def test_empty_tables(spark):
    none = cases.frame(spark, [])
    assert substring_dedup.remove_repeats(none).count() == 0
    assert jaccard_join.link(none).count() == 0


def components_by_hand(data):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for d, t, *_ in data:
        w = [x.translate(fold) for x in cases.words_of(t)]
        sets.append({tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5
                    else ({tuple(w)} if w else set()))
    up = list(range(len(data)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (x, a) in enumerate(zip(data, sets)):
        for j, (y, b) in enumerate(zip(data[:i], sets)):
            if x[0] is None or y[0] is None:
                continue
            near = a and b and 100 * len(a & b) >= 75 * len(a | b)
            if near or x[0] == y[0]:
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    least = collections.defaultdict(list)
    for i, (d, *_) in enumerate(data):
        if d is not None:
            least[find(i)].append(d)
    return sorted([(d, len(s), min(least[find(i)]) if d is not None else None)
                   for i, ((d, *_), s) in enumerate(zip(data, sets))], key=repr)


def test_jaccard_join_is_the_brute_force(spark):
    data = cases.rows()
    got = jaccard_join.link(cases.clashing(cases.frame(spark, data)))
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    assert sorted(rows, key=repr) == components_by_hand(data)


def test_links_that_no_leader_has(spark):
    """A chain: neighbours link, ends do not, so answers go beyond the leaders."""
    import random
    rng = random.Random(8)
    text = cases.sentence(rng, 80, 10_000).split()
    data = []
    for i in range(9):
        data.append((100 - i, " ".join(text), "en", "a", 1))
        text = text[5:] + cases.sentence(rng, 5, 10_000).split()
    got = jaccard_join.link(cases.frame(spark, data)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == components_by_hand(data)
    assert {r.component_id for r in got} == {92}


def test_keep_first_keeps_one_of_each_group(spark):
    docs = cases.frame(spark)
    kept = [r.doc_id for r in jaccard_join.keep_first(docs).collect()]
    assert 0 in kept and 20 not in kept and 21 not in kept and 23 not in kept and 40 in kept
    assert jaccard_join.keep_first(docs).columns == docs.columns


def test_block_pairs_skip_only_what_cannot_reach():
    import numpy as np
    rng = np.random.default_rng(0)
    n = rng.integers(1, 30, 60)
    pos = rng.integers(0, 30, 60) % n
    of, a, b = jaccard_join.block_pairs(n, pos, 75)
    listed = set(zip(a.tolist(), b.tolist()))
    for i in range(60):
        for j in range(60):
            most = 1 + min(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
            possible = 100 * most >= 75 * (n[i] + n[j] - most)
            k = tuple(sorted((of[i], of[j])))
            assert not possible or k in listed
