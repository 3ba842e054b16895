import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import cases
from vocalis.llm import periodic_runs


def runs_by_hand(w, min_words=6, min_power=4):
    """Every stretch by every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // min_power + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_power * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def looped_by_hand(doc_id, text):
    w = cases.words_of(text)
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def row_by_hand(doc_id, text):
    w = looped_by_hand(doc_id, text)
    runs = runs_by_hand(w) if len(w) < 2_000 else None
    if runs is None:
        return None
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
            hashlib.sha256("".join(f"{i},{n},{q}\n" for i, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def test_pairs_are_the_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(50))]
            p = rng.randrange(1, 8)
            if w:
                w += [w[-1 - (-i) % min(p, len(w))] for i in range(rng.randrange(50))] + [0] * rng.randrange(5)
            texts.append(w)
        first = np.cumsum([0] + [len(w) for w in texts])
        h = np.array([x for w in texts for x in w], np.uint64)
        words, power = rng.choice([(6, 4), (6, 3), (1, 3), (9, 5)])
        got = periodic_runs.runs_of_batch(h, first, words, power)
        for d, w in enumerate(texts):
            assert got.get(d, []) == runs_by_hand(w, words, power)


def test_positions_stay_in_order_across_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PART", 2)
    rng = random.Random(2)
    numbers = rng.sample(range(500), 120)
    p = periodic_runs.Positions(numbers[0])
    for k, x in enumerate(numbers[1:], 1):
        have = sorted(numbers[:k])
        before, after = p.around(x)
        assert before == max((y for y in have if y < x), default=-1)
        assert after == min((y for y in have if y > x), default=-1)
        p.add(x)
    assert list(p) == sorted(numbers) and p.size == len(numbers)


def planted():
    rng = random.Random(9)
    out = [(100 + i, "a b c " * i + "d") for i in range(8)]
    out += [(200, "x " * 300), (201, ("x " * 9 + "y ") * 12), (202, "u v " * 4 + "u v " * 4 + "w u v u v u v"),
            (203, "a a a a a b b b b b b " * 5), (-7, "k l m " * 6)]
    out += [(300 + i, cases.sentence(rng, 20 + i)) for i in range(60)]          # some of them are looped
    return [(d, t, None, None, 0) for d, t in out]


@pytest.mark.parametrize("bytes_", [4 << 20, 700])
def test_query_columns_are_the_brute_force(spark, tmp_path, monkeypatch, bytes_):
    monkeypatch.setattr(periodic_runs, "BATCH_BYTES", bytes_)
    data = [r for r in cases.rows() if len(cases.words_of(r[1])) < 2_000] + planted()
    docs = cases.clashing(cases.frame(spark, data)).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    expected = [row_by_hand(d, t) for d, t, *_ in data]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_runs_and_collapsed_text_for_any_table(spark):
    df = spark.createDataFrame([(1, "so so so so so so so good"), (2, None), (3, "")], "doc_id long, body string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(df, "body").collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 7, 1)] and got[1].collapsed == "so good"
    assert got[2].n_words == got[3].n_words == 0 and got[2].collapsed == got[3].collapsed == ""
    empty = periodic_runs.find_runs(df.filter("doc_id > 9"), "body")
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, "body", min_power=2)


def test_long_periodic_texts_take_time_in_proportion():
    def seconds(n, period):
        began = time.process_time()
        h = np.arange(n, dtype=np.uint64) % np.uint64(period)
        got = periodic_runs.runs_of_batch(h, np.array([0, n]))
        assert got == {0: [(0, n, period)]}
        return time.process_time() - began
    for period in (1, 9):
        assert seconds(80_000, period) < 12 * max(seconds(10_000, period), 0.1)
