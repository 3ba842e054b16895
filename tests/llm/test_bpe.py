import random

import numpy as np
import pytest

from tests.llm import cases
from vocalis.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(bpe.default_path())


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def texts():
    rng = random.Random(5)
    out = ["", " ", "<|endoftext|>", "a<|endoftext|> b<|endof", "  x  \n\n  y", "don't we're I'LL 'tis 'r", "a" * 400,
           " " * 900, "\n\n\n a", "é" * 700, "1234567890" * 100, "!?" * 500, "日本語テキスト" * 50, "x" * 3000 + "'re",
           "​　\xa0 x", "🙂🙂 é"]
    for _ in range(120):
        a = rng.choice(["ab", "the", "etaoin shrdlu", "aA '", "0123", "!?.,-", "éèa", " \n\t", "abcdefghijklmnopqrstuvwxyz"])
        out.append("".join(rng.choice(a) for _ in range(rng.randrange(1500))))
    words = "antidisestablishment tionoui reée schkeit mente the and of ing".split()
    out += ["".join(rng.choice(words) for _ in range(300)) for _ in range(10)]
    return out


def test_batches_encode_like_the_library(tables, reference):
    e = bpe.Encoder(tables)
    ids, at = e.encode_batch(texts())
    for k, t in enumerate(texts()):
        assert ids[at[k]:at[k + 1]].tolist() == reference.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("step", [1, 7, 100, 1000])
def test_chunks_encode_like_the_whole(tables, reference, monkeypatch, step):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    e = bpe.Encoder(tables)
    for t in texts() if step > 1 else texts()[:40]:
        out = []
        for i in range(0, len(t), step):
            out += e.feed(t[i:i + step])
        assert out + e.finish() == reference.encode(t, add_special_tokens=False).ids


def test_memory_stays_bounded(tables):
    e = bpe.Encoder(tables)
    most = 0
    for _ in range(40):
        e.feed("abcd" * 10_000)
        most = max(most, len(e.buffer) + len(e.tail))
    e.finish()
    assert most < 4 * bpe.CHUNK


def test_lookahead_is_needed_and_enough_for_small_merge_lists():
    """All texts over two letters: a token followed by `lookahead` bytes never changes."""
    import itertools
    import numpy as np
    rng = random.Random(3)
    for _ in range(30):
        made, pairs = [b"a", b"b"], []
        while len(pairs) < 4:
            x, y = rng.randrange(len(made)), rng.randrange(len(made))
            if made[x] + made[y] not in made and len(made[x] + made[y]) <= 4:
                pairs.append((x, y, len(made)))
                made.append(made[x] + made[y])
        t = bpe.Tables.__new__(bpe.Tables)
        t.left, t.right, t.made = (np.array(c, np.int64) for c in zip(*pairs))
        t.lengths = np.array([len(m) for m in made], np.int64)
        t.byte_id = np.zeros(256, np.int64)
        t.byte_id[ord("b")] = 1
        ahead = bpe.sufficient_lookahead(t.left, t.right, t.made, t.lengths)
        ranks = {(a, b): i for i, (a, b, _) in enumerate(pairs)}
        for head in itertools.product(b"ab", repeat=7):
            first = bpe.merge_long(bytes(head), t, ranks)
            for tail in itertools.product(b"ab", repeat=3):
                more = bpe.merge_long(bytes(head + tail), t, ranks)
                end = 0
                for x, y in zip(first, more):
                    end += t.lengths[x]
                    if end + ahead > len(head):
                        break
                    assert x == y


def test_decoder_is_incremental(tables, reference):
    rng = random.Random(7)
    d = bpe.Decoder(tables)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(30)]
        out = "".join(d.feed([i]) for i in ids) + d.finish()
        assert out == reference.decode(ids, skip_special_tokens=False)
    assert d.feed([10**7, -1]) + d.finish() == ""


def test_columns_round_trip(spark, reference):
    docs = cases.clashing(cases.frame(spark)).drop("ids")
    codec = bpe.Codec(spark, bpe.default_path())
    got = bpe.encoded(docs)
    for r in got.withColumn("back", codec.decode(got["ids"])).collect():
        assert r.ids == reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.back == (r.text or "") and r.n_tokens == len(r.ids)
    both = codec.round_trip(docs, keep=("doc_id", "text", "score")).collect()
    assert len(both) == docs.count() and all(x.decoded == (x.text or "") and x.score == 1 for x in both)
    assert all(x.ids == reference.encode(x.text or "", add_special_tokens=False).ids for x in both)
    assert bpe.encoded(cases.frame(spark, [])).count() == 0


def test_pair_ranks_find_and_rule_out(tables):
    keys = list(zip(tables.left.tolist(), tables.right.tolist()))
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    rng = random.Random(3)
    asked = keys[::97] + [(b, a) for a, b in keys[::89]] + [(rng.randrange(60_000), rng.randrange(60_000)) for _ in range(3_000)]
    left, right = (np.array(x, np.int64) for x in zip(*asked))
    assert tables.pairs.of(left, right).tolist() == [first.get(k, len(keys)) for k in asked]


def test_frequent_pieces_stay_when_the_table_is_full(tables, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 60)
    e, whole = bpe.Encoder(tables), bpe.Encoder(tables)
    rng = random.Random(5)
    for k in range(30):
        text = " ".join(["always", "the", "same"] + [f"word{rng.randrange(10_000)}x{k}" for _ in range(40)])
        ids, _ = e.encode_batch([text])
        assert ids.tolist() == whole.encode(text)
        assert " same" in e.known.number and len(e.known.number) < 60 + 500
    assert len(whole.known.number) <= 60 + 500


def test_long_texts_in_a_batch_while_the_table_starts_over(tables, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    monkeypatch.setattr(bpe, "CHUNK", 400)
    rng = random.Random(8)
    e = bpe.Encoder(tables)
    for _ in range(6):
        batch = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (20, 900, 30, 700, 5, 0)]
        ids, ends = e.encode_batch(batch)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [
            reference.encode(t, add_special_tokens=False).ids for t in batch]
