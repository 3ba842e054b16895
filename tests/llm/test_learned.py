"""Language identification and toxicity: learned operators."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from vocalis.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ language models
def kneser_ney(words, order, discount=langid.DISCOUNT):
    """Interpolated Kneser-Ney from its definition, over dictionaries."""
    grams = {}
    for w in words:
        p = langid.START * (order - 1) + w + langid.END
        for i in range(len(p) - order + 1):
            g = p[i:i + order]
            grams[g] = grams.get(g, 0) + 1
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        low = {}
        for g in levels[k + 1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        levels[k] = low

    def p(g, floor):
        k = len(g)
        if k == 0:
            return floor
        own = {x: n for x, n in levels[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:], floor)
        total = sum(own.values())
        return (max(own.get(g, 0) - discount, 0) + discount * len(own) * p(g[1:], floor)) / total
    return p


def test_model_is_interpolated_kneser_ney(spark):
    data = [(i, t, l, "a", 0) for i, (t, l) in enumerate(
        [("abra kadabra abrakad", "x"), ("banana bandana", "x"), ("zebra abba", "y"), (None, "x"), ("q", None)])]
    model = langid.build(cases.frame(spark, data))
    assert model.langs == ["x", "y"]
    alphabet = len({c for c in "abrakdnz" + "e"} | {langid.END})
    p = {"x": kneser_ney("abra kadabra abrakad banana bandana".split(), langid.ORDER),
         "y": kneser_ney("zebra abba".split(), langid.ORDER)}
    for w in ("abra", "zebra", "qux", "ban"):
        padded = langid.START * (langid.ORDER - 1) + w + langid.END
        want = [sum(math.log(p[l](padded[i:i + langid.ORDER], 1 / (alphabet + 1)))
                    for i in range(len(w) + 1)) for l in model.langs]
        assert model.word_logp([w])[0] == pytest.approx(want, rel=1e-4)


def many_words(n=12_000):
    rng = random.Random(3)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(6, 10))) for _ in range(n)]


def test_every_ngram_counts(spark):
    words = many_words()
    data = [(i, " ".join(words[i::40]), "x", "a", 0) for i in range(40)] + [(99, "zebra abba", "y", "a", 0)]
    model = langid.build(cases.frame(spark, data))
    grams = {p[i:i + langid.ORDER] for w in words for p in [langid.START * (langid.ORDER - 1) + w + langid.END]
             for i in range(len(p) - langid.ORDER + 1)}
    assert len(grams) > 60_000 and len(model.keys[-1]) >= len(grams)
    p, size = kneser_ney(words, langid.ORDER), 27 + 1
    for w in (words[0], words[-1]):
        padded = langid.START * (langid.ORDER - 1) + w + langid.END
        want = sum(math.log(p(padded[i:i + langid.ORDER], 1 / size)) for i in range(len(w) + 1))
        assert model.word_logp([w])[0][0] == pytest.approx(want, rel=1e-4)


def test_model_as_tables_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    odd = [(-1, None, None), (-2, "en", ""), (-3, "en", "12 34"), (None, "zz", "qux \u65e5\u672c \u0436"),
           (-4, "de", "the " * 3000), (-4, "de", "the " * 3000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = []
    for cells in (langid.BROADCAST_CELLS, 0):
        monkeypatch.setattr(langid, "BROADCAST_CELLS", cells)
        model = langid.train(docs)
        assert isinstance(model, langid.Tables if cells == 0 else langid.Model)
        rows = langid.identify(docs, model).collect()
        got.append(sorted((str(r.doc_id), r.text or "", r.lang_pred, r.accepted, r.score) for r in rows))
    assert len(got[0]) == len(got[1]) == docs.count()
    for a, b in zip(*got):
        assert a[:3] == b[:3] and a[4] == pytest.approx(b[4], rel=1e-4, abs=1e-6)
    assert np.mean([a[3] == b[3] for a, b in zip(*got)]) > 0.99      # a score may lie on the threshold


def test_all_training_documents_are_counted(spark):
    of = lambda i: zlib.crc32(str(i).encode()) % 4
    rare = [i for i in range(400) if of(i) == 3][:6]
    data = [(i, "rare xylo wyrd" if i in rare else "the and of with", "rr" if i in rare else "en", "a", 0)
            for i in range(400)]
    docs = cases.frame(spark, data)
    model = langid.train(docs)
    assert model.langs == ["en", "rr"] and model.temperature > 0
    whole = langid.build(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != langid.HELD_OUT))
    for w in ("wyrd", "with", "xen"):
        assert model.word_logp([w])[0] == pytest.approx(whole.word_logp([w])[0], rel=1e-6)
    got = langid.identify(cases.frame(spark, [(1000, "xylo wyrd", None, "a", 0)]), model).first()
    assert got.lang_pred == "rr"


def test_held_out_languages_are_found(spark):
    from vocalis.llm.catalog import QUERIES
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_langid"](spark, SF).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_undetermined(spark):
    data = [(i, f"{'der die das und' if i % 2 else 'the and of with'} wort{i}", "de" if i % 2 else "en", "a", 0)
            for i in range(60)]
    model = langid.train(cases.frame(spark, data))
    odd = [(100, None), (101, ""), (102, "12 34 \u00bd \u00b2 !?"), (103, "the " * 30_000), (104, "x" * 100_000), (104, "und")]
    got = langid.identify(cases.frame(spark, [(i, t, "zz", "a", 0) for i, t in odd]), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (100, 101, 102)] == ["und"] * 3
    assert all(r.lang_pred in ("de", "en") for r in got if r.doc_id in (103, 104))
    assert langid.train(cases.frame(spark, [])) is None
    none = langid.identify(cases.frame(spark, [(1, "text", "en", "a", 0)]), None).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


# ------------------------------------------------------------------------ toxicity
def test_folding():
    assert toxicity.folded_words("1D10T! ѕсum lo$er 5TUP1D ｃｌｏｗｎ") == ["idiot", "scum", "loser", "stupid", "clown"]
    assert toxicity.folded_words(None) == toxicity.folded_words(" \n") == []


def test_longest_entry_counts_and_exceptions_hide_hits():
    lex = toxicity.Lexicon({"clown": 2.0, "clow*": 1.0, "idio*": 3.0}, ["clown fish"])
    a = lex.automaton()
    hits = lambda t: toxicity.weighted_hits(toxicity.folded_words(t), a)[0]
    assert hits("a clown") == 2.0 and hits("clowns") == 1.0 and hits("idiots idiocy") == 6.0
    assert hits("a clown fish and a clown") == 2.0 and hits("disclown") == 0.0
    assert hits("clown " * 1000) == 2000.0


def test_held_out_toxic_documents_are_found(spark):
    from vocalis.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    held = [i for i in truth if got[i].held_out]
    toxic = [i for i in held if truth[i]]
    found = [i for i in held if got[i].predicted]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted for i in toxic]) >= 0.85
    assert np.mean([truth[i] for i in found]) >= 0.9


def labelled(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        docs.append((i, cases.sentence(rng, 30) + (" you moron" * 3 if bad else ""), "en", "a", 0))
        labels.append((i, 1, int(bad)))
    return (cases.frame(spark, docs + [(900, None, "en", "a", 0), (901, "", None, None, 0)]),
            spark.createDataFrame(labels + [(900, None, None), (None, 1, 1), (3, 0, 0)],
                                  "doc_id long, quality int, toxic int"))


def test_rejecting_keeps_clean_documents(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert "moron" in lexicon.entries
    wide = cases.clashing(docs)
    kept = toxicity.reject(wide, lexicon)
    assert kept.columns == wide.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 5} | {900, 901}


def test_fits_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 20)
    none = labels.filter("doc_id < 0")
    lexicon = toxicity.fit(docs.select("doc_id", "text"), none)
    assert not lexicon.entries
    got = docs.select(toxicity.score(docs["text"], lexicon).alias("s")).collect()
    assert all(r.s < 1e-6 for r in got)
    empty = docs.filter("doc_id < 0")
    assert toxicity.fit(empty.select("doc_id", "text"), none).entries == {}
    assert toxicity.reject(empty, lexicon).count() == 0


def test_language_threshold_comes_from_all_training_documents(spark, monkeypatch):
    """Temperature and threshold are those that numpy finds from every training
    document, scored by the model of the other half; more rows than the former
    sample of 3,000 and than a bin of ranks."""
    rng = np.random.default_rng(3)
    words = {"x": ["abra", "kadabra", "zut", "bara"], "y": ["abra", "wyrd", "brawl", "zut"]}
    docs = cases.frame(spark, [(i, " ".join(rng.choice(words["xy"[i % 2]], 1 + i % 4)), "xy"[i % 2], "a", 0)
                               for i in range(8000)])
    monkeypatch.setattr(langid, "RANK_BINS", 16)
    model = langid.train(docs)
    half = F.conv(F.substring(F.md5(F.concat(F.lit("lid:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 2
    rest = docs.filter(langid.fold(F.col("doc_id")) != langid.HELD_OUT).withColumn("half", half)
    assert rest.count() > 5000
    total, chars, truth = [], [], []
    for k in (0, 1):
        other = langid.build(rest.filter(F.col("half") != k))
        rows = rest.filter(F.col("half") == k).collect()
        got = langid.Scorer(other).totals(langid.pa.array([r.text for r in rows]))
        total, chars = [*total, got[0]], [*chars, got[1]]
        truth += [other.langs.index(r.lang) for r in rows]
    total, chars, truth = np.concatenate(total), np.concatenate(chars), np.array(truth)
    pick = np.arange(len(truth))
    loss = {t: -np.log(langid.probabilities(total, chars, t)[pick, truth] + 1e-9).mean() for t in langid.TEMPERATURES}
    assert model.temperature == min(loss, key=loss.get)
    p = langid.probabilities(total, chars, model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    assert model.threshold == pytest.approx(right[int((1 - langid.KEEP) * len(right))], abs=1e-12)


def test_value_of_a_rank(spark, monkeypatch):
    monkeypatch.setattr(langid, "RANK_BINS", 8)
    values = [0.25] * 40 + [k / 997 for k in range(500)] + [1.0] * 3 + [0.5 + 1e-12 * k for k in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    for n in (0, 2, 100, 299, 350, len(values) - 1):
        assert langid.nth_smallest(df, n) == sorted(values)[n]


def test_words_are_runs_of_letters():
    rng = random.Random(2)
    pool = [chr(c) for c in range(256)] + list("½Ⅷ²ªıİſΣςß’—ŸŁ ") + ["y" * 70]
    for _ in range(2000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 40)))
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        assert langid.letter_words(text) == [w[i:i + langid.LONGEST] for w in runs
                                             for i in range(0, len(w), langid.LONGEST)]
