import collections

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_learned import labelled
from tests.llm.test_pii import by_hand
from tests.llm.test_text_dedup import components_by_hand
from vocalis.llm import bpe, toxicity


def test_stages_do_what_their_operators_do(spark, tmp_path):
    """Each stage against a brute force, on what its predecessor kept."""
    tox_docs, labels = labelled(spark, 200)
    rows = [tuple(r) for r in tox_docs.collect()] + [
        (1000 + d if d is not None else None, t, l, s, n) for d, t, l, s, n in cases.rows()]
    rows.append((2000, "mail a.b@c.de or +1 (017) 555-7713 " + cases.sentence(__import__("random").Random(0), 20), "en", "b", 1))
    sf = str(tmp_path)
    docs = cases.frame(spark, rows)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    lexicon = toxicity.fit(docs.select("doc_id", "text"), labels)
    automaton = lexicon.automaton()
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf}/{name}"
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        a = [tuple(r) for r in before.select(columns).collect()]
        if name != "tokens":
            assert after.columns == columns
            b = [tuple(r) for r in after.collect()]
        if name == "toxicity":
            hit = lambda t: toxicity.weighted_hits(toxicity.folded_words(t), automaton)[0] > 0
            assert sorted(b, key=repr) == sorted([r for r in a if not hit(r[1])], key=repr)
        elif name == "near_copies":
            keep = {d for d, _, c in components_by_hand(a) if d is None or d == c}
            assert sorted(b, key=repr) == sorted([r for r in a if r[0] in keep], key=repr)
        elif name == "pii":
            assert len(a) == len(b)
            assert all(not by_hand(r[1]) for r in b)
            untouched = sorted(repr(r[:2]) for r in a if not by_hand(r[1]))
            assert collections.Counter(untouched) <= collections.Counter(repr(r[:2]) for r in b)
        elif name == "mixing":
            words = collections.Counter()
            for r in b:
                words[r[0], r[3]] += len(cases.words_of(r[1]))
            size = collections.Counter()
            for r in a:
                size[r[0], r[3]] += len(cases.words_of(r[1]))
            assert all(words[k] <= 2 * size[k] for k in words)
            whole = sum(size.values())
            assert abs(sum(words.values()) - 1.5 * whole) <= 5
        else:
            from tokenizers import Tokenizer
            ref = Tokenizer.from_file(bpe.default_path())
            got = sorted((repr(r.doc_id), r.ids) for r in after.collect())
            assert got == sorted((repr(r[0]), ref.encode(r[1] or "", add_special_tokens=False).ids) for r in a)
            assert after.filter("NOT round_trip").count() == 0
        before = after


def test_run_on_given_documents(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.filter("round_trip").count() == out.count()
    assert len(corpus_pipeline.STAGES) == 5
