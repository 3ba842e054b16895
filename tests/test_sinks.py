"""Storage round trips: posts, entities, sentiment, JSON/CSV exports."""

import os

from pyspark.sql import functions as F

from helpers import POST_DDL, make_posts
from vocalis.sinks import io as IO


def test_save_and_read_posts(spark, tmp_out):
    posts = make_posts(spark, ["first post text here", "second post text here"])
    path = os.path.join(tmp_out, "posts")
    IO.write_posts(posts, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and set(back.columns) >= {"post_id", "scope", "text", "likes"}


def test_same_post_saved_twice_gives_two_rows(spark, tmp_out):
    posts = make_posts(spark, ["the same post saved twice"])
    path = os.path.join(tmp_out, "posts")
    IO.write_posts(posts, path)
    IO.write_posts(posts, path)
    assert spark.read.parquet(path).count() == 2


def test_optional_dedupe(spark):
    posts = make_posts(spark, ["dup text", "dup text", "other"])
    out = IO.dedupe_posts(posts, ["scope", "text"])
    assert sorted(r["post_id"] for r in out.collect()) == [1, 3]


def test_entity_upsert_keeps_stale_names(spark, tmp_out):
    ddl = "scope string, name string, mention_count long"
    path = os.path.join(tmp_out, "entities")
    IO.write_entities(spark.createDataFrame([("L", "A B", 3), ("L", "C D", 2)], ddl), path, mode="upsert")
    IO.write_entities(spark.createDataFrame([("L", "A B", 5)], ddl), path, mode="upsert")
    got = {r["name"]: r["mention_count"] for r in spark.read.parquet(path).collect()}
    assert got == {"A B": 5, "C D": 2}


def test_entity_overwrite_replaces_scope(spark, tmp_out):
    ddl = "scope string, name string, mention_count long"
    path = os.path.join(tmp_out, "entities")
    IO.write_entities(spark.createDataFrame([("L", "A B", 3), ("K", "X Y", 1)], ddl), path)
    IO.write_entities(spark.createDataFrame([("L", "E F", 4)], ddl), path)
    got = {(r["scope"], r["name"]) for r in spark.read.parquet(path).collect()}
    assert got == {("L", "E F"), ("K", "X Y")}


def test_sentiment_rerun_does_not_duplicate(spark, tmp_out):
    s = spark.createDataFrame([(1, "L", "A B", "positive", 0.5)],
                              "post_id long, scope string, entity string, label string, score double")
    path = os.path.join(tmp_out, "sent")
    IO.write_sentiment(s, path)
    IO.write_sentiment(s, path)
    assert spark.read.parquet(path).count() == 1


def test_json_export_round_trip(spark, tmp_out):
    posts = make_posts(spark, ["Ọmọ naija text", "plain"]).select("post_id", "text")
    path = os.path.join(tmp_out, "json")
    IO.export_posts_json(posts, path)
    back = IO.read_json_export(spark, path, "post_id long, text string")
    assert sorted(r["text"] for r in back.collect()) == ["plain", "Ọmọ naija text"]


def test_csv_export_of_nothing_has_header(spark, tmp_out):
    empty = spark.createDataFrame([], POST_DDL).select("post_id", "platform", "text")
    path = os.path.join(tmp_out, "csv")
    IO.export_posts_csv(empty, path)
    files = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert files
    with open(os.path.join(path, files[0]), encoding="utf-8") as fh:
        assert fh.readline().strip() == "post_id,platform,text"


def test_sentiment_export_sorted(spark, tmp_out):
    s = spark.createDataFrame([(1, "A B", 0.1), (2, "A B", 0.9)], "post_id long, entity string, score double")
    posts = make_posts(spark, ["x", "y"])
    path = os.path.join(tmp_out, "sj")
    IO.export_sentiment_json(s, posts, path)
    back = spark.read.json(path).select("post_id", "score").collect()
    assert len(back) == 2 and F is not None


def test_every_stored_row_has_its_own_id(spark, tmp_out):
    path = os.path.join(tmp_out, "ids")
    posts = make_posts(spark, ["one text here", "two texts here"])
    for _ in range(3):
        IO.write_posts(posts, path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 6 and len({r["post_id"] for r in rows}) == 6
    assert sorted(r["native_id"] for r in rows) == [1, 1, 1, 2, 2, 2]


def test_upsert_of_another_type_fails_and_keeps_the_table(spark, tmp_out):
    import pytest
    path = os.path.join(tmp_out, "ent")
    ddl = "scope string, name string, mention_count long"
    IO.write_entities(spark.createDataFrame([("en", "A B", 1), ("de", "C D", 2)], ddl), path)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    other = spark.createDataFrame([("en", "A B", "x")], "scope string, name string, mention_count string")
    with pytest.raises(Exception):
        IO.write_entities(other, path, mode="upsert")
    new = spark.createDataFrame([("en", "A B", 9)], ddl)
    IO.write_entities(new, path, mode="upsert")
    got = sorted((r["scope"], r["mention_count"]) for r in spark.read.parquet(path).collect())
    assert got == [("de", 2), ("en", 9)]
    assert os.listdir(tmp_out) == ["ent"]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_csv_keeps_every_text(spark, tmp_out):
    path = os.path.join(tmp_out, "csv")
    texts = ["a\nb", '"q" and, comma', " blanks ", "", None, "back\\slash"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    IO.export_posts_csv(df, path)
    assert {r["i"]: r["text"] for r in IO.read_csv_export(spark, path, df.schema).collect()} == dict(enumerate(texts))


def test_sentiment_export_moves_a_text_once_and_keeps_the_order(spark, tmp_out):
    """Posts of several scopes, each with many entities; a null entity, scope
    and score, scores that differ within a post, an id that two posts share."""
    import glob
    import gzip
    import json
    import random
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij\n\" ", k=4000)) for _ in range(300)]
    scopes = ["en", "de", None]
    posts = make_posts(spark, [{"text": t, "scope": scopes[i % 3]} for i, t in enumerate(texts)])
    posts = posts.unionByName(posts.filter("post_id = 7")).repartition(4)
    entities = [None, "", "General", *(f"Name {i}/{c}" for i, c in enumerate("zyxwvutsrq"))]
    rows = [(i, e, "positive", None if i % 17 == 0 else -0.0 if i % 5 == 0 else i % 7 / 7 + (i % 11 == 0) * k / 100)
            for i in range(1, 301) for k, e in enumerate(entities) if (i * k) % 3 < 2] + [(None, "General", "neutral", 0.1)]
    s = spark.createDataFrame(rows, "post_id long, entity string, label string, score double").repartition(4)
    path = os.path.join(tmp_out, "sj")
    IO.export_sentiment_json(s, posts, path)
    back = IO.read_json_export(spark, path, "post_id long, entity string, label string, score double, text string, "
                               "post_scope string")
    assert back.columns == ["post_id", "entity", "label", "score", "text", "post_scope"]
    want = (s.join(posts.select("post_id", "text", F.col("scope").alias("post_scope")), "post_id")
            .select(*back.columns))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, want.collect()))
    # the files in the order of their paths hold the rows in the order asked for
    got = []
    for file in sorted(glob.glob(os.path.join(path, "**", "*.json.gz"), recursive=True)):
        got += [json.loads(line) for line in gzip.open(file, "rt", encoding="utf-8")]

    def key(r):
        scope, entity, score = r.get("post_scope"), r.get("entity"), r.get("score")
        return (scope is not None, scope or "", entity is not None, entity or "", score is None, -(score or 0),
                r["post_id"])
    assert len(got) == want.count() and [key(r) for r in got] == sorted(map(key, got))
    # one row per post meets its text, and no row of an entity is shuffled with it
    from test_plans import exchanged
    carrying = [c for c in exchanged(IO.sentiment_rows(s, posts)) if "text" in c]
    assert carrying and not any(c & {"entity", "label"} for c in carrying)


def test_sentiment_export_of_many_groups_or_no_rows(spark, tmp_out, monkeypatch):
    s = spark.createDataFrame([(1, "A B", 0.1), (2, "C D", 0.9), (2, "A B", 0.9)], "post_id long, entity string, score double")
    posts = make_posts(spark, ["x", "y"])
    for k, (limit, rows) in enumerate([(1, s), (2, s), (2, s.limit(0))]):
        monkeypatch.setattr(IO, "EXPORT_GROUPS", limit)
        path = os.path.join(tmp_out, str(k))
        IO.export_sentiment_json(rows, posts, path)
        back = IO.read_json_export(spark, path, "post_id long, entity string, score double, text string")
        assert (sorted(map(tuple, back.select("post_id", "entity", "score").collect()))
                == sorted(map(tuple, rows.collect())))


def test_stored_and_exported_texts_take_little_room(spark, tmp_out):
    """Stored posts are zstd, the export is packed closer than the fastest level
    does and comes back whole; a task sorts a bounded number of rows."""
    import gzip
    import glob
    import random
    import zlib
    import duckdb
    rng = random.Random(3)
    syllables = ["ti", "on", "er", "sh", "nd", "the", "ing", "ble", "ou", "ha", " ", " ", " "]
    texts = ["".join(rng.choices(syllables, k=1500)) for _ in range(400)]
    path = os.path.join(tmp_out, "posts")
    IO.write_posts(make_posts(spark, texts).repartition(2), path)
    posts = spark.read.parquet(path)
    kinds = duckdb.sql(f"SELECT DISTINCT compression FROM parquet_metadata('{path}/**/*.parquet')").fetchall()
    assert kinds == [("ZSTD",)]
    s = posts.select("post_id", F.explode(F.array(F.lit("A B"), F.lit("C D"))).alias("entity"), F.lit(0.5).alias("score"))
    out = os.path.join(tmp_out, "sj")
    IO.export_sentiment_json(s, posts, out)
    files = glob.glob(os.path.join(out, "**", "*.json.gz"), recursive=True)
    for file in files:
        lines = gzip.open(file, "rb").read()
        fast = zlib.compressobj(1, zlib.DEFLATED, 31)
        assert os.path.getsize(file) < 0.97 * len(fast.compress(lines) + fast.flush())
    back = IO.read_json_export(spark, out, "post_id long, entity string, text string")
    want = s.join(posts, "post_id").select("post_id", "entity", "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    assert IO.EXPORT_ROWS <= 20_000
