"""Registered scalar-function, sink, report, pipeline, tagger and stream
queries (FN-1..9, 11, 12, SNK-1..7, SRC-10, RPT-1..2, PIPE-1..3, ENT-17)."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as TX
from ..operators import normalize as N
from ..operators import report as R
from ..operators.mentions import NAME_RE
from ..session import ensure_checkpoint_dir
from ..sinks import io as IO
from ..sinks import log as LOG
from ..sources.tables import read_table
from . import oracle as O
from .catalog import P, analysis, posts, register
from .q_profile import NESTED_SQL, nested_rows, psql
from .q_sentiment import full_sql
from .q_sources import ANON, CLEAN, VSQL


def scratch_dir(spark, kind: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "exports", f"{kind}-{uuid.uuid4().hex}")


# FN-1 ----------------------------------------------------------------------
@register("fn1_clean", f"SELECT conv_id, turn, {CLEAN('text')} AS cleaned FROM conversations")
def fn1_clean(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.clean_text("text").alias("cleaned"))


# FN-2 ----------------------------------------------------------------------
@register("fn2_anonymize", f"""SELECT conv_id, turn,
  {ANON("CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 5 = 1 THEN '' ELSE role || conv_id::VARCHAR END")} AS author
FROM conversations""")
def fn2_anonymize(spark, sf):
    c = read_table(spark, sf, "conversations")
    raw = (F.when(F.col("turn") % 5 == 0, F.lit(None)).when(F.col("turn") % 5 == 1, F.lit(""))
           .otherwise(F.concat(F.col("role"), F.col("conv_id").cast("string"))))
    return c.select("conv_id", "turn", TX.anonymize_author(raw).alias("author"))


# FN-3 / FN-4: date strings in every accepted format, parsed and re-formatted ------------
_FMT_SQL = """WITH s AS (
  SELECT event_id, ts, CASE event_id % 7
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 3 THEN strftime(ts, '%Y-%m-%d')
    WHEN 4 THEN strftime(ts, '%b %d, %Y')
    WHEN 5 THEN strftime(ts, '%-I:%M%p') || 'On' || strftime(ts, '%b %d')
    ELSE 'not a date' END AS raw
  FROM events),
p AS (
  SELECT event_id, raw, CASE event_id % 7
    WHEN 0 THEN date_trunc('millisecond', ts)
    WHEN 1 THEN date_trunc('second', ts)
    WHEN 2 THEN date_trunc('second', ts)
    WHEN 3 THEN date_trunc('day', ts)
    WHEN 4 THEN date_trunc('day', ts)
    WHEN 5 THEN make_timestamp(2024, month(ts), day(ts), hour(ts), minute(ts), 0)
    ELSE NULL END AS parsed
  FROM s)"""


def _date_strings(spark, sf):
    ev = read_table(spark, sf, "events")
    k = F.col("event_id") % 7
    raw = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
           .when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
           .when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(k == 3, F.date_format("ts", "yyyy-MM-dd"))
           .when(k == 4, F.date_format("ts", "MMM dd, yyyy"))
           .when(k == 5, F.concat(F.lower(F.date_format("ts", "h:mma")), F.lit("On"),
                                  F.date_format("ts", "MMM dd")))
           .otherwise(F.lit("not a date")))
    return ev.select("event_id", raw.alias("raw"))


@register("fn3_parse_date", _FMT_SQL + " SELECT event_id, parsed FROM p")
def fn3_parse_date(spark, sf):
    s = _date_strings(spark, sf)
    return s.select("event_id", D.parse_date("raw", P.as_of).alias("parsed"))


@register("fn4_format_date", _FMT_SQL + """ SELECT event_id,
  coalesce(strftime(parsed, '%Y-%m-%d %H:%M:%S'), raw) AS date FROM p""")
def fn4_format_date(spark, sf):
    s = _date_strings(spark, sf)
    return s.select("event_id", D.format_date(D.parse_date("raw", P.as_of), F.col("raw")).alias("date"))


# FN-5: excerpt truncation and context snippet ---------------------------------------------
@register("fn5_excerpt", VSQL("""SELECT post_id,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt,
  trim(substr(text, greatest(strpos(text, ' ') - 1 - 50, 0) + 1,
       least(length(text), strpos(text, ' ') - 1 + 1 + 50) - greatest(strpos(text, ' ') - 1 - 50, 0))) AS snippet
FROM posts_v WHERE strpos(text, ' ') > 0"""))
def fn5_excerpt(spark, sf):
    ps = posts(spark, sf).filter(F.instr("text", " ") > 0)
    pos0 = F.instr("text", " ") - 1
    return ps.select("post_id", TX.truncate_excerpt("text", 200).alias("excerpt"),
                     TX.context_snippet("text", pos0, F.lit(1), 50).alias("snippet"))


# FN-6: keyword membership tests -------------------------------------------------------------
_KWS = ("license", "version", "work")


@register("fn6_keywords", VSQL(f"""SELECT post_id,
  {O.any_in('lower(text)', _KWS)} AS any_kw,
  {O.count_in('lower(text)', _KWS)}::INT AS n_kw,
  len(list_filter(['licensed', 'under', 'the'], lambda t: contains(lower(text), t))) >= 2 AS majority
FROM posts_v"""))
def fn6_keywords(spark, sf):
    ps = posts(spark, sf)
    tl = F.lower("text")
    return ps.select("post_id", TX.contains_any(tl, _KWS).alias("any_kw"),
                     TX.count_contained(tl, _KWS).alias("n_kw"),
                     TX.majority_match(tl, F.lit("licensed under the")).alias("majority"))


# FN-7: like-count parse ------------------------------------------------------------------
@register("fn7_like_count", """SELECT event_id, coalesce(TRY_CAST(trim(replace(replace(
  CASE event_id % 4 WHEN 0 THEN json_extract(props, '$.k')::VARCHAR || ' Likes'
                    WHEN 1 THEN '1 Like' WHEN 2 THEN ' ' || event_type ELSE '' END,
  'Likes', ''), 'Like', '')) AS BIGINT), 0) AS likes
FROM events""")
def fn7_like_count(spark, sf):
    ev = read_table(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.concat(F.from_json("props", "k long")["k"].cast("string"), F.lit(" Likes")))
           .when(k == 1, F.lit("1 Like")).when(k == 2, F.concat(F.lit(" "), F.col("event_type")))
           .otherwise(F.lit("")))
    return ev.select("event_id", TX.parse_like_count(raw).alias("likes"))


# FN-8 / FN-9: indicator and display formats -----------------------------------------------
@register("fn9_display", """SELECT event_id,
  CASE WHEN (value % 2.0::DOUBLE) - 1.0::DOUBLE > 0.1 THEN 'Positive'
       WHEN (value % 2.0::DOUBLE) - 1.0::DOUBLE < -0.1 THEN 'Negative' ELSE 'Neutral' END AS indicator,
  printf('%+.3f', (CASE WHEN round_even(printf('%.25f', ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 3)::DOUBLE = 0 THEN ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 3)::DOUBLE END)) AS signed,
  printf('%.1f%%', (CASE WHEN round_even(printf('%.25f', (value)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (value)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (value)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END)) AS pct,
  upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS cap,
  replace(lower(event_type || ' Type'), ' ', '-') AS slug
FROM events""")
def fn9_display(spark, sf):
    ev = read_table(spark, sf, "events")
    x = (F.col("value") % 2.0) - 1.0
    return ev.select("event_id", TX.score_indicator(x).alias("indicator"),
                     TX.signed3(TX.round_half_even(x, 3)).alias("signed"),
                     TX.pct1(TX.round_half_even("value", 1)).alias("pct"),
                     TX.capitalize("event_type").alias("cap"),
                     TX.slug(F.concat(F.col("event_type"), F.lit(" Type"))).alias("slug"))


# FN-11: array -> JSON text ----------------------------------------------------------------
@register("fn11_json", full_sql("SELECT scope, name, to_json(platforms)::VARCHAR AS platforms_json FROM entities"))
def fn11_json(spark, sf):
    e = analysis(spark, sf).entities
    return e.select("scope", "name", TX.array_to_json("platforms").alias("platforms_json"))


# FN-12: half-even rounding -------------------------------------------------------------
@register("fn12_round", """SELECT event_id,
  (CASE WHEN round_even(printf('%.25f', (value / 3.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (value / 3.0::DOUBLE)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (value / 3.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END) AS r1,
  (CASE WHEN round_even(printf('%.25f', (value / 7.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (value / 7.0::DOUBLE)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (value / 7.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) AS r4 FROM events""")
def fn12_round(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", TX.round_half_even(F.col("value") / 3.0, 1).alias("r1"),
                     TX.round_half_even(F.col("value") / 7.0, 4).alias("r4"))


# SNK-1 / SRC-10: posts appended, read back ---------------------------------------------------
_P_COLS = ("post_id", "platform", "scope", "text", "author", "ts", "url", "likes", "shares", "keyword")


@register("snk1_posts_parquet", VSQL(f"SELECT {', '.join(_P_COLS)} FROM posts_v"))
def snk1_posts_parquet(spark, sf):
    path = scratch_dir(spark, "posts")
    ps = posts(spark, sf)
    IO.write_posts(ps, path)
    stored = spark.read.parquet(path).drop("post_id").withColumnRenamed("native_id", "post_id")
    return stored.select(*_P_COLS)


# SNK-2: entity upsert, run twice ------------------------------------------------------
@register("snk2_entities", full_sql("SELECT scope, name, mention_count FROM entities"))
def snk2_entities(spark, sf):
    path = scratch_dir(spark, "entities")
    e = analysis(spark, sf).entities
    IO.write_entities(e, path, mode="upsert")
    IO.write_entities(e, path, mode="upsert")
    return spark.read.schema(e.schema).parquet(path).select("scope", "name", "mention_count")


# SNK-3: sentiment rows; a rerun replaces, never duplicates ----------------------------------
@register("snk3_sentiment", full_sql("SELECT post_id, scope, entity, label, score FROM fanout"))
def snk3_sentiment(spark, sf):
    path = scratch_dir(spark, "sentiment")
    s = analysis(spark, sf).sentiment.select("post_id", "scope", "entity", "label", "score")
    IO.write_sentiment(s, path)
    IO.write_sentiment(s, path)
    return spark.read.schema(s.schema).parquet(path).select("post_id", "scope", "entity", "label", "score")


# SNK-4 / SRC-10: JSON export and read back ---------------------------------------------
@register("snk4_posts_json", VSQL("SELECT post_id, platform, scope, text, likes FROM posts_v"))
def snk4_posts_json(spark, sf):
    path = scratch_dir(spark, "posts-json")
    IO.export_posts_json(posts(spark, sf), path)
    return IO.read_json_export(spark, path, "post_id long, platform string, scope string, "
                               "text string, likes long")


# SNK-5: CSV with header; raw texts with line breaks, quotes and outer blanks --------------
_CSV_TEXT = """'"' || role || '" said' || chr(10) || text || CASE WHEN turn % 3 = 0 THEN ' ' ELSE '' END"""


@register("snk5_posts_csv", f"""SELECT conv_id, turn, role,
  CASE turn % 5 WHEN 1 THEN NULL WHEN 2 THEN '' ELSE {_CSV_TEXT} END AS text FROM conversations""")
def snk5_posts_csv(spark, sf):
    path = scratch_dir(spark, "posts-csv")
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    raw = F.concat(F.lit('"'), "role", F.lit('" said\n'), "text",
                   F.when(F.col("turn") % 3 == 0, F.lit(" ")).otherwise(F.lit("")))
    k = F.col("turn") % 5
    c = c.withColumn("text", F.when(k == 1, F.lit(None)).when(k == 2, F.lit("")).otherwise(raw))
    IO.export_posts_csv(c, path)
    return IO.read_csv_export(spark, path, c.schema)


@register("snk5_all_columns", VSQL(f"SELECT {', '.join(_P_COLS)} FROM posts_v"))
def snk5_all_columns(spark, sf):
    path = scratch_dir(spark, "posts-csv")
    ps = posts(spark, sf).select(*_P_COLS)
    IO.export_posts_csv(ps, path)
    return IO.read_csv_export(spark, path, ps.schema)


# SNK-2: an upsert that changes one scope keeps the other ------------------------------------
@register("snk2_upsert_scope", full_sql("""SELECT scope, name,
  CASE WHEN scope = 'en' THEN mention_count + 1 ELSE mention_count END AS mention_count FROM entities"""))
def snk2_upsert_scope(spark, sf):
    path = scratch_dir(spark, "entities")
    e = analysis(spark, sf).entities
    IO.write_entities(e, path, mode="upsert")
    new = e.filter(F.col("scope") == "en").withColumn("mention_count", F.col("mention_count") + 1)
    IO.write_entities(new, path, mode="upsert")
    return spark.read.schema(e.schema).parquet(path).select("scope", "name", "mention_count")


# SNK-1: two writers stage all posts from the same version; the second to commit tries again
@register("snk1_two_writers", VSQL(f"SELECT {', '.join(_P_COLS)}, 2 AS copies, 2 AS ids FROM posts_v"))
def snk1_two_writers(spark, sf):
    table = LOG.posts_log(spark, scratch_dir(spark, "posts-log"))
    ps = posts(spark, sf).withColumnRenamed("post_id", "native_id")
    first, second = table.stage(ps), table.stage(ps)
    table.commit(second)
    table.commit(first)
    cols = [F.col("native_id" if c == "post_id" else c).alias(c) for c in _P_COLS]
    return (table.read().groupBy(*cols)
            .agg(F.count("*").alias("copies"), F.countDistinct(F.struct("post_id")).alias("ids")))


# SNK-2 / SNK-3: a failing upsert leaves all rows, one that is overtaken is computed again
@register("snk2_commit_log", full_sql("""SELECT scope, name,
  CASE WHEN scope = 'en' THEN mention_count + 1 ELSE mention_count END AS mention_count FROM entities"""))
def snk2_commit_log(spark, sf):
    table = LOG.LoggedTable(spark, scratch_dir(spark, "entities-log"))
    e = analysis(spark, sf).entities.select("scope", "name", "mention_count")
    start = table.replace_scopes(e)
    broken = e.withColumn("mention_count", F.when(
        F.col("scope") == "en", F.raise_error(F.lit("stopped half way")).cast("long")).otherwise(F.lit(-1).cast("long")))
    try:
        table.upsert(broken)
    except Exception as error:
        if "stopped half way" not in str(error):
            raise
    late = table.stage(e.withColumn("mention_count", F.lit(0).cast("long")))
    more = e.filter(F.col("scope") == "en").withColumn("mention_count", F.col("mention_count") + 1)
    table.upsert(more)
    try:
        table.commit(late, replaces=True, computed_from=start)
    except LOG.Conflict:
        table.upsert(more)
    return table.read()


# SNK-6: sorted sentiment export -------------------------------------------------------
@register("snk6_sentiment_json", full_sql("""SELECT f.post_id, f.entity, f.score, p.url
FROM fanout f JOIN posts_v p USING (post_id)"""))
def snk6_sentiment_json(spark, sf):
    path = scratch_dir(spark, "sentiment-json")
    a = analysis(spark, sf)
    IO.export_sentiment_json(a.sentiment.select("post_id", "entity", "label", "score"),
                             posts(spark, sf), path)
    return IO.read_json_export(spark, path, "post_id long, entity string, score double, url string")


# SNK-7: nested profiles per scope ------------------------------------------------------
@register("snk7_profiles_json", psql("""SELECT s.scope, s.entity, s.overall_score, g.post_count
FROM summary s JOIN engagement g USING (scope, entity)"""))
def snk7_profiles_json(spark, sf):
    path = scratch_dir(spark, "profiles-json")
    prof = analysis(spark, sf).part("profiles")
    IO.export_profiles_json(prof, path)
    back = spark.read.schema(prof.schema).json(path)
    return back.select("scope", "entity", F.col("sentiment.overall_score").alias("overall_score"),
                       F.col("post_count").cast("long").alias("post_count"))


@register("snk7_nested", psql(NESTED_SQL))
def snk7_nested(spark, sf):
    """An export that held one scope more, then the export of the run: nothing
    of the first survives, and every nested value comes back."""
    path = scratch_dir(spark, "profiles-json")
    prof = analysis(spark, sf).part("profiles")
    IO.export_profiles_json(prof.unionByName(prof.withColumn("scope", F.lit("old")).limit(1)), path)
    IO.export_profiles_json(prof, path)
    return nested_rows(IO.read_json_export(spark, path, prof.schema))


# SNK-6 / SRC-10: every column of the sentiment export, read back
@register("src10_sentiment_export", full_sql("""SELECT f.post_id, f.entity, f.label, f.score, f.confidence,
  p.text, p.platform, p.scope AS post_scope, p.ts, p.url FROM fanout f JOIN posts_v p USING (post_id)"""))
def src10_sentiment_export(spark, sf):
    path = scratch_dir(spark, "sentiment-json")
    a = analysis(spark, sf)
    IO.export_sentiment_json(a.sentiment.select("post_id", "entity", "label", "score", "confidence"),
                             posts(spark, sf), path)
    return IO.read_json_export(spark, path, "post_id long, entity string, label string, score double, "
                               "confidence double, text string, platform string, post_scope string, "
                               "ts timestamp_ntz, url string")


# RPT-1 ---------------------------------------------------------------------------
@register("rpt1_ranking", psql("""SELECT s.scope,
  row_number() OVER (PARTITION BY s.scope ORDER BY s.overall_score DESC, s.entity) AS rank,
  s.entity, s.overall_score AS score,
  CASE WHEN s.overall_score > 0.1 THEN 'Positive' WHEN s.overall_score < -0.1 THEN 'Negative'
       ELSE 'Neutral' END AS indicator,
  s.positive_pct, s.negative_pct, e.mention_count
FROM summary s JOIN entities e ON e.scope = s.scope AND e.name = s.entity"""))
def rpt1_ranking(spark, sf):
    a = analysis(spark, sf)
    t = R.ranking_table(a.entities, a.part("summary"))
    return t.select("scope", F.col("rank").cast("long").alias("rank"), "entity", "score", "indicator",
                    "positive_pct", "negative_pct", "mention_count")


# RPT-2 ---------------------------------------------------------------------------
@register("rpt2_platform_table", psql("""SELECT scope, entity,
  upper(substr(platform, 1, 1)) || lower(substr(platform, 2)) AS platform,
  printf('%+.3f', (CASE WHEN round_even(printf('%.25f', (score)::DOUBLE)::DECIMAL(38, 25), 3)::DOUBLE = 0 THEN (score)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (score)::DOUBLE)::DECIMAL(38, 25), 3)::DOUBLE END)) AS score, count AS posts,
  printf('%.1f%%', positive_pct) AS positive, printf('%.1f%%', negative_pct) AS negative
FROM pbreak"""))
def rpt2_platform_table(spark, sf):
    return R.platform_table(analysis(spark, sf).part("platforms"))


@register("rpt2_details", psql("""SELECT k.scope, k.entity,
  coalesce((SELECT string_agg('`' || t.theme || '` (' || t.count || ')', ', ' ORDER BY t.rank)
            FROM themes t WHERE t.scope = k.scope AND t.entity = k.entity AND t.rank <= 10), '') AS themes,
  (SELECT count(*) FROM excerpts x WHERE x.scope = k.scope AND x.entity = k.entity
     AND x.rank <= 3 AND x.label = 'positive') AS shown_positive,
  (SELECT count(*) FROM excerpts x WHERE x.scope = k.scope AND x.entity = k.entity
     AND x.rank <= 3 AND x.label = 'negative') AS shown_negative,
  coalesce((SELECT string_agg(upper(substr(s.category, 1, 1)) || lower(substr(s.category, 2)) || ' ('
                   || s.strength || ', ' || s.mentions || ' mentions)', ', ' ORDER BY s.mentions DESC, s.ordinal)
            FROM (SELECT * FROM support s2 WHERE s2.scope = k.scope AND s2.entity = k.entity
                  ORDER BY s2.mentions DESC, s2.ordinal LIMIT 5) s), '') AS support,
  format('{:,}', g.total_likes) AS likes, format('{:,}', g.total_shares) AS shares,
  printf('%.1f', g.avg_likes) AS avg_likes
FROM ekeys k JOIN engagement g ON g.scope = k.scope AND g.entity = k.entity"""))
def rpt2_details(spark, sf):
    a = analysis(spark, sf)
    return R.detail_table(a.entities, a.part("themes"), a.part("excerpts"), a.part("support"),
                          a.part("engagement"))


def _signed(c: str) -> str:
    r = f"round_even(printf('%.25f', ({c})::DOUBLE)::DECIMAL(38, 25), 3)::DOUBLE"
    return f"printf('%+.3f', (CASE WHEN {r} = 0 THEN ({c})::DOUBLE * 0.0::DOUBLE ELSE {r} END))"


def _cap(c: str) -> str:
    return f"upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"


@register("rpt2_excerpts", psql(f"""SELECT scope, entity, label, rank::BIGINT AS rank, text,
  {_cap('platform')} AS platform, {_signed('score')} AS score, date FROM excerpts WHERE rank <= 3"""))
def rpt2_excerpts(spark, sf):
    from .pipeline import generate_report
    return generate_report(analysis(spark, sf))["excerpts"]


@register("rpt2_audience", psql(f"""SELECT scope, entity, {_cap('platform')} AS platform, posts,
  printf('%.1f%%', share_pct) AS share FROM audience"""))
def rpt2_audience(spark, sf):
    from .pipeline import generate_report
    return generate_report(analysis(spark, sf))["audience"]


@register("rpt2_regions", psql(f"""SELECT scope, entity, rank::BIGINT AS rank, {_cap('region')} AS region,
  mentions FROM regions"""))
def rpt2_regions(spark, sf):
    from .pipeline import generate_report
    return generate_report(analysis(spark, sf))["regions"]


# PIPE-1: the whole analysis -> profile summary of every accepted entity -------------------
@register("pipe1_analysis", psql("""SELECT e.scope, e.name AS entity, e.mention_count, s.overall_score,
  s.total_analyzed, g.post_count
FROM entities e JOIN summary s ON s.scope = e.scope AND s.entity = e.name
JOIN engagement g ON g.scope = e.scope AND g.entity = e.name"""), headline=True)
def pipe1_analysis(spark, sf):
    a = analysis(spark, sf)
    s, g = a.part("summary"), a.part("engagement")
    return (a.entities.select("scope", F.col("name").alias("entity"), "mention_count")
            .join(s.select("scope", "entity", "overall_score", "total_analyzed"), ["scope", "entity"])
            .join(g.select("scope", "entity", "post_count"), ["scope", "entity"]))


# PIPE-2: report data per scope (summary + ranking rows) ---------------------------------
@register("pipe2_report", psql("""SELECT e.scope, count(*) AS entities,
  coalesce(sum(g.post_count), 0)::BIGINT AS total_posts,
  string_agg(e.name, ',' ORDER BY s.overall_score DESC, e.name) AS ranking
FROM entities e JOIN engagement g ON g.scope = e.scope AND g.entity = e.name
JOIN summary s ON s.scope = e.scope AND s.entity = e.name
GROUP BY e.scope"""))
def pipe2_report(spark, sf):
    from ..operators.profile import executive_summary
    a = analysis(spark, sf)
    ex = executive_summary(a.entities, a.part("engagement"))
    rk = R.ranking_table(a.entities, a.part("summary"))
    order = (rk.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("_r"))
             .select("scope", F.array_join(F.transform("_r", lambda x: x["entity"]), ",").alias("ranking")))
    return ex.join(order, "scope").select("scope", "entities", "total_posts", "ranking")


# PIPE-3: ingest -- normalizers -> union -> stored posts, tallied ----------------------------
def _pipe3_sql() -> str:
    from .q_sources import (COM_SQL, FORUM_SQL, N1_SQL, N2_SQL, N3_SQL, N4_SQL, N5_SQL, N6_SQL, PC_SQL,
                            PP_SQL, START, SUBS_SQL, TW_SQL)
    cols = "platform, scope"
    return f"""WITH {FORUM_SQL}, {N1_SQL}, {SUBS_SQL}, {N2_SQL}, {COM_SQL}, {N3_SQL}, {TW_SQL}, {N4_SQL},
{PP_SQL}, {N5_SQL}, {PC_SQL}, {N6_SQL},
u AS (
  SELECT {cols} FROM n1 WHERE length(text) >= 20 AND (ts IS NULL OR ts >= {START}) UNION ALL
  SELECT {cols} FROM n2 WHERE length(text) >= 20 AND ts >= {START}
  UNION ALL SELECT {cols} FROM n3 WHERE length(text) >= 20 AND ts >= {START}
  UNION ALL SELECT {cols} FROM n4 WHERE length(text) >= 20 AND (ts IS NULL OR ts >= {START})
  UNION ALL SELECT {cols} FROM n5 WHERE length(text) >= 20 AND ts >= {START}
  UNION ALL SELECT {cols} FROM n6 WHERE length(text) >= 10)
SELECT platform, scope, count(*) AS posts FROM u GROUP BY ROLLUP (platform, scope)"""


@register("pipe3_ingest", _pipe3_sql())
def pipe3_ingest(spark, sf):
    from ..sources import landed
    from .pipeline import Landed, ingest
    docs = read_table(spark, sf, "documents")
    conv = read_table(spark, sf, "conversations")
    payloads = Landed(
        forum_pages=landed.forum_pages(docs.select("doc_id", "text", "lang")),
        submissions=landed.submissions(conv), comments=landed.comments(conv),
        tweets=landed.tweets(read_table(spark, sf, "events")),
        page_posts=landed.page_posts(docs), page_comments=landed.page_comments(conv))
    path = scratch_dir(spark, "ingest")
    return ingest(spark, payloads, path, P, scope="en", keyword="en release",
                  page_scope=landed.page_lang(F.col("html")), graph_scope=F.col("scope"))


# ENT-17 / UDF-2: pluggable entity tagger (stand-in regex tagger) ----------------------------
@register("ent17_tagger", f"""WITH {O.POSTS_V}, {O.posts_in_scope(P)},
t AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '{O.ACCENTS}', '0', 'g'),
                                       '{O.NAME_RE_SQL}', 1)) AS name
      FROM posts WHERE length(text) <= 5000)
SELECT name, count(*) AS count FROM t WHERE len(string_split(name, ' ')) >= 2 GROUP BY name""")
def ent17_tagger(spark, sf):
    from ..operators.tagger import regex_person_tagger, tag_entities
    ps = posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    return tag_entities(ps, regex_person_tagger(NAME_RE))


# SRC-10: read back the exports (posts JSON) with an explicit schema -------------------------
@register("src10_read_exports", VSQL("SELECT post_id, scope, author, url FROM posts_v"))
def src10_read_exports(spark, sf):
    path = scratch_dir(spark, "posts-export")
    ps = posts(spark, sf)
    IO.export_posts_json(ps, path)
    return IO.read_json_export(spark, path, "post_id long, scope string, author string, url string")


# SNK-8: export switches (posts JSON off, the rest on); rows per written export -------------
@register("snk8_exports", full_sql("""SELECT 'posts_csv' AS export, (SELECT count(*) FROM posts_v) AS n
UNION ALL SELECT 'sentiment_json', (SELECT count(*) FROM fanout f JOIN posts_v p ON p.post_id = f.post_id)
UNION ALL SELECT 'profiles_json', (SELECT count(*) FROM entities)"""))
def snk8_exports(spark, sf):
    a = analysis(spark, sf)
    out = scratch_dir(spark, "exports")
    done = IO.export_all(posts(spark, sf), a.sentiment.select("post_id", "entity", "label", "score"),
                         a.part("profiles"), out, posts_json=False)
    rows = []
    for name, path in sorted(done.items()):
        back = (IO.read_csv_export(spark, path, posts(spark, sf).schema) if name.endswith("csv")
                else IO.read_json_export(spark, path, "scope string"))
        rows.append(back.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("export"), "n"))
    return reduce(DataFrame.unionAll, rows)
