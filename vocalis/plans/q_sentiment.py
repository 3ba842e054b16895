"""Registered sentiment queries (SEN-1..6, SEN-8, SEN-9, JOIN-1, SRC-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sentiment import (label_distribution, lexicon_model_factory, model_scores,
                                   normalize_classifier, normalize_compound, normalize_polarity,
                                   scorer_input)
from ..sources.posts import sentiment_for_entity
from ..sources.tables import read_table
from . import oracle as O
from .catalog import P, analysis, posts, register


def lexicon_case(var: str) -> str:
    if not P.lexicon:
        return "0.0::DOUBLE"
    arms = " ".join(f"WHEN {O.q(w.lower())} THEN {float(v)!r}::DOUBLE" for w, v in sorted(P.lexicon.items()))
    return f"CASE {var} {arms} ELSE 0.0::DOUBLE END"


SCORED_SQL = f"""lex AS (
  SELECT post_id, scope, platform, text,
    list_reduce(list_transform(
      regexp_extract_all(lower(substr(coalesce(text, ''), 1, {P.max_score_chars})), '(\\p{{L}}+)', 1),
      lambda w: {lexicon_case('w')}), lambda a, x: a + x, 0.0::DOUBLE) AS s
  FROM posts),
comp AS (SELECT *, s / sqrt(s * s + 15.0::DOUBLE) AS c, (text IS NULL OR text = '') AS blank FROM lex),
scored_posts AS (
  SELECT post_id, scope, platform,
    CASE WHEN blank THEN 'neutral' WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative'
         ELSE 'neutral' END AS label,
    CASE WHEN blank THEN 0.0::DOUBLE ELSE (CASE WHEN round_even(printf('%.25f', (c)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (c)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (c)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) END AS score,
    CASE WHEN blank THEN 0.0::DOUBLE ELSE (CASE WHEN round_even(printf('%.25f', (abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (abs(c))::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) END AS confidence
  FROM comp)"""

FANOUT_SQL = """ent_pairs AS (
  SELECT pr.post_id, pr.scope, pr.name AS entity FROM pairs pr JOIN entities e USING (scope, name)),
fanout AS (
  SELECT sp.post_id, sp.scope, sp.platform, coalesce(ep.entity, 'General') AS entity,
         sp.label, sp.score, sp.confidence
  FROM scored_posts sp LEFT JOIN ent_pairs ep ON ep.post_id = sp.post_id)"""


def full_sql(select: str, extra_ctes: str = "") -> str:
    """Discovery + scoring + fan-out CTEs (+ optional extra CTEs), then select."""
    ctes = ",\n" + SCORED_SQL + ",\n" + FANOUT_SQL + (",\n" + extra_ctes if extra_ctes else "")
    return O.discovery_sql(P, ctes + "\n" + select)


def scored_sql(select: str) -> str:
    return f"WITH {O.POSTS_V}, {O.posts_in_scope(P)},\n{SCORED_SQL}\n{select}"


# SEN-1 ----------------------------------------------------------------------
@register("sen1_input", f"""WITH {O.POSTS_V}
SELECT post_id, length(substr(text, 1, {P.max_score_chars}))::BIGINT AS scored_chars,
       (text IS NULL OR text = '') AS blank FROM posts_v""")
def sen1_input(spark, sf):
    ps = posts(spark, sf)
    return ps.select("post_id", F.length(scorer_input("text", P.max_score_chars)).cast("long")
                     .alias("scored_chars"),
                     (F.col("text").isNull() | (F.col("text") == "")).alias("blank"))


# SEN-2: classifier-output normaliser on labels-derived outputs -------------------------
_CLS_SQL = """WITH cls AS (
  SELECT doc_id,
    CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'Positive' ELSE 'neutral' END AS raw_label,
    ((doc_id * 37) % 100)::DOUBLE / 100.0::DOUBLE AS raw_conf
  FROM labels)
SELECT doc_id,
  CASE WHEN contains(lower(raw_label), 'pos') THEN 'positive'
       WHEN contains(lower(raw_label), 'neg') THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN contains(lower(raw_label), 'pos') THEN (CASE WHEN round_even(printf('%.25f', (raw_conf)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (raw_conf)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (raw_conf)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END)
       WHEN contains(lower(raw_label), 'neg') THEN (CASE WHEN round_even(printf('%.25f', (-raw_conf)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (-raw_conf)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (-raw_conf)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) ELSE 0.0::DOUBLE END AS score,
  (CASE WHEN round_even(printf('%.25f', (raw_conf)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (raw_conf)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (raw_conf)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) AS confidence
FROM cls"""


@register("sen2_classifier", _CLS_SQL)
def sen2_classifier(spark, sf):
    lab = read_table(spark, sf, "labels")
    raw_label = (F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "Positive")
                 .otherwise("neutral"))
    raw_conf = ((F.col("doc_id") * 37) % 100).cast("double") / 100.0
    label, score, conf = normalize_classifier(raw_label, raw_conf)
    return lab.select("doc_id", label.alias("label"), score.alias("score"), conf.alias("confidence"))


# SEN-3 / SEN-4: compound and polarity normalisers on events.value ---------------------
@register("sen3_compound", """SELECT event_id,
  CASE WHEN (value % 2.0::DOUBLE) - 1.0::DOUBLE >= 0.05 THEN 'positive'
       WHEN (value % 2.0::DOUBLE) - 1.0::DOUBLE <= -0.05 THEN 'negative' ELSE 'neutral' END AS label,
  (CASE WHEN round_even(printf('%.25f', ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) AS score,
  (CASE WHEN round_even(printf('%.25f', (abs((value % 2.0::DOUBLE) - 1.0::DOUBLE))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (abs((value % 2.0::DOUBLE) - 1.0::DOUBLE))::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (abs((value % 2.0::DOUBLE) - 1.0::DOUBLE))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) AS confidence
FROM events""")
def sen3_compound(spark, sf):
    ev = read_table(spark, sf, "events")
    label, score, conf = normalize_compound((F.col("value") % 2.0) - 1.0)
    return ev.select("event_id", label.alias("label"), score.alias("score"), conf.alias("confidence"))


@register("sen4_polarity", """SELECT event_id,
  CASE WHEN (value % 2.0::DOUBLE) - 1.0::DOUBLE > 0.1 THEN 'positive'
       WHEN (value % 2.0::DOUBLE) - 1.0::DOUBLE < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
  (CASE WHEN round_even(printf('%.25f', ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', ((value % 2.0::DOUBLE) - 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) AS score,
  (CASE WHEN round_even(printf('%.25f', (value % 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (value % 1.0::DOUBLE)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (value % 1.0::DOUBLE)::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) AS confidence
FROM events""")
def sen4_polarity(spark, sf):
    ev = read_table(spark, sf, "events")
    label, score, conf = normalize_polarity((F.col("value") % 2.0) - 1.0, F.col("value") % 1.0)
    return ev.select("event_id", label.alias("label"), score.alias("score"), conf.alias("confidence"))


# SEN-5: lexicon scorer, once per post ---------------------------------------------
@register("sen5_lexicon", scored_sql("SELECT post_id, scope, label, score, confidence FROM scored_posts"),
          headline=True)
def sen5_lexicon(spark, sf):
    return analysis(spark, sf).scored.select("post_id", "scope", "label", "score", "confidence")


# SEN-6 / UDF-1: pluggable batch model through mapInPandas (rows only) ----------------
@register("sen6_model", scored_sql("""SELECT post_id, scope, platform,
  CASE WHEN blank THEN 'neutral' WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative'
       ELSE 'neutral' END AS label,
  CASE WHEN blank THEN 0.0::DOUBLE WHEN c >= 0.05 THEN (CASE WHEN round_even(printf('%.25f', (abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (abs(c))::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END)
       WHEN c <= -0.05 THEN (CASE WHEN round_even(printf('%.25f', (-abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (-abs(c))::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (-abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) ELSE 0.0::DOUBLE END AS score,
  CASE WHEN blank THEN 0.0::DOUBLE ELSE (CASE WHEN round_even(printf('%.25f', (abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE = 0 THEN (abs(c))::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (abs(c))::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE END) END AS confidence
FROM comp"""))
def sen6_model(spark, sf):
    ps = posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    return model_scores(ps, lexicon_model_factory(P.lexicon), batch_size=32)


# SEN-8: attribution fan-out ----------------------------------------------------------
@register("sen8_fanout", full_sql("SELECT post_id, scope, entity, label, score, confidence FROM fanout"),
          headline=True)
def sen8_fanout(spark, sf):
    return analysis(spark, sf).sentiment.select("post_id", "scope", "entity", "label", "score",
                                                "confidence")


# SEN-9: label distribution per scope ----------------------------------------------------
@register("sen9_distribution", full_sql("""SELECT scope,
  count(*) FILTER (WHERE label = 'positive') AS positive,
  count(*) FILTER (WHERE label = 'negative') AS negative,
  count(*) FILTER (WHERE label NOT IN ('positive', 'negative')) AS neutral,
  count(*) AS total,
  (CASE WHEN round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'positive')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(*) FILTER (WHERE label = 'positive')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'positive')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END) AS positive_pct,
  (CASE WHEN round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'negative')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(*) FILTER (WHERE label = 'negative')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(*) FILTER (WHERE label = 'negative')::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END) AS negative_pct,
  (CASE WHEN round_even(printf('%.25f', (count(*) FILTER (WHERE label NOT IN ('positive', 'negative'))::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE = 0 THEN (count(*) FILTER (WHERE label NOT IN ('positive', 'negative'))::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE * 0.0::DOUBLE ELSE round_even(printf('%.25f', (count(*) FILTER (WHERE label NOT IN ('positive', 'negative'))::DOUBLE / count(*)::DOUBLE * 100)::DOUBLE)::DECIMAL(38, 25), 1)::DOUBLE END)
    AS neutral_pct
FROM fanout GROUP BY scope"""))
def sen9_distribution(spark, sf):
    return label_distribution(analysis(spark, sf).sentiment)


# JOIN-1: sentiment rows joined with their posts --------------------------------------------
@register("join1_sentiment_posts", full_sql("""SELECT f.post_id, f.entity, f.label, f.score,
  p.text, p.platform, p.scope, p.ts, p.url
FROM fanout f JOIN posts_v p USING (post_id)"""))
def join1_sentiment_posts(spark, sf):
    a = analysis(spark, sf)
    cols = posts(spark, sf).select("post_id", "text", "platform", "scope", "ts", "url")
    return a.sentiment.select("post_id", "entity", "label", "score").join(cols, "post_id")


# SRC-6: sentiment of one entity in one scope, with post columns ------------------------------
@register("src6_entity_sentiment", full_sql("""SELECT f.post_id, f.entity, f.label, f.score,
  p.text, p.platform, p.scope AS post_scope, p.ts, p.url
FROM fanout f JOIN posts_v p USING (post_id)
WHERE f.entity = 'Apache License' AND p.scope = 'en'"""))
def src6_entity_sentiment(spark, sf):
    a = analysis(spark, sf)
    s = a.sentiment.select("post_id", "entity", "label", "score")
    return sentiment_for_entity(s, posts(spark, sf), "Apache License", "en", ordered=True)


# SEN-7: tier resolution (configured tier first, then the next available one) -------------
# A model is at hand for the 'vader' tier only.  English asks for
# 'transformers' and falls forward to it; the other scopes ask for 'textblob',
# behind it in the order, and fall forward to the lexicon.
def _model_score(c: str) -> str:
    r = (f"round_even(printf('%.25f', ({c})::DOUBLE)::DECIMAL(38, 25), 4)::DOUBLE")
    return f"(CASE WHEN {r} = 0 THEN ({c})::DOUBLE * 0.0::DOUBLE ELSE {r} END)"


@register("sen7_tier", scored_sql(f"""SELECT s.post_id, s.label,
  CASE WHEN s.scope <> 'en' THEN s.score WHEN c.blank THEN 0.0::DOUBLE
       WHEN c.c >= 0.05 THEN {_model_score('abs(c.c)')} WHEN c.c <= -0.05 THEN {_model_score('-abs(c.c)')}
       ELSE 0.0::DOUBLE END AS score,
  CASE WHEN s.scope = 'en' THEN 'vader' ELSE 'lexicon' END AS tier
FROM scored_posts s JOIN comp c USING (post_id)"""))
def sen7_tier(spark, sf):
    from ..operators.sentiment import lexicon_scores, tier_scores
    scorers = {"vader": lambda ps, p: model_scores(ps, lexicon_model_factory(p.lexicon)),
               "lexicon": lexicon_scores}
    ps = posts(spark, sf).filter(F.col("scope").isin(list(P.scopes)))
    en = tier_scores(ps.filter("scope = 'en'"), P, "transformers", scorers)
    rest = tier_scores(ps.filter("scope <> 'en'"), P, "textblob", scorers)
    return en.unionByName(rest).select("post_id", "label", "score", "tier")


# SEN-5 with a lexicon of many words (every word of the texts that starts with a letter
# group gets a weight), on rows that share a post id
_BIG_LEX = """lexw AS (
  SELECT DISTINCT w, (CASE WHEN length(w) % 2 = 0 THEN 0.5 ELSE -0.25 END)::DOUBLE AS weight
  FROM (SELECT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS w FROM benchmark))"""


@register("sen5_large_lexicon", f"""WITH {_BIG_LEX},
t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(substr(text, 1, 1000)), '(\\p{{L}}+)', 1)) AS w
      FROM conversations),
s AS (SELECT conv_id, turn, sum(weight) AS s FROM t JOIN lexw USING (w) GROUP BY conv_id, turn),
c AS (SELECT c.conv_id AS post_id, c.turn, coalesce(s.s, 0.0) / sqrt(coalesce(s.s, 0.0) * coalesce(s.s, 0.0) + 15.0::DOUBLE) AS c
      FROM conversations c LEFT JOIN s USING (conv_id, turn))
SELECT post_id, turn, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS label
FROM c""")
def sen5_large_lexicon(spark, sf):
    from ..operators.sentiment import lexicon_scores
    words = read_table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("token")).distinct()
    lexicon = words.withColumn("weight", F.when(F.length("token") % 2 == 0, 0.5).otherwise(-0.25))
    c = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("post_id"), "turn", "text")
    return lexicon_scores(c, P, keep=("post_id", "turn"), lexicon=lexicon).select(
        "post_id", "turn", "label")
