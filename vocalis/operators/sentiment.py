"""Sentiment scoring and attribution (SEN-1 .. SEN-9, UDF-1).

Scorers produce ``(label, score, confidence)`` per post, **once per post**,
before the fan-out to entities:

* ``lexicon_scores`` (SEN-5): a word -> weight lexicon joined with the row's
  tokens and summed per row (combined before the shuffle), then the compound normalisation ``s / sqrt(s^2 + 15)`` and the
  +-0.05 thresholds (SEN-3).
* ``model_scores`` (SEN-6 / UDF-1): a user-supplied batch model run with
  ``mapInPandas``; the model is built once per task and called on chunks of
  ``batch_size`` texts; a failing chunk falls back to one-by-one, a failing
  text is neutral.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_, round_half_even
from ..params import Params
from ..session import cut_lineage

TOKEN_RE = r"(\p{L}+)"
LABELS = ("positive", "negative", "neutral")
SCORE_COLUMNS = ("label", "score", "confidence")


# SEN-1 ----------------------------------------------------------------------
def scorer_input(text, max_chars: int = 1000) -> Column:
    """Text cut to ``max_chars`` characters; null stays null."""
    return F.substring(col_(text), 1, max_chars)


def is_blank(text) -> Column:
    return col_(text).isNull() | (col_(text) == "")


# SEN-2 ----------------------------------------------------------------------
def normalize_classifier(label, confidence) -> tuple[Column, Column, Column]:
    """Classifier output -> (label, score, confidence): a label containing
    'pos' / 'neg' (any case) maps to +c / -c; anything else is neutral, 0."""
    lab = F.lower(col_(label))
    c = col_(confidence).cast("double")
    out_label = (F.when(F.instr(lab, "pos") > 0, "positive")
                 .when(F.instr(lab, "neg") > 0, "negative").otherwise("neutral"))
    score = (F.when(out_label == "positive", round_half_even(c, 4))
             .when(out_label == "negative", round_half_even(-c, 4)).otherwise(F.lit(0.0)))
    return out_label, score, round_half_even(c, 4)


# SEN-3 ----------------------------------------------------------------------
def normalize_compound(compound) -> tuple[Column, Column, Column]:
    c = col_(compound).cast("double")
    label = (F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral"))
    return label, round_half_even(c, 4), round_half_even(F.abs(c), 4)


# SEN-4 ----------------------------------------------------------------------
def normalize_polarity(polarity, subjectivity) -> tuple[Column, Column, Column]:
    p = col_(polarity).cast("double")
    label = (F.when(p > 0.1, "positive").when(p < -0.1, "negative").otherwise("neutral"))
    return label, round_half_even(p, 4), round_half_even(col_(subjectivity).cast("double"), 4)


# SEN-5 ----------------------------------------------------------------------
def normalized_lexicon(lexicon: dict[str, float]) -> dict[str, float]:
    """Lower-cased words; of words that fold together the last one counts."""
    return {w.lower(): float(v) for w, v in lexicon.items()}


def compound(s: Column, alpha: float = 15.0) -> Column:
    return s / F.sqrt(s * s + F.lit(alpha))


# Lexicon rows (a word and a weight, ~40 bytes) up to which the list is broadcast.
BROADCAST_LEXICON_ROWS = 500_000


def lexicon_table(lexicon: DataFrame) -> DataFrame:
    """``token, weight`` rows of any number as one row per lower-cased token,
    broadcast up to a counted size.  Null tokens or weights add nothing; of
    words that fold together the largest weight counts (rows have no order)."""
    words = cut_lineage(lexicon.filter("token IS NOT NULL AND weight IS NOT NULL")
                        .groupBy(F.lower("token").alias("token"))
                        .agg(F.max(F.col("weight").cast("double")).alias("weight")))
    return F.broadcast(words) if words.count() <= BROADCAST_LEXICON_ROWS else words


def lexicon_scores(posts: DataFrame, p: Params, keep=("post_id", "scope", "platform"),
                   lexicon: DataFrame | None = None) -> DataFrame:
    """Score every row once: ``(*keep, label, score, confidence)``, with the
    words of ``p.lexicon`` or a ``lexicon`` table of ``token, weight`` rows.

    One path for lexicons of any size: each row's tokens are joined with the
    lexicon and summed per *row* (a row number, not an id, so copies that
    share an id are scored on their own).  A row's tokens sit in one partition,
    so the partial sum combines them before the shuffle, which carries the
    narrow ``keep`` columns and one number per row."""
    if lexicon is not None:
        words = lexicon_table(lexicon)
    else:
        lex = normalized_lexicon(p.lexicon)
        words = posts.sparkSession.createDataFrame(list(lex.items()), "token string, weight double")
        if len(lex) <= BROADCAST_LEXICON_ROWS:
            words = F.broadcast(words)
    text = scorer_input("text", p.max_score_chars)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RE), 1)
    numbered = posts.select(*keep, "text", F.monotonically_increasing_id().alias("_row"))
    rows = (numbered.select(*keep, "_row", is_blank(F.col("text")).alias("_blank"),
                            F.explode_outer(tokens).alias("token"))
            .join(words, "token", "left")
            .groupBy("_row", "_blank", *keep).agg(F.sum("weight").alias("_s")))
    label, score, conf = normalize_compound(F.col("_c"))
    blank = F.col("_blank")
    return (rows.withColumn("_c", compound(F.coalesce(F.col("_s"), F.lit(0.0))))
            .select(*keep,
                    F.when(blank, "neutral").otherwise(label).alias("label"),
                    F.when(blank, 0.0).otherwise(score).alias("score"),
                    F.when(blank, 0.0).otherwise(conf).alias("confidence")))


# SEN-6 / UDF-1 ----------------------------------------------------------------
ModelFactory = Callable[[], Callable[[list[str]], list[dict]]]


def model_scores(posts: DataFrame, model_factory: ModelFactory, batch_size: int = 32,
                 max_chars: int = 1000, keep=("post_id", "scope", "platform")) -> DataFrame:
    """Run a batch text classifier over the posts with ``mapInPandas``.

    ``model_factory()`` is called once per task and returns
    ``predict(texts) -> [{"label": str, "score": float}, ...]`` (classifier
    output, normalised with SEN-2 rules).
    """
    keep = list(keep)
    in_schema = posts.select(*keep).schema
    out_schema = T.StructType(list(in_schema.fields) + [
        T.StructField("raw_label", T.StringType()), T.StructField("raw_confidence", T.DoubleType())])

    def answer(predict, texts):
        res = predict(texts)
        if len(res) != len(texts):
            raise ValueError(f"model gave {len(res)} results for {len(texts)} texts")
        return [(str(r.get("label", "")), float(r.get("score", 0.0))) for r in res]

    def run(batches):
        predict = model_factory()
        for pdf in batches:
            texts = pdf["text"].tolist()
            out = [("neutral", 0.0)] * len(texts)
            for i in range(0, len(texts), batch_size):
                chunk = texts[i:i + batch_size]
                idx = [j for j, t in enumerate(chunk) if t]
                cut = [chunk[j][:max_chars] for j in idx]
                try:
                    for j, r in zip(idx, answer(predict, cut) if cut else []):
                        out[i + j] = r
                except Exception:  # noqa: BLE001 - the chunk is tried text by text
                    for j, t in zip(idx, cut):
                        try:
                            out[i + j] = answer(predict, [t])[0]
                        except Exception:  # noqa: BLE001 - a failing text is neutral
                            out[i + j] = ("neutral", 0.0)
            res = pdf[keep].copy()
            res["raw_label"] = [o[0] for o in out]
            res["raw_confidence"] = [o[1] for o in out]
            yield res

    raw = posts.select(*keep, "text").mapInPandas(run, out_schema)
    label, score, conf = normalize_classifier("raw_label", "raw_confidence")
    return raw.select(*keep, label.alias("label"), score.alias("score"), conf.alias("confidence"))


def lexicon_model_factory(lexicon: dict[str, float]) -> ModelFactory:
    """A tiny stand-in classifier (numpy) with the model contract: returns
    POSITIVE/NEGATIVE/NEUTRAL with a confidence in [0, 1]."""
    lex = normalized_lexicon(lexicon)

    def factory():
        def letters(t: str) -> list[str]:            # runs of letters, as TOKEN_RE
            return "".join(c if c.isalpha() else " " for c in t).split()

        def predict(texts: list[str]) -> list[dict]:
            out = []
            for t in texts:
                s = sum(lex.get(w, 0.0) for w in letters(t.lower()))
                c = s / math.sqrt(s * s + 15.0)
                lab = "POSITIVE" if c >= 0.05 else "NEGATIVE" if c <= -0.05 else "NEUTRAL"
                out.append({"label": lab, "score": abs(c)})
            return out
        return predict
    return factory


# SEN-7 ----------------------------------------------------------------------
TIERS = ("transformers", "vader", "textblob", "lexicon")


def resolve_tier(preferred: str, available: Iterable[str]) -> str:
    """The configured tier, else the next available one after it ('none' if
    there is none); an unknown tier starts at the first."""
    avail = set(available)
    start = TIERS.index(preferred) if preferred in TIERS else 0
    return next((t for t in TIERS[start:] if t in avail), "none")


def tier_scores(posts: DataFrame, p: Params, preferred: str, scorers: dict,
                keep=("post_id", "scope", "platform")) -> DataFrame:
    """Scores by the scorer of the resolved tier, with the tier's name.
    ``scorers``: tier -> ``(posts, params) -> (*keep, label, score,
    confidence)``; without any every post is neutral."""
    tier = resolve_tier(preferred, scorers)
    if tier == "none":
        scored = posts.select(*keep, F.lit("neutral").alias("label"), F.lit(0.0).alias("score"),
                              F.lit(0.0).alias("confidence"))
    else:
        scored = scorers[tier](posts, p)
    return scored.withColumn("tier", F.lit(tier))


def apply_confidence_threshold(scored: DataFrame, threshold: float | None) -> DataFrame:
    """Optional filter on confidence (configured but off by default)."""
    if threshold is None:
        return scored
    return scored.filter(F.col("confidence") >= threshold)


# SEN-8 ----------------------------------------------------------------------
def attribute(scored: DataFrame, entity_pairs: DataFrame) -> DataFrame:
    """One row per (post, mentioned entity); a post mentioning none gets one
    row for ``General``.  ``entity_pairs``: (post_id, entity)."""
    return (scored.join(entity_pairs.select("post_id", "entity"), "post_id", "left")
            .withColumn("entity", F.coalesce(F.col("entity"), F.lit("General"))))


# SEN-9 ----------------------------------------------------------------------
def label_distribution(sentiment: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    out = sentiment.groupBy("scope").agg(
        F.count_if(F.col("label") == "positive").alias("positive"),
        F.count_if(F.col("label") == "negative").alias("negative"),
        F.count_if(~F.col("label").isin("positive", "negative")).alias("neutral"),
        total.alias("total"))
    for lab in ("positive", "negative", "neutral"):
        out = out.withColumn(f"{lab}_pct", round_half_even(F.col(lab) / F.col("total") * 100, 1))
    return out
