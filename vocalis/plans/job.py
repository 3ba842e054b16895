"""Batch job entry point (the original's analysis-only command-line run,
re-aimed as a Spark application).

    python -m vocalis.plans.job --posts /shared/posts --out /shared/analysis \
        --scopes Lagos Kano --stop-words stop.txt
    (with spark-submit: ship the package with ``--py-files`` and submit a
    launcher that calls ``vocalis.plans.job.main()``)

Reads stored posts (Parquet written by ``sinks.io.write_posts``), runs the
whole analysis (PIPE-1) with the election binding, writes the entity and
sentiment tables partitioned by scope (rerun-safe), the report tables (PIPE-2)
and the exports behind their switches (SNK-8).  Scraping is not part of it: landed payloads are
normalized by the ``operators.normalize`` functions beforehand (PIPE-3).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from ..params import Params, election_params, load_word_list
from ..session import get_spark
from ..sinks import io as IO
from ..sources.posts import restrict
from .pipeline import run_analysis, write_report


def parse_args(argv=None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="vocalis-job", description=__doc__.split("\n\n")[0])
    ap.add_argument("--posts", required=True, help="stored posts (Parquet)")
    ap.add_argument("--out", required=True, help="output folder (shared storage)")
    ap.add_argument("--scopes", nargs="*", default=None, help="scope override")
    ap.add_argument("--platforms", nargs="*", default=None, help="enabled platforms")
    ap.add_argument("--stop-words", default=None, help="general stop-word list, one per line")
    ap.add_argument("--no-posts-json", action="store_true")
    ap.add_argument("--no-posts-csv", action="store_true")
    ap.add_argument("--no-sentiment-json", action="store_true")
    ap.add_argument("--no-profiles-json", action="store_true")
    return ap.parse_args(argv)


def params_from(args: argparse.Namespace, base: Params | None = None) -> Params:
    p = base or election_params(
        stop_words=load_word_list(args.stop_words) if args.stop_words else None)
    if args.scopes:
        p = p.with_(scopes=tuple(args.scopes))
    return p


def run(spark: SparkSession, args: argparse.Namespace, base: Params | None = None) -> dict:
    p = params_from(args, base)
    posts = restrict(spark.read.parquet(args.posts), p.scopes or None, args.platforms)
    a = run_analysis(posts, p)
    IO.write_entities(a.entities, os.path.join(args.out, "entities"))
    IO.write_sentiment(a.sentiment, os.path.join(args.out, "sentiment"))
    exports = IO.export_all(
        a.posts, a.sentiment.select("post_id", "entity", "label", "score", "confidence"),
        a.part("profiles"), os.path.join(args.out, "exports"),
        posts_json=not args.no_posts_json, posts_csv=not args.no_posts_csv,
        sentiment_json=not args.no_sentiment_json, profiles_json=not args.no_profiles_json)
    report = {f"report_{k}": v for k, v in write_report(a, os.path.join(args.out, "report")).items()}
    exports.update(report)
    return {"entities": os.path.join(args.out, "entities"),
            "sentiment": os.path.join(args.out, "sentiment"), **exports}


def main(argv=None) -> None:
    args = parse_args(argv)
    spark = get_spark(app="vocalis-job")
    for name, path in run(spark, args).items():
        print(f"{name}: {path}")


if __name__ == "__main__":
    main()
