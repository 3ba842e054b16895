"""Pluggable entity tagger (ENT-17 / UDF-2).

A user-supplied tagger runs over the posts with ``mapInPandas``; it is built
once per task and returns PERSON names per text.  Names of at least two
words from posts of at most ``max_chars`` characters are counted with a
(partial) ``groupBy``.  Without a tagger the result is empty, as in the
original.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TaggerFactory = Callable[[], Callable[[str], list[str]]]


def regex_person_tagger(pattern: str) -> TaggerFactory:
    """Stand-in tagger: every match of a Java-style name pattern (the
    ``(?U)`` prefix is Python's default for str patterns)."""
    import re
    py = pattern.replace("(?U)", "")

    def factory():
        rx = re.compile(py)
        return lambda t: rx.findall(t)
    return factory


def tag_entities(posts: DataFrame, tagger: TaggerFactory | None = None,
                 max_chars: int = 5000) -> DataFrame:
    spark = posts.sparkSession
    if tagger is None:
        return spark.createDataFrame([], "name string, count long")
    import pandas as pd

    def run(batches):
        tag = tagger()
        for pdf in batches:
            names = []
            for t in pdf["text"]:
                if t and len(t) <= max_chars:
                    names.extend(n for n in tag(t) if len(n.split()) >= 2)
            yield pd.DataFrame({"name": names}, dtype=object)

    found = posts.select("text").mapInPandas(run, "name string")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("count"))
