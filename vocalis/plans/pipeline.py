"""End-to-end plans (PIPE-1 .. PIPE-3).

``run_analysis`` is the whole analysis as one lazily-built set of
DataFrames: discover -> score once per post -> attribute -> profile parts.
Two results are written to the checkpoint folder because many parts read
them: the scored posts (SEN-*) and the entity/post pairs.  Nothing loops
over scopes or entities on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import profile as prof
from ..operators import report as R
from ..operators.entities import Discovery, discover, entity_table, scoped_posts
from ..operators.sentiment import apply_confidence_threshold, attribute, lexicon_scores
from ..params import Params
from ..session import cut_lineage
from ..sinks import io as IO


@dataclass
class Analysis:
    params: Params
    posts: DataFrame
    discovery: Discovery
    entities: DataFrame          # (scope, name, mention_count, platforms, score, ...)
    scored: DataFrame            # one row per post: label, score, confidence
    sentiment: DataFrame         # fan-out incl. General
    entity_sentiment: DataFrame  # fan-out rows of accepted entities
    pairs: DataFrame             # (post_id, scope, entity)
    entity_posts: DataFrame      # pairs + post columns
    by_post: DataFrame           # the same, one row per post with its entities
    counted: DataFrame           # pairs + the post columns that are counted, without the text
    _cache: dict = field(default_factory=dict)

    def part(self, name: str) -> DataFrame:
        """Profile parts, built on first use."""
        if name not in self._cache:
            p, counted, by_post = self.params, self.counted, self.by_post
            build = {
                "summary": lambda: prof.sentiment_summary(self.entities, self.entity_sentiment),
                "platforms": lambda: prof.platform_breakdown(self.entity_sentiment),
                "excerpts": lambda: prof.top_excerpts(self.entity_sentiment, self.posts, p),
                "themes": lambda: prof.key_themes(by_post, p),
                "audience": lambda: prof.platform_audience(counted),
                "support": lambda: prof.support_indicators(by_post, p),
                "regions": lambda: prof.regional_mentions(by_post, p),
                "engagement": lambda: prof.engagement(self.entities, counted),
                "profiles": lambda: prof.build_profiles(self.entities, self.entity_sentiment,
                                                        by_post, self.posts, p),
            }[name]
            self._cache[name] = build()
        return self._cache[name]


def run_analysis(posts: DataFrame, p: Params, scorer=None,
                 discovery: Discovery | None = None) -> Analysis:
    """PIPE-1.  ``scorer(posts, params) -> (post_id, scope, platform, label,
    score, confidence)``; the lexicon scorer by default.  A discovery already
    computed for the same posts and params can be passed in."""
    posts = scoped_posts(posts, p)
    d = discovery if discovery is not None else discover(posts, p)
    entities = cut_lineage(entity_table(d))
    scored = (scorer or lexicon_scores)(posts, p)
    scored = cut_lineage(apply_confidence_threshold(scored, p.confidence_threshold))
    pairs = cut_lineage(prof.entity_pairs(d.pairs, entities))
    # narrow rows (ids, label, score) read by many parts: persisted once
    sentiment = attribute(scored, pairs).persist(StorageLevel.MEMORY_AND_DISK)
    entity_sentiment = sentiment.filter(F.col("entity") != "General")
    # Posts mentioning an accepted entity, one row per post: the (id-only) pairs
    # grouped and joined with the post columns by post_id.  Spark's runtime
    # bloom filter prunes the posts side to the ids present, so only the posts
    # that mention an entity are shuffled -- usually a small share of the corpus.
    # The profile parts that read texts use it: persisted once (recomputed from
    # the checkpointed pairs and a posts scan if an executor is lost).  Audience
    # and engagement join the pairs with numbers alone, so that they alone keep
    # no text in the executors' memory.
    by_post = prof.posts_with_entities(pairs, posts).persist(StorageLevel.MEMORY_AND_DISK)
    return Analysis(p, posts, d, entities, scored, sentiment, entity_sentiment, pairs, prof.per_entity(by_post), by_post,
                    prof.counted_posts(pairs, posts))


# PIPE-2 ---------------------------------------------------------------------
def generate_report(a: Analysis) -> dict[str, DataFrame]:
    """The tables a report per scope is made of, by name."""
    summary = a.part("summary")
    return {
        "executive_summary": prof.executive_summary(a.entities, a.part("engagement")),
        "ranking": R.ranking_table(a.entities, summary),
        "platforms": R.platform_table(a.part("platforms")),
        "details": R.detail_table(a.entities, a.part("themes"), a.part("excerpts"), a.part("support"),
                                  a.part("engagement")),
        "excerpts": R.excerpt_table(a.part("excerpts")),
        "audience": R.audience_table(a.part("audience")),
        "regions": R.region_table(a.part("regions")),
    }


def write_report(a: Analysis, path: str) -> dict[str, str]:
    """Write each report table below ``path``, one folder per scope; returns the folders."""
    done = {}
    for name, table in generate_report(a).items():
        done[name] = f"{path.rstrip('/')}/{name}"
        table.write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy("scope").json(done[name])
    return done


# PIPE-3 ---------------------------------------------------------------------
@dataclass
class Landed:
    """What the crawlers landed, one frame per payload; None is left out."""
    forum_pages: DataFrame | None = None
    submissions: DataFrame | None = None
    comments: DataFrame | None = None
    tweets: DataFrame | None = None
    page_posts: DataFrame | None = None
    page_comments: DataFrame | None = None


def normalized_posts(landed: Landed, p: Params, scope, keyword, page_scope=None,
                     graph_scope=None) -> DataFrame:
    """All payloads as one frame of posts (native ids)."""
    build = {
        "forum_pages": lambda d: N.forum_posts(d, scope if page_scope is None else page_scope, p),
        "submissions": lambda d: N.submission_posts(d, scope, keyword, p),
        "comments": lambda d: N.comment_posts(d, scope, keyword, p),
        "tweets": lambda d: N.tweet_posts(d, scope, keyword, p),
        "page_posts": lambda d: N.page_posts(d, scope if graph_scope is None else graph_scope, keyword, p),
        "page_comments": lambda d: N.page_comment_posts(d, scope, keyword, p),
    }
    frames = [f(getattr(landed, k)) for k, f in build.items() if getattr(landed, k) is not None]
    return N.union_posts(*frames)


def ingest(spark: SparkSession, landed: Landed, path: str, p: Params, scope, keyword,
           page_scope=None, graph_scope=None) -> DataFrame:
    """Normalise, store (each row gets its own ``post_id``) and tally what the
    store then holds."""
    IO.write_posts(normalized_posts(landed, p, scope, keyword, page_scope, graph_scope), path)
    return N.run_tally(spark.read.parquet(path).select("platform", "scope"))
