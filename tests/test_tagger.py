"""Pluggable entity tagger (ENT-17 / UDF-2)."""

from helpers import make_posts
from vocalis.operators.mentions import NAME_RE
from vocalis.operators.tagger import regex_person_tagger, tag_entities


def test_no_tagger_is_empty(spark):
    posts = make_posts(spark, ["Peter Obi met Bola Tinubu"])
    assert tag_entities(posts).count() == 0


def test_stand_in_tagger_counts_multiword_names(spark):
    posts = make_posts(spark, ["Peter Obi met Bola Tinubu", "Peter Obi again", "x" * 6000 + " Long Post"])
    got = {r["name"]: r["count"] for r in tag_entities(posts, regex_person_tagger(NAME_RE)).collect()}
    assert got == {"Peter Obi": 2, "Bola Tinubu": 1}   # the > 5,000-char post is skipped
