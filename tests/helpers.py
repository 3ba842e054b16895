import datetime as dt

from vocalis.params import election_params

# A small general stop list for the tests (the full list is the caller's).
TEST_STOP_WORDS = ("the", "and", "is", "for", "of", "national", "assembly", "polling",
                   "officer", "electronic", "transmission", "rock", "party", "congress",
                   "progressives", "peoples", "democratic", "somebody")

EP = election_params(scopes=("Lagos", "Kano"), stop_words=TEST_STOP_WORDS)

POST_DDL = ("post_id long, platform string, scope string, text string, author string, "
            "ts timestamp_ntz, url string, likes long, shares long, keyword string")


def make_posts(spark, rows, scope="Lagos"):
    """rows: text, (text, platform), (text, platform, scope) or dicts."""
    out = []
    base = dt.datetime(2024, 1, 1)
    for i, r in enumerate(rows):
        if r is None or isinstance(r, str):
            r = {"text": r}
        elif isinstance(r, tuple):
            r = dict(zip(("text", "platform", "scope"), r))
        out.append((i + 1, r.get("platform", "nairaland"), r.get("scope", scope), r.get("text"),
                    r.get("author", "a"), base + dt.timedelta(hours=i), f"https://x/{i}",
                    r.get("likes", 0), r.get("shares", 0), "kw"))
    return spark.createDataFrame(out, POST_DDL)
