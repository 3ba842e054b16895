"""Fixtures: documents with nulls, empty and long texts, copies and clashing columns."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    base = [sentence(rng, 120) for _ in range(12)]
    out = []
    for i, t in enumerate(base):
        out.append((i, t))
    out.append((20, base[0]))                                          # exact copy
    out.append((21, base[0]))
    out.append((22, base[1].replace("w1 ", "x1 ", 1)))                # near copy
    out.append((23, base[1].upper()))                                  # folds to a copy
    out += [(30 + i, sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 30)) for i in range(5)]
    out += [(40, None), (41, ""), (42, " \t\n"), (43, "one"), (44, "one two three"), (45, "ONE two three")]
    out += [(46, sentence(rng, 20_000)), (47, "a" * 50_000), (None, base[2]), (None, None)]
    out += [(48, base[3]), (48, base[3]), (49, "x " * 300)]            # repeated row, one word
    return [(d, t, ("en", "de", None)[k % 3], ("a", "b", "c", None)[k % 4], len(t or ""))
            for k, (d, t) in enumerate(out)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DDL)


def clashing(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    for c in ("g", "size", "slot", "score", "n", "sig", "base", "spans", "bucket", "rank", "tok", "ids",
              "shard", "arc", "taken", "start", "part", "toxic", "words"):
        df = df.withColumn(c, F.lit(1))
    return df


def words_of(text):
    return (text or "").encode().split()
