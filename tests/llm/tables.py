"""Small tables with every awkward row: nulls in any column, empty and very long texts, repeats, clashing names."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["n_words", "items", "hit_spans", "score", "held_out", "key", "found", "spans", "fp", "n", "component", "label", "bin_id", "shard", "cluster", "y", "host", "path", "contaminated", "n_hit", "__row"]


def prose(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents():
    long = prose(60_000, 9, 5000)
    base = prose(80, 1)
    near = base.split()
    near[40] = "changed"
    return [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, " ".join(near), "de", "c", 1), (4, "", "en", "a", 0), (5, None, "en", "a", None), (6, "one two", "en", "a", 7), (7, "ONE  Two", "en", None, 7),
        (8, long, None, "a", None), (9, " \t\n ", "en", "a", 4), (None, prose(50, 2), "en", "a", 3), (None, None, None, None, None), (10, prose(120, 3), "fr", "b", 9), (10, prose(120, 3), "fr", "b", 9),
        (11, "é ß 漢字 \U0001f600 " + prose(30, 4), "x", "b", 2), (12, "\x00 bell \x07 " + prose(9, 5), "x", "b", 2),
    ]


def frame(spark, rows=None, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
