"""Small tables with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)


def words(n, seed, vocabulary=500):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def awkward():
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, other alphabets, odd spaces."""
    long = " ".join(words(30_000, 1, 5_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "One Two ÄÖ ß 漢字 😀"), (7, long), (8, long + " end"),
        (9, "same row"), (9, "same row"), (None, "no id"), (None, None), (10, "a\x0bb\x0cc\rd"), (11, "ONE"), (-5, "one"),
    ]


def with_clashes(df):
    """The same table with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    clash = ("key", "fp", "_norm", "_rank", "_hash", "count", "n", "a", "b", "row", "uid", "words", "block", "score", "kind", "start", "end", "pos", "label", "source_id", "view", "root", "vertex", "text_sha256", "keep_id", "kept", "_row", "bucket", "batch", "component_id", "position", "length", "_key_1", "_key_2", "_key_1_0", "_key_2_0", "_r", "place")
    return df.select(*df.columns, *(F.lit("x").alias(c) for c in clash if c not in df.columns))
