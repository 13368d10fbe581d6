"""Small document frames that the operator tests share."""

import random

from pyspark.sql import functions as F

from tests.conftest import SMOKE_DIR

# names that operators use inside
CLASHING = ["key", "fp", "h1", "spans", "words", "shard", "slot", "atom", "score", "least", "n", "part",
            "component_id", "hash", "span", "items", "terms", "n_words", "root", "found"]


def documents(spark, rows, clashing=True):
    """(doc_id, text) rows with the other columns of documents and clashing ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
        F.length("text").cast("long").alias("n_chars"))
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clashing else df


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edge_rows(seed=0):
    """Nulls, blanks, short and long texts, repeats and copies."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    long = sentence(rng, 6000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "one two three"),
            (7, long), (8, long), (8, long), (9, "x" * 70_000), (10, None), (11, "É é ÀB ﬁ 中文   á"),
            (12, passage), (13, "head " + passage + " tail"), (14, passage.upper()), (None, passage),
            (None, None), (15, "1 " * 3000), (16, "a.b@c.d " * 50)]
    return rows + [(20 + i, sentence(rng, 5 + 7 * i)) for i in range(12)]


def smoke(spark, name="documents"):
    return spark.read.parquet(f"{SMOKE_DIR}/{name}.parquet")


def empty(spark):
    return documents(spark, [], clashing=False)
