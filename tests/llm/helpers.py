"""Small tables with the hard cases: nulls everywhere, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size", "h", "salt", "key", "id", "n", "row", "host", "src", "gone_id", "bucket", "line", "rank", "a", "u", "new_text")

WORDS = {"en": "the of and to in that for with was on are this from have not which".split(),
         "de": "der die und das nicht von mit sich auf für ist den dem ein werden".split(),
         "fr": "le la les des une dans pour que qui sur avec pas plus par est".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(spark, rows, extra: bool = False):
    df = spark.createDataFrame([tuple(r) + (None if r[1] is None else len(r[1]),) for r in rows], DOCS)
    return clash(df) if extra else df


def clash(df):
    """The table with further columns whose names an operator might use itself."""
    from pyspark.sql import functions as F
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def hard_rows(seed: int = 1):
    rng = random.Random(seed)
    rows = [(i, prose(rng, ("en", "de", "fr")[i % 3], 5 + i), ("en", "de", "fr")[i % 3], f"s{i % 4}") for i in range(24)]
    rows += [(100, None, "en", "s0"), (101, "", "de", None), (102, " \n\t ", None, "s1"), (103, "!!! 123 ---", "en", "s2"),
             (104, prose(rng, "fr", 30_000), "fr", None), (105, "x" * 20_000, None, "s9"), (None, "a null id of its own", "en", "s1"),
             (106, rows[3][1], "en", "s0"), (106, rows[3][1], "en", "s0"), (107, rows[3][1].upper(), None, "s0"),
             (108, "émoji 😀 ▁ \u3000 tab\tend\u0000", "fr", "s1")]
    return rows
