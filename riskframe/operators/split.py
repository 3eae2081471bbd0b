"""Deterministic train/test split.

* ``hash_split``: test = ``md5(key)`` bucket 0 of ``round(1/test_size)`` buckets. Independent of
  partitioning and engine (``randomSplit`` is not: it depends on partition layout).
* ``stratified_split``: per stratum the first ``ceil(test_size * n)`` keys in md5 order are test. The cut is found by
  narrowing: counts by md5 prefix tell the one prefix that holds it, longer prefixes inside that one narrow it
  further, and only the few keys left are ranked. Every row is then decided by comparing its md5 with the cut, so
  rows are neither shuffled nor sorted. Rows that share a key go the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import md5_bucket
from ..session import kept, written
from . import ranking

RANKED_KEYS = 100_000  # rows of a stratum's prefix that are ranked at once; more are narrowed further
DIGITS = 32            # of an md5


def hash_split(df: DataFrame, key: str, test_size: float = 0.2) -> DataFrame:
    n = max(2, int(round(1 / test_size)))
    return df.withColumn("split", F.when(md5_bucket(key, n) == 0, "test").otherwise("train"))


def _cut(counts: DataFrame) -> DataFrame:
    """(stratum, prefix, need, n): of each stratum's (prefix, n, need) rows the one in which the need-th row lies, and how many are still
    needed inside it."""
    upto = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)  # at most 256 prefixes
    c = counts.withColumn("__cum", F.sum("n").over(upto)).where((F.col("__cum") >= F.col("need")) & (F.col("__cum") - F.col("n") < F.col("need")))
    return c.select("__s", F.col("__p").alias("__prefix"), (F.col("need") - F.col("__cum") + F.col("n")).alias("need"), "n")


def stratified_split(df: DataFrame, key: str, stratum: str, test_size: float = 0.2, prefix_len: int = 2, ranked: int = RANKED_KEYS) -> DataFrame:
    """``split`` is test or train; a stratum of one row makes it the plain hash split. A null stratum is a stratum, a null key reads as empty."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(F.col(stratum).alias("__s"), k.alias("__k"), F.md5(k).alias("__h"))
    counts = written(rows.groupBy("__s", F.substring("__h", 1, prefix_len).alias("__p")).agg(F.count(F.lit(1)).alias("n")), "split-counts")
    sizes = counts.groupBy("__s").agg(F.sum("n").alias("__all"))
    least = sizes.agg(F.min("__all").alias("least"), F.count(F.lit(1)).alias("strata")).first()
    if not least["strata"] or least["least"] < 2:  # too small to split by stratum: plain split
        return hash_split(df, key, test_size)
    n = least["strata"]
    need = sizes.select("__s", F.ceil(F.col("__all") * F.lit(test_size)).alias("need"))
    cuts = kept(_cut(ranking.join_small(counts, need, ["__s"], n)), n, "split-cuts")
    width = prefix_len
    inside = lambda: ranking.join_small(rows, cuts.select("__s", "__prefix", "need"), ["__s"], n).where(F.col("__h").startswith(F.col("__prefix")))
    while width < DIGITS and cuts.agg(F.max("n")).first()[0] > ranked:
        width = min(DIGITS, width + 2)
        longer = inside().groupBy("__s", F.substring("__h", 1, width).alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        cuts = kept(_cut(longer), n, "split-cuts")
    # the rows of one full md5 are one key, counted as one
    left = inside().groupBy("__s", "__h", "__k").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    upto = Window.partitionBy("__s").orderBy("__h", "__k").rowsBetween(Window.unboundedPreceding, 0)
    last = left.withColumn("__cum", F.sum("n").over(upto)).where((F.col("__cum") >= F.col("need")) & (F.col("__cum") - F.col("n") < F.col("need")))
    last = kept(last.select(F.col("__s").alias(stratum), F.struct("__h", "__k").alias("__last")), n, "split-last")
    test = F.struct(F.md5(k).alias("__h"), k.alias("__k")) <= F.col("__last")
    return ranking.join_small(df, last, [stratum], n).withColumn("split", F.when(test, "test").otherwise("train")).drop("__last")
