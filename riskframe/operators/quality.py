"""Data-quality checks: required columns, missing counts, duplicate keys, report, extreme values.

Each check is one aggregate pass whose result is a tidy table (one row per column/check), so a whole
table's profile costs one scan regardless of the number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def required_columns(df: DataFrame, required: list[str], table: str) -> DataFrame:
    """One row per required column: present flag and non-null count (0 when absent)."""
    present = [c for c in required if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in present])
    parts = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                      F.lit(c in present).alias("present"),
                      (F.col(c) if c in present else F.lit(0)).cast("bigint").alias("non_null"))
             for c in required]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing count and percent for every column, one aggregate: ``column_name, missing, missing_pct``."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    parts = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("missing"))
             for i, c in enumerate(cols)]
    out = row.select("__rows", F.explode(F.array(*parts)).alias("s")).select("__rows", "s.*")
    return out.select("column_name", "missing",
                      (F.col("missing") * 100.0 / F.col("__rows")).alias("missing_pct"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key value (null keys count as one value): ``rows, distinct_keys, duplicates``.

    Exact distinct count by a grouped aggregate (shuffle on the key, partial aggregation first), not a
    single-task ``countDistinct``.
    """
    per_key = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys")) \
        .select(F.coalesce(F.col("rows"), F.lit(0)).alias("rows"), "distinct_keys",
                (F.coalesce(F.col("rows"), F.lit(0)) - F.col("distinct_keys")).alias("duplicates"))


def quality_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: name, type, missing count and percent, plus table rows/columns."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    m = missing_counts(df).where(F.col("missing") > 0)
    tmap = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    return m.select("column_name", F.element_at(tmap, F.col("column_name")).alias("dtype"), "missing",
                    "missing_pct", F.lit(len(df.columns)).alias("n_columns"))


def extreme_values(stats: DataFrame, limit: float = 1e6) -> DataFrame:
    """Flag features whose absolute min or max exceeds ``limit`` (from a describe/feature-stats table)."""
    return stats.withColumn("extreme", (F.abs(F.col("max")) > limit) | (F.abs(F.col("min")) > limit))
