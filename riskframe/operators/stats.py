"""Descriptive statistics: shares, describe, target stats, correlations, histograms, cuts, box stats.

Everything is one or two aggregate passes. Scalars that parametrise a later pass (min/max, cut edges)
are a handful of numbers collected from a one-row aggregate; order statistics use the distributed
two-level ranking of ``ranking.py`` (never one task per feature).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import ranking


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Normalised value counts (nulls excluded): ``col, n, share``. The total is a one-row aggregate
    joined back as a scalar (no unpartitioned window)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return ranking.join_small(counts, total, [], 1).select(col, "n", (F.col("n") / F.col("__total")).alias("share"))


def unpivot_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "value")


def value_shares_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Shares of each value of several categorical columns in one pass: ``feature, value, n, share``."""
    long = unpivot_strings(df, cols).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("__total"), F.countDistinct("value").alias("nunique"))
    out = ranking.join_small(counts, totals, ["feature"], len(cols))
    return out.select("feature", "value", "n", (F.col("n") / F.col("__total")).alias("share"), "nunique")


def unpivot_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")


def describe(df: DataFrame, cols: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, exact linear quartiles, max per numeric column (long format).

    Unlike ``DataFrame.summary()`` (approximate percentiles) the quartiles are exact.
    """
    quantiles = quantiles or {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    out = ranking.described(unpivot_numeric(df, cols), ["feature"], "value", quantiles)
    return out.select("feature", F.col("n").alias("count"), "mean", "std", "min", *quantiles.keys(), "max")


def corr_with_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson correlation of every column with the target in one aggregate: ``feature, corr``."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    stacked = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"))
                                             for c in cols])).alias("s")).select("s.*")
    return stacked


WIDE_PAIRS = 16  # so many correlations go side by side in one aggregate; more outgrow generated code and run interpreted
TILE = 4         # columns of a block when there are more: two blocks are a tile of at most TILE * TILE pairs


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise Pearson correlations (rows with a null in either column skipped, like pandas): ``f1, f2, corr`` for
    every ordered pair. Up to WIDE_PAIRS pairs are one aggregate. More columns are cut into blocks; each tile of two blocks is an
    aggregate that reads its own columns only, of a table that was written once, so no row is ever multiplied."""
    d = {c: F.col(c).cast("double") for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    corrs = lambda rows, own: rows.agg(*[F.corr(d[a], d[b]).alias(f"{i}") for i, (a, b) in enumerate(own)])
    if len(pairs) <= WIDE_PAIRS:
        stacked = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
        half = corrs(df, pairs).select(F.explode(stacked).alias("s")).select("s.*")
    else:
        once = written(df.select(*[d[c].alias(c) for c in cols]), "correlated")
        blocks = [cols[i:i + TILE] for i in range(0, len(cols), TILE)]
        tiles = [[(a, b) for i, a in enumerate(x) for b in (x[i:] if x is y else y)] for k, x in enumerate(blocks) for y in blocks[k:]]
        found = [(a, b, c) for own in tiles for (a, b), c in zip(own, corrs(once, own).first())]  # one number a pair of columns
        half = df.sparkSession.createDataFrame(found, "f1 string, f2 string, corr double")
    return half.unionByName(half.where("f1 <> f2").select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "corr"))


def shown_columns(df: DataFrame, cols: list[str], target: str | None = None, most: int = 20, keep: int = 15) -> list[str]:
    """Columns of the displayed correlation matrix: all up to ``most``; of more, the ``keep`` most correlated with the
    target plus the target, or the first ``keep`` without one."""
    if len(cols) <= most:
        return list(cols)
    if target is None or target not in df.columns:
        return list(cols[:keep])
    c = corr_with_target(df, cols, target).where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    top = [r["feature"] for r in topk_by(c, "corr", keep).collect()]  # at most ``keep`` names
    return top + ([target] if target not in top else [])


def min_max(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    row = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    return row["mn"], row["mx"]


def equal_width_bin(col, mn: float, mx: float, bins: int):
    """Histogram bin (numpy rule: equal width over [min, max], last bin closed)."""
    c = F.col(col) if isinstance(col, str) else col
    if mx == mn:
        return F.when(c.isNotNull(), F.lit(0))
    b = F.floor((c - F.lit(mn)) * F.lit(float(bins)) / F.lit(mx - mn)).cast("int")
    return F.least(b, F.lit(bins - 1))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram with all bins (empty ones count 0): ``bin, lo, hi, n``."""
    mn, mx = min_max(df, col)
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if mn is None:
        return grid.select("bin", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                           F.lit(0).cast("bigint").alias("n"))
    counts = df.where(F.col(col).isNotNull()).groupBy(equal_width_bin(col, mn, mx, bins).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    width = (mx - mn) / bins
    out = grid.join(F.broadcast(counts), "bin", "left")  # <= bins rows
    return out.select("bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
                      (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def cut_edges(mn: float, mx: float, bins: int = 5) -> list[float]:
    """Equal-width cut edges; the first edge is lowered by 0.1 % of the range (right-closed bins)."""
    if mx == mn:
        adj = abs(mn) * 0.001 if mn != 0 else 0.001
        return [mn - adj] + [mn - adj + i * ((2 * adj) / bins) for i in range(1, bins)] + [mx + adj]
    step = (mx - mn) / bins
    return [mn - (mx - mn) * 0.001] + [mn + i * step for i in range(1, bins)] + [mx]


def bin_case(col, edges: list[float]):
    """Right-closed bin index for ascending edges: ``x <= e1 -> 0 ... x <= ek -> k-1``; outside
    ``[e0, ek]`` or null -> null."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.when(c.isNull() | (c < F.lit(edges[0])) | (c > F.lit(edges[-1])), F.lit(None))
    for i in range(1, len(edges)):
        expr = expr.when(c <= F.lit(edges[i]), F.lit(i - 1))
    return expr


def cut(df: DataFrame, col: str, bins: int = 5) -> tuple[DataFrame, list[float]]:
    mn, mx = min_max(df, col)
    if mn is None:
        return df.withColumn(f"{col}_bin", F.lit(None).cast("int")), []
    edges = cut_edges(mn, mx, bins)
    return df.withColumn(f"{col}_bin", bin_case(col, edges)), edges


def qcut_edges(df: DataFrame, col: str, q: int = 5) -> list[float]:
    """Quantile edges at 0, 1/q, ..., 1 (exact, linear) with duplicates removed."""
    probs = [i / q for i in range(q + 1)]
    res = ranking.quantiles_of(df.select(F.col(col).cast("double").alias("__v")), [], "__v", probs)
    by_p = {p: q for (_, p), q in res.items()}
    edges = [by_p[round(p, 12)] for p in probs]
    out: list[float] = []
    for e in edges:
        if not out or e != out[-1]:
            out.append(e)
    return out


def qcut(df: DataFrame, col: str, q: int = 5) -> tuple[DataFrame, list[float]]:
    edges = qcut_edges(df, col, q)
    if len(edges) < 2:
        return df.withColumn(f"{col}_qbin", F.when(F.col(col).isNotNull(), F.lit(0))), edges
    return df.withColumn(f"{col}_qbin", bin_case(col, edges)), edges


def box_stats(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Box-plot numbers per group: min, q1, median, q3, max, count."""
    base = df.select(F.col(group_col).alias("grp"), F.col(value_col).cast("double").alias("v"))
    d = ranking.described(base, ["grp"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return d.select(F.col("grp").alias(group_col), F.col("n").alias("count"), "min", "max", "q1", "median", "q3")


def class_balance(df: DataFrame, col: str) -> DataFrame:
    """Share of each class in percent."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return ranking.join_small(counts, total, [], 1).select(col, "n", (F.col("n") * 100.0 / F.col("__total")).alias("pct"))


def topk_by(df: DataFrame, order_col: str, k: int, ascending: bool = False) -> DataFrame:
    """Global top-k (Spark plans TakeOrderedAndProject: per-partition top-k, then a k-row merge)."""
    o = F.col(order_col).asc_nulls_last() if ascending else F.col(order_col).desc_nulls_last()
    return df.orderBy(o).limit(k)

