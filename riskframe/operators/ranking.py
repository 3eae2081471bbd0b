"""Distributed order statistics: exact quantiles, two-sample KS, percentile-of-score.

All three need, per group (feature), the cumulative count of values up to each distinct value. A window
``partitionBy(group).orderBy(value)`` would put a whole feature on one task, and Spark's exact
``percentile`` merges one value->count map per group in one task. Both break when one feature holds a
large share of 100 TB. Instead (two levels):

1. ``groupBy(group, value)`` -> distinct values with counts (map-side partial aggregation, so a hot
   value collapses before the shuffle).
2. Every group is cut into B value ranges: ``percentile_approx`` per group over the distinct values gives the
   range edges (a bounded sketch per group); every distinct value gets its range index ``#edges < value``.
3. Per (group, range) totals -> a small table (groups x B rows); an exclusive prefix over ranges gives
   each range's offset (window over <= B rows per group).
4. Window ``partitionBy(group, range).orderBy(value)`` -> running count inside the range, plus offset
   = exact global cumulative count. Each task sorts only ~1/B of a feature's distinct values.

Quantiles of large groups rank only a part: ``summary`` takes the moments and a mergeable KLL sketch of every group in one
aggregate and writes them (one row a group), ``quantiles`` brackets the wanted order statistics by the sketch and sends every value
to its cell between the brackets' edges. Values outside the brackets are only counted by cell, in the same aggregate
that keeps the few values inside them: two scans, no row is ever copied, nothing passes through the driver.

``cumulative_counts`` (totals included) is one job. B follows the session's shuffle partitions, which a
cluster sets for its data, and never a guess about sizes; the sketch's accuracy grows with B, and AQE merges small
ranges. Small per-group tables (edges, offsets) are joined without hints: AQE broadcasts them after
measuring their size at run time.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import exact_avg
from ..session import kept, written

BROADCAST_MAX_BYTES = 64 << 20
SKETCH_ACCURACY = 10_000
SKETCH_K = 4000      # size of the KLL sketch of a group


def _ranges_for(df: DataFrame, n_ranges: int | None) -> int:
    """Value ranges per group: as many as the session's shuffle partitions, two at least."""
    return max(1, int(n_ranges)) if n_ranges is not None else max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _maybe_broadcast(df: DataFrame, n_rows: int) -> DataFrame:
    """A hint only if the known row count times the schema's row width is small."""
    width = max(16, sum(64 if f.dataType.simpleString() in ("string", "binary") else 16 for f in df.schema.fields))
    return F.broadcast(df) if n_rows * width <= BROADCAST_MAX_BYTES else df


def join_small(big: DataFrame, small: DataFrame, on: list[str], n_small: int | None, how: str = "inner") -> DataFrame:
    """Join with a small table on equal keys, null equal to null: a null group is a group like any other. Broadcast hint only under
    a known row bound; otherwise AQE decides from the measured size at run time. With no keys the small side is a
    per-query constant row set, joined on a constant key."""
    if on:
        small = small.withColumnsRenamed({c: f"__on_{i}" for i, c in enumerate(on)})
    if n_small is not None:
        small = _maybe_broadcast(small, n_small)
    if on:
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__on_{i}")) for i, c in enumerate(on)])
        return big.join(small, same, how).drop(*[f"__on_{i}" for i in range(len(on))])
    k = "__const_key"
    return big.withColumn(k, F.lit(0)).join(small.withColumn(k, F.lit(0)), k, "inner").drop(k)


def range_index(edges: Column, value: Column, n_edges: int) -> Column:
    """Number of (sorted) edges below ``value`` by binary search: ceil(log2(n_edges + 1)) probes."""
    steps = max(1, math.ceil(math.log2(n_edges + 1)))
    seq = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])

    def probe(acc, step):
        nxt = acc + step
        return F.when(F.try_element_at(edges, nxt) < value, nxt).otherwise(acc)

    return F.aggregate(seq, F.lit(0), probe)


def cumulative_counts(df: DataFrame, group_cols: list[str], value_col: str, weights: dict[str, Column] | None = None,
                      n_ranges: int | None = None, keep_range: bool = False) -> DataFrame:
    """Distinct values per group with counts, inclusive running counts and group totals, in one job.

    ``weights`` maps an output name to a 0/1 (or count) column; default ``{"n": 1}``. Returns
    ``group_cols, value, <w>, cum_<w>, total_<w>``, with ``keep_range`` also ``__range``, the value range. Null values are ignored.
    """
    weights = weights or {"n": F.lit(1)}
    g = list(group_cols)
    base = df.where(F.col(value_col).isNotNull()).select(
        *[F.col(c) for c in g], F.col(value_col).alias("value"),
        *[w.cast("bigint").alias(name) for name, w in weights.items()])
    distinct = base.groupBy(*g, "value").agg(*[F.sum(n).alias(n) for n in weights])
    b = _ranges_for(df, n_ranges)
    if b == 1:
        # Asked for: running count and total share one partitioning (one exchange).
        w = Window.partitionBy(*g).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        wt = Window.partitionBy(*g)
        return distinct.select(*g, "value", *([F.lit(0).alias("__range")] if keep_range else []), *weights.keys(),
                               *[F.sum(n).over(w).alias(f"cum_{n}") for n in weights],
                               *[F.sum(n).over(wt).alias(f"total_{n}") for n in weights])
    # Ranges balanced by distinct values (what a window task sorts), from a bounded sketch per group.
    probs = [i / b for i in range(1, b)]
    edges = distinct.groupBy(*g).agg(F.percentile_approx("value", probs, max(SKETCH_ACCURACY, 100 * b)).alias("__edges"))
    d = join_small(distinct, edges, g, None)
    d = d.withColumn("__range", range_index(F.col("__edges"), F.col("value"), b - 1)).drop("__edges")
    rng = d.groupBy(*g, "__range").agg(*[F.sum(n).alias(f"__r_{n}") for n in weights])
    w_rng = Window.partitionBy(*g).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*g)
    offsets = rng.select(*g, "__range",
                         *[F.coalesce(F.sum(f"__r_{n}").over(w_rng), F.lit(0)).alias(f"__off_{n}") for n in weights],
                         *[F.sum(f"__r_{n}").over(w_all).alias(f"total_{n}") for n in weights])
    d = join_small(d, offsets, g + ["__range"], None)  # groups x ranges rows; AQE broadcasts it
    w_in = Window.partitionBy(*g, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(*g, "value", *(["__range"] if keep_range else []), *weights.keys(),
                    *[(F.sum(n).over(w_in) + F.col(f"__off_{n}")).alias(f"cum_{n}") for n in weights],
                    *[F.col(f"total_{n}") for n in weights])


def quantiles_wide(df: DataFrame, group_cols: list[str], value_col: str, named: dict[str, float],
                   n_ranges: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas ``quantile`` / SQL ``percentile_cont``) as columns.

    For each probability the 0-based ranks ``floor((n-1)p)`` and ``ceil((n-1)p)`` are located among the
    running counts; one grouped aggregate picks both values for every probability.
    """
    g = list(group_cols)
    ranked = cumulative_counts(df, g, value_col, None, n_ranges)
    return _pick(ranked, g, named, F.col("total_n"), F.col("cum_n") - F.col("n"), F.col("cum_n"))


def sketch_error(k: int) -> float:
    """Rank error of a KLL sketch of size k, as a share of the rows (with 99 % confidence; a miss is found and made good)."""
    return 2.296 / k ** 0.9021


def summary(df: DataFrame, group_cols: list[str], value_col: str, k: int = SKETCH_K, moments: bool = True) -> DataFrame:
    """One row a group, also of nulls alone: ``n, mean, std, min, max, sketch`` of the values (mean and std only with ``moments``), one
    aggregate, written once. Sketches of parts (days, runs) merge with ``kll_merge_agg_double``."""
    g = list(group_cols)
    base = df.select(*g, F.col(value_col).cast("double").alias("__v"))
    aggs = [F.count("__v").alias("n"), *([exact_avg("__v").alias("mean"), F.stddev_samp("__v").alias("std")] if moments else []), F.min("__v").alias("min"),
            F.max("__v").alias("max"), F.kll_sketch_agg_double("__v", k).alias("sketch")]
    return written(base.groupBy(*g).agg(*aggs) if g else base.agg(*aggs), "summary")


def quantiles(df: DataFrame, group_cols: list[str], value_col: str, named: dict[str, float], of: DataFrame | None = None, k: int = SKETCH_K) -> DataFrame:
    """Exact linear quantiles, ``group_cols`` + one column per named probability; groups without values are absent.

    ``of``: the groups' ``summary`` of the same rows, if it is there already. The sketch's quantiles at p -/+ three rank errors
    bracket the order statistics for p. The brackets' edges cut the values into cells: 2i is the open interval below the i-th edge,
    2i + 1 the edge itself. One aggregate counts by cell, and by value too where a cell lies inside a bracket; these few values
    are ranked. If a wanted rank falls outside (the sketch was off), that group is ranked whole."""
    g = list(group_cols)
    of = of if of is not None else summary(df, g, value_col, k, moments=False)
    probs = sorted({float(p) for p in named.values()})
    slack = 3 * sketch_error(k)
    bound = lambda ps, end: [F.col(end) if (p <= 0 if end == "min" else p >= 1) else F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in ps]
    cuts = of.where("n > 0").select(*g, F.array(*bound([p - slack for p in probs], "min")).alias("__lo"), F.array(*bound([p + slack for p in probs], "max")).alias("__hi")) \
        .withColumn("__edges", F.array_sort(F.array_distinct(F.concat("__lo", "__hi")))).withColumn("__pairs", F.arrays_zip("__lo", "__hi"))
    within = lambda i: F.exists("__pairs", lambda b: (F.get("__edges", i - 1) >= b["__lo"]) & (F.get("__edges", i) <= b["__hi"]))
    groups = of.where("n > 0").count()
    cuts = kept(cuts.select(*g, "__edges", F.transform(F.sequence(F.lit(0), F.size("__edges")), lambda i: F.coalesce((i > 0) & within(i), F.lit(False))).alias("__in")), groups, "brackets")
    if not groups:
        return df.select(*g).limit(0).withColumns({n: F.lit(None).cast("double") for n in named})
    base = df.where(F.col(value_col).isNotNull()).select(*g, F.col(value_col).cast("double").alias("__v"))
    base = join_small(base, cuts, g, groups * (1 + 2 * len(probs)))  # a row is as wide as its arrays
    # few edges: comparisons side by side, which compile; more by binary search
    below = sum((F.coalesce((F.get("__edges", F.lit(i)) < F.col("__v")).cast("int"), F.lit(0)) for i in range(2 * len(probs))), F.lit(0)) \
        if len(probs) <= 8 else range_index(F.col("__edges"), F.col("__v"), 2 * len(probs))
    base = base.withColumn("__i", below) \
        .withColumn("__at", F.coalesce(F.get("__edges", F.col("__i")) == F.col("__v"), F.lit(False)))
    cells = base.groupBy(*g, (F.col("__i") * 2 + F.col("__at").cast("int")).alias("__cell"), F.when(F.col("__at") | F.get("__in", F.col("__i")), F.col("__v")).alias("__v")) \
        .agg(F.count(F.lit(1)).alias("__n"))
    cells = written(cells, "cells")
    before = Window.partitionBy(*g).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 4 cells a probability, and one
    counts = cells.groupBy(*g, "__cell").agg(F.sum("__n").alias("__c"))
    counts = counts.select(*g, "__cell", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"), F.sum("__c").over(Window.partitionBy(*g)).alias("__all"))
    ranked = cumulative_counts(cells, g + ["__cell"], "__v", {"n": F.col("__n")})
    ranked = join_small(ranked, counts, g + ["__cell"], groups * (4 * len(probs) + 1))
    upto = F.col("__off") + F.col("cum_n")
    out = _pick(ranked, g, named, F.col("__all"), upto - F.col("n"), upto)
    out = kept(out, groups, "quantiles")
    missing = functools.reduce(lambda a, b: a | b, [F.col(n).isNull() for n in named])
    if g and out.count() < groups or out.where(missing).limit(1).count():  # a bracket missed
        lost = join_small(cuts.select(*g), out.where(~missing).select(*g, F.lit(True).alias("__found")), g, groups, "left").where("__found IS NULL").select(*g) if g else None
        again = quantiles_wide(join_small(df, lost, g, groups) if g else df, g, value_col, named)
        out = out.where(~missing).unionByName(again) if g else again
    return out.select(*g, *named)


def _pick(ranked: DataFrame, g: list[str], named: dict[str, float], total: Column, before: Column, upto: Column) -> DataFrame:
    """Interpolates the two order statistics of every probability among ranked values that hold the ranks [before, upto)."""
    aggs = []
    for name, p in named.items():
        pos = (total - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when((lo >= before) & (lo < upto), F.col("value"))).alias(f"__lo_{name}"),
                 F.max(F.when((hi >= before) & (hi < upto), F.col("value"))).alias(f"__hi_{name}"), F.max(pos - lo).alias(f"__d_{name}")]
    out = ranked.groupBy(*g).agg(*aggs) if g else ranked.agg(*aggs)
    # lo * (1 - d) + hi * d: the form SQL engines use, so results agree to the last bit.
    return out.select(*g, *[(F.col(f"__lo_{k}") * (F.lit(1.0) - F.col(f"__d_{k}")) + F.col(f"__hi_{k}") * F.col(f"__d_{k}")).alias(k) for k in named])


def described(df: DataFrame, group_cols: list[str], value_col: str, named: dict[str, float]) -> DataFrame:
    """``summary`` and ``quantiles`` side by side, from two scans."""
    g = list(group_cols)
    of = summary(df, g, value_col)
    q = quantiles(df, g, value_col, named, of)
    if not g:  # one row beside one row, none without values
        return of.drop("sketch").withColumn("__one", F.lit(1)).join(q.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    return join_small(of.drop("sketch"), q, g, None, "left")


def quantiles_of(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float], k: int = SKETCH_K) -> dict:
    """``quantiles`` as ``{(group tuple, p): q}``, for callers whose groups are a list of column names."""
    named = {f"q{i}": float(p) for i, p in enumerate(probs)}
    rows = quantiles(df, group_cols, value_col, named, k=k).collect()
    return {(tuple(r[c] for c in group_cols), round(p, 12)): r[n] for r in rows for n, p in named.items()}


def column_quantiles(df: DataFrame, columns: list[str], p: float, k: int = SKETCH_K) -> dict[str, float]:
    """``quantiles`` of numeric columns side by side, at one probability; columns without values are absent.

    As there, a sketch brackets the order statistics and one more aggregate counts, here the values below each column's bracket and on its two edges.
    Only values strictly inside a bracket become rows of their own. The driver gets a few numbers a column."""
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    at, slack = range(len(columns)), 3 * sketch_error(k)
    of = values.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in at for n, f in (("n", F.count), ("min", F.min), ("max", F.max))],
                    *[F.kll_sketch_agg_double(f"v{i}", k).alias(f"sketch{i}") for i in at])
    edge = lambda i, q, end: F.when(F.col(f"n{i}") > 0, F.col(f"{end}{i}") if not 0 < q < 1 else F.kll_sketch_get_quantile_double(f"sketch{i}", F.lit(q)))
    row = of.select(*[f"n{i}" for i in at], *[edge(i, q, end).alias(f"{name}{i}") for i in at for name, q, end in (("lo", p - slack, "min"), ("hi", p + slack, "max"))]).first()
    there = [i for i in at if row[f"n{i}"]]
    if not there:
        return {}
    lo, hi = ({i: row[f"{name}{i}"] + 0.0 for i in there} for name in ("lo", "hi"))
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    counts = values.agg(*[x for i in there for x in (n(F.col(f"v{i}") < lo[i], f"below{i}"), n(F.col(f"v{i}") == lo[i], f"lo{i}"), n(F.col(f"v{i}") == hi[i], f"hi{i}"))]).first()
    edges = {(i, v): counts[f"{name}{i}"] for i in there for name, v in (("lo", lo[i]), ("hi", hi[i]))}
    rows = df.sparkSession.createDataFrame([(i, v, c) for (i, v), c in edges.items() if c], "c int, v double, n long")
    wide = [i for i in there if lo[i] < hi[i]]
    if wide:
        one = F.array_compact(F.array(*[F.when((F.col(f"v{i}") > lo[i]) & (F.col(f"v{i}") < hi[i]), F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v"))) for i in wide]))
        inside = values.select(F.explode(one).alias("s")).groupBy("s.c", "s.v").agg(F.count(F.lit(1)).alias("n"))
        rows = written(inside, "cells").unionByName(rows)
    ranked = cumulative_counts(rows, ["c"], "v", {"n": F.col("n")})
    before = df.sparkSession.createDataFrame([(i, counts[f"below{i}"], row[f"n{i}"]) for i in there], "c int, off long, all long")
    upto = F.col("off") + F.col("cum_n")
    found = _pick(join_small(ranked, before, ["c"], len(there)), ["c"], {"q": p}, F.col("all"), upto - F.col("n"), upto).where("q IS NOT NULL")
    out = {r["c"]: r["q"] for r in found.collect()}
    for i in there:
        if i not in out:  # a bracket missed
            out[i] = quantiles_wide(values.select(F.lit(i).alias("c"), f"v{i}"), ["c"], f"v{i}", {"q": p}).first()["q"]
    return {columns[i]: out[i] for i in there}


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    n_ranges: int | None = None) -> DataFrame:
    """Long form of ``quantiles_wide``: ``group_cols, p, q``."""
    named = {f"q{i}": float(p) for i, p in enumerate(probs)}
    w = quantiles_wide(df, group_cols, value_col, named, n_ranges)
    st = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(k).alias("q")) for k, p in named.items()]))
    return w.select(*group_cols, st.alias("__s")).select(*group_cols, "__s.p", "__s.q")


def dense_index(df: DataFrame, col: str) -> DataFrame:
    """(value, index): the distinct non-null values of a column with their place in order, from 0. Values are dealt to range partitions and
    numbered inside them; only the partitions' sizes are added up in one place."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    values = written(values.repartitionByRange(parts, "value").withColumn("__part", F.spark_partition_id()), "index-values")
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    sizes = values.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__part").orderBy("value")) - 1
    return join_small(values, sizes, ["__part"], parts).select("value", (here + F.col("__before")).cast("long").alias("index"))


def kolmogorov_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided KS p-value ``2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2)``,
    ``lambda = D * sqrt(n m / (n + m))``, clipped to [0, 1]."""
    lam = d * F.sqrt(n * m / (n + m))
    ks = F.sequence(F.lit(1), F.lit(terms))
    s = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1)
                    * F.exp(F.lit(-2.0) * k * k * lam * lam))
    # The series does not converge for small lambda, where the p-value is 1 to within 1e-5.
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * s)))


def ks_two_sample(ref: DataFrame, new: DataFrame, group_cols: list[str], value_col: str,
                  n_ranges: int | None = None) -> DataFrame:
    """Two-sample KS statistic per group: ``D = max |F_ref(x) - F_new(x)|`` over all distinct x.

    Returns ``group_cols, n_ref, n_new, ks_statistic, p_value`` for groups present in both samples.
    """
    g = list(group_cols)
    both = (ref.select(*g, F.col(value_col).alias("__v"), F.lit(1).alias("__is_ref"))
               .unionByName(new.select(*g, F.col(value_col).alias("__v"), F.lit(0).alias("__is_ref"))))
    ranked = cumulative_counts(both, g, "__v", {"r": F.col("__is_ref"), "m": 1 - F.col("__is_ref")}, n_ranges)
    j = ranked.where((F.col("total_r") > 0) & (F.col("total_m") > 0))
    diff = F.abs(F.col("cum_r") / F.col("total_r") - F.col("cum_m") / F.col("total_m"))
    aggs = [F.first("total_r").alias("n_ref"), F.first("total_m").alias("n_new"), F.max(diff).alias("ks_statistic")]
    agg = j.groupBy(*g).agg(*aggs) if g else j.agg(*aggs)
    return agg.withColumn("p_value", kolmogorov_pvalue(F.col("ks_statistic"), F.col("n_ref").cast("double"),
                                                       F.col("n_new").cast("double")))


def percentile_of_score(actuals: DataFrame, actual_col: str, scores: DataFrame, score_col: str,
                        n_ranges: int | None = None) -> DataFrame:
    """Percentile (0-1) of every score within the actuals, ``kind='rank'`` rule:
    ``(#a < s + #a <= s + [#a <= s > #a < s]) * 50 / n / 100``.

    Returns distinct scores with ``weight`` (how many predictions have that score) and ``pct``.
    """
    both = (actuals.select(F.col(actual_col).alias("__v"), F.lit(1).alias("__a"))
                   .unionByName(scores.select(F.col(score_col).alias("__v"), F.lit(0).alias("__a"))))
    ranked = cumulative_counts(both, [], "__v", {"a": F.col("__a"), "s": 1 - F.col("__a")}, n_ranges)
    j = ranked.where(F.col("s") > 0)
    le = F.col("cum_a")
    lt = F.col("cum_a") - F.col("a")
    pct = (lt + le + F.when(le > lt, 1).otherwise(0)) * F.lit(50.0) / F.col("total_a") / F.lit(100.0)
    return j.select(F.col("value").alias("score"), F.col("s").alias("weight"), pct.alias("pct"))
