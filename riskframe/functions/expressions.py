"""Column expressions. All are built-in Spark expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(col, mapping: dict, default=None) -> Column:
    """Map a column through a small fixed dict (a literal map, no join); unmatched -> default."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    out = F.try_element_at(m, _c(col))
    return out if default is None else F.coalesce(out, F.lit(default))


def status_risk(col="loanStatus") -> Column:
    """Risk target from the loan status; unknown or null status -> 0.50."""
    return lookup(col, {k: float(v) for k, v in C.STATUS_RISK.items()}, float(C.DEFAULT_RISK)).cast("double")


def pay_frequency_code(col) -> Column:
    return lookup(col, C.PAY_FREQUENCY_CODES, C.DEFAULT_PAY_FREQUENCY)


def parse_ts(col) -> Column:
    """Text -> timestamp; unparseable -> null (never raises under ANSI mode)."""
    c = _c(col)
    return F.try_to_timestamp(c.cast("string"))


def day_diff(later, earlier) -> Column:
    """Fractional days between two timestamps; null if either is null."""
    return (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / F.lit(86400e6)


def nan_to_null(col) -> Column:
    """NaN -> null so that aggregates skip it like pandas does."""
    return F.nanvl(_c(col), F.lit(None).cast("double"))


def band3(col, low_max: float = C.EVAL_LOW_MAX, high_min: float = C.EVAL_HIGH_MIN,
          low_inclusive: bool = True, high_inclusive: bool = False) -> Column:
    """Three risk bands 0/1/2.

    Default: ``x <= low`` -> 0, ``low < x <= high`` -> 1, ``x > high`` -> 2. With ``high_inclusive`` the
    high band starts at ``x >= high`` (single-request page rule). Null stays null.
    """
    c = _c(col)
    lo = c <= low_max if low_inclusive else c < low_max
    hi = c >= high_min if high_inclusive else c > high_min
    return F.when(c.isNull(), None).when(lo, 0).when(hi, 2).otherwise(1)


def serving_band(col) -> Column:
    """Serving labels: > 0.7 high_risk, > 0.3 medium_risk, else low_risk."""
    c = _c(col)
    return (F.when(c > C.EVAL_HIGH_MIN, "high_risk").when(c > C.EVAL_LOW_MAX, "medium_risk")
            .otherwise("low_risk"))


def app_band(col) -> Column:
    """Single-request labels: <= 0.4 Low Risk, >= 0.6 High Risk, else Medium Risk."""
    c = _c(col)
    return (F.when(c <= C.APP_LOW_MAX, "Low Risk").when(c >= C.APP_HIGH_MIN, "High Risk")
            .otherwise("Medium Risk"))


def display_normalize(col, lo: float = C.DISPLAY_MIN, hi: float = C.DISPLAY_MAX) -> Column:
    """Min-max normalise to [0, 1] and clamp."""
    c = _c(col)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - F.lit(lo)) / F.lit(hi - lo)))


def decision(col, threshold: float = C.PREDICTION_THRESHOLD) -> Column:
    return _c(col) >= F.lit(threshold)


def md5_bucket(key, n: int) -> Column:
    """Deterministic bucket in [0, n) from md5 of the key (same value in DuckDB: first 8 hex digits)."""
    h = F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n))


# Sums that do not depend on row order wherever that is possible. A double sum depends on the order rows
# arrive in, so the same query on two partitionings (or two engines) can differ in the last bits. Where every
# value of a group is, to within EXACT_TOL of itself, a decimal of at most EXACT_SCALE places and below EXACT_MAX
# (amounts, products of amounts and rates, scores), the sum is exact: fixed-point values as three 21-bit limbs in plain long sums, recombined once per group
# in decimal arithmetic, or, where the sum of the fixed-point values is below 2 ** 53, in whole numbers and one division of doubles, which
# rounds the same way. Any other group (larger, finer or NaN values) gets the plain double sum, so nothing is
# clamped, rounded away or turned into 0; queries round such results to significant digits.
EXACT_SCALE = 9
EXACT_MAX = 9.2e9
EXACT_TOL = 1e-13
_LIMB = 21
_MASK = (1 << _LIMB) - 1
_SMALL = 10, 30, 51  # bits of the limbs' sums that together stay below 2 ** 53


def _exact_sum_sql(x: str, scale: int) -> str:
    x = f"CAST({x} AS DOUBLE)"
    v = f"floor({x} * {float(10 ** scale)!r} + 0.5D)"
    d = "decimal(38,0)"
    hi, mid, lo = f"sum(shiftright({v}, {2 * _LIMB}))", f"sum(shiftright({v}, {_LIMB}) & {_MASK})", f"sum({v} & {_MASK})"
    total = f"CAST({hi} AS {d}) * CAST({1 << (2 * _LIMB)} AS {d}) + CAST({mid} AS {d}) * CAST({1 << _LIMB} AS {d}) + CAST({lo} AS {d})"
    small = " AND ".join(f"abs({a}) < {1 << b}" for a, b in zip((hi, mid, lo), _SMALL))
    whole = f"CAST({hi} * {1 << (2 * _LIMB)} + {mid} * {1 << _LIMB} + {lo} AS DOUBLE) / {float(10 ** scale)!r}D"
    exact = f"CASE WHEN {small} THEN {whole} ELSE CAST(CAST({total} AS decimal(29,0)) / CAST({10 ** scale} AS decimal(10,0)) AS DOUBLE) END"
    fits = f"bool_and(abs({x}) < {EXACT_MAX!r}D AND abs(CAST({v} AS DOUBLE) / {float(10 ** scale)!r}D - {x}) <= {EXACT_TOL!r}D * abs({x}))"
    return f"CASE WHEN {fits} THEN {exact} ELSE sum({x}) END"


def exact_sum(col, scale: int = EXACT_SCALE) -> Column:
    """Sum of a column (name or Column), exact where the values allow it (see above)."""
    if isinstance(col, str):
        return F.expr(_exact_sum_sql(f"`{col}`", scale))
    c = _c(col).cast("double")
    unit = F.lit(float(10 ** scale))
    v = F.floor(c * unit + F.lit(0.5))
    lo = v.bitwiseAND(F.lit(_MASK))
    mid = F.shiftright(v, _LIMB).bitwiseAND(F.lit(_MASK))
    hi = F.shiftright(v, 2 * _LIMB)
    d = "decimal(38,0)"
    hi, mid, lo = F.sum(hi), F.sum(mid), F.sum(lo)
    total = hi.cast(d) * F.lit(1 << (2 * _LIMB)).cast(d) + mid.cast(d) * F.lit(1 << _LIMB).cast(d) + lo.cast(d)
    small = (F.abs(hi) < F.lit(1 << _SMALL[0])) & (F.abs(mid) < F.lit(1 << _SMALL[1])) & (F.abs(lo) < F.lit(1 << _SMALL[2]))
    whole = (hi * F.lit(1 << (2 * _LIMB)) + mid * F.lit(1 << _LIMB) + lo).cast("double") / unit
    exact = F.when(small, whole).otherwise((total.cast("decimal(29,0)") / F.lit(10 ** scale).cast("decimal(10,0)")).cast("double"))
    fits = F.bool_and((F.abs(c) < F.lit(EXACT_MAX)) & (F.abs(v.cast("double") / unit - c) <= F.lit(EXACT_TOL) * F.abs(c)))
    return F.when(fits, exact).otherwise(F.sum(c))


def exact_parts(col: str) -> list[Column]:
    """Aggregates ``fits, total, plain`` of a part of the rows, from which ``merged_sum`` makes the sum of all parts: the same
    as ``exact_sum`` over all rows at once, whatever the parts."""
    c = F.col(col).cast("double")
    unit = F.lit(float(10 ** EXACT_SCALE))
    v = F.floor(c * unit + F.lit(0.5))
    d = "decimal(38,0)"
    total = (F.sum(F.shiftright(v, 2 * _LIMB)).cast(d) * F.lit(1 << (2 * _LIMB)).cast(d)
             + F.sum(F.shiftright(v, _LIMB).bitwiseAND(F.lit(_MASK))).cast(d) * F.lit(1 << _LIMB).cast(d) + F.sum(v.bitwiseAND(F.lit(_MASK))).cast(d))
    fits = F.bool_and((F.abs(c) < F.lit(EXACT_MAX)) & (F.abs(v.cast("double") / unit - c) <= F.lit(EXACT_TOL) * F.abs(c)))
    return [fits.alias("fits"), total.cast("decimal(29,0)").alias("total"), F.sum(c).alias("plain")]


def merged_sum() -> Column:
    """The sum over parts that ``exact_parts`` describes."""
    exact = (F.sum("total").cast("decimal(29,0)") / F.lit(10 ** EXACT_SCALE).cast("decimal(10,0)")).cast("double")
    return F.when(F.bool_and("fits"), exact).otherwise(F.sum("plain"))


def exact_avg(col) -> Column:
    if isinstance(col, str):
        return F.expr(f"({_exact_sum_sql(f'`{col}`', EXACT_SCALE)}) / count(`{col}`)")
    return exact_sum(col) / F.count(col)
