"""Shared pieces of the registered queries: domain inputs, scratch paths, rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import EXACT_MAX, EXACT_TOL
from ..session import session_defaults, shared_path
from ..sources import fixtures

DIGITS = 6


def prep(spark: SparkSession) -> None:
    session_defaults(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint directory."""
    return shared_path(spark, name)


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    prep(spark)
    return (fixtures.approved_loan(spark, sf_dir), fixtures.clarity(spark, sf_dir),
            fixtures.payment(spark, sf_dir))


def r(col, digits: int = DIGITS):
    """Round a floating result for exact comparison with the oracle."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits)


def XSUM(expr: str) -> str:
    """SQL text of the sum that is exact where the values allow it (see ``functions.expressions.exact_sum``)."""
    x = f"CAST({expr} AS DOUBLE)"
    dec = f"TRY_CAST({x} AS DECIMAL(38,9))"
    return (f"(CASE WHEN bool_and(abs({x}) < {EXACT_MAX!r} AND coalesce(abs(CAST({dec} AS DOUBLE) - {x}) <= {EXACT_TOL!r} * abs({x}), {x} IS NULL)) "
            f"THEN CAST(sum({dec}) AS DOUBLE) ELSE sum({x}) END)")


def XAVG(expr: str) -> str:
    return f"({XSUM(expr)} / count({expr}))"


def sig(col, digits: int = 10):
    """Round to ``digits`` significant digits (comparable across engines for large magnitudes)."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), k)
    return F.when((c == 0) | c.isNull(), c).otherwise(F.round(c / scale, digits - 1) * scale)


def SIG(expr: str, digits: int = 10) -> str:
    return (f"(CASE WHEN ({expr}) = 0 OR ({expr}) IS NULL THEN ({expr}) ELSE "
            f"round(({expr}) / pow(10.0, floor(log10(abs({expr})))), {digits - 1}) * pow(10.0, floor(log10(abs({expr})))) END)")
