"""Joins of the feature build: loan ⋈ fraud score, loan ⋈ payment aggregates, lookups.

Strategy: no hard-coded broadcast for data-sized sides (clarity, payment aggregates grow with the data);
Catalyst + AQE choose broadcast or sort-merge from runtime sizes. Payments are shuffled once by loan, as rows of
the few columns that count, and aggregated per loan *before* the join, so the join is 1:1 and needs no further shuffle
of them.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.expressions import exact_avg, exact_sum


_NON_EMPTY: "weakref.WeakKeyDictionary[DataFrame, bool]" = weakref.WeakKeyDictionary()


def has_rows(df: DataFrame) -> bool:
    """Cheap emptiness probe (reads at most one row); remembered per DataFrame object."""
    try:
        return _NON_EMPTY[df]
    except (KeyError, TypeError):
        pass
    out = len(df.take(1)) > 0
    try:
        _NON_EMPTY[df] = out
    except TypeError:  # pragma: no cover
        pass
    return out


def join_fraud(loan: DataFrame, clarity: DataFrame, null_safe: bool = False, check_empty: bool = True) -> DataFrame:
    """Left join of the fraud score on ``clarityFraudId = underwritingid``; keeps both keys.

    An empty or key-less clarity source leaves the loans unchanged (no fraud column). Duplicate
    clarity ids fan out like any left join. ``null_safe`` also matches null ids with null ids.
    """
    if "clarityFraudId" not in loan.columns or "underwritingid" not in clarity.columns:
        return loan
    if check_empty and not has_rows(clarity):
        return loan
    right = clarity.select("underwritingid", "clearfraudscore")
    # Hashed as one value, the null ids would be one partition. The loans' null ids are dealt over as many salts as the
    # session has shuffle partitions; a join on id and salt then finds no partner for them, or, null-safe, the copy of every null
    # clarity row that lies at their salt.
    salts = null_salts(loan)
    left = loan.withColumn("__id", F.coalesce("clarityFraudId", F.lit(""))) \
        .withColumn("__salt", F.when(F.col("clarityFraudId").isNull(), F.pmod(F.xxhash64(*loan.columns), F.lit(salts)) + 1).otherwise(0).cast("int"))
    some = right.where(F.col("underwritingid").isNotNull()).withColumns({"__id": F.col("underwritingid"), "__salt": F.lit(0)})
    if null_safe:
        none = right.where(F.col("underwritingid").isNull()).withColumns({"__id": F.lit(""), "__salt": F.explode(F.sequence(F.lit(1), F.lit(salts)))})
        some = some.unionByName(none)
    return left.join(some, ["__id", "__salt"], "left").drop("__id", "__salt")


def null_salts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def payment_aggregates(payment: DataFrame) -> DataFrame:
    """Per-loan payment aggregates.

    ``paymentAmount`` mean/sum/count (count of non-null), ``principal`` and ``fees`` mean/sum when
    present, ``payment_success_rate`` = share of rows with status 'Checked' where a null status counts
    in the denominator. Null loan ids are dropped; an all-null sum is 0.

    The narrow rows are shuffled, not partial aggregates: with few rows a loan, in no order, a partial aggregate merges next to
    nothing, holds a buffer of some twenty numbers for nearly every row, spills them and sends them all.
    """
    cols = set(payment.columns)
    checked = F.coalesce(F.col("paymentStatus") == C.PAYMENT_SUCCESS_STATUS, F.lit(False))
    rows = payment.where(F.col("loanId").isNotNull()) \
        .select("loanId", *[F.col(c).cast("double").alias(c) for c in ("paymentAmount", "principal", "fees") if c in cols], checked.alias("__checked")) \
        .repartition("loanId")
    aggs = [
        exact_avg("paymentAmount").alias("paymentAmount_mean"),
        F.coalesce(exact_sum("paymentAmount"), F.lit(0.0)).alias("paymentAmount_sum"),
        F.count("paymentAmount").alias("paymentAmount_count"),
    ]
    for c in ("principal", "fees"):
        if c in cols:
            aggs += [exact_avg(c).alias(f"{c}_mean"), F.coalesce(exact_sum(c), F.lit(0.0)).alias(f"{c}_sum")]
    ok = F.when(F.col("__checked"), 1.0).otherwise(0.0)
    aggs.append((F.sum(ok) / F.count(F.lit(1))).alias("payment_success_rate"))
    return rows.groupBy("loanId").agg(*aggs)


def join_payments(loans: DataFrame, payment: DataFrame, check_empty: bool = True) -> DataFrame:
    """Left join of the per-loan payment aggregates, unmatched loans filled with 0.

    Skipped (input returned) when the payment source is empty or lacks a required column.
    """
    if any(c not in payment.columns for c in ("loanId", "paymentAmount", "paymentStatus")):
        return loans
    if check_empty and not has_rows(payment):
        return loans
    agg = payment_aggregates(payment)
    new_cols = [c for c in agg.columns if c != "loanId"]
    out = loans.join(agg, "loanId", "left")
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in new_cols}
    return out.withColumns(fills)


def lookup_join(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left lookup join of a keyed table; AQE broadcasts the lookup side after measuring it."""
    return df.join(table, key, "left")
