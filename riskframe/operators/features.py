"""Feature build as fit/transform.

``fit`` looks at the training frame once and freezes every data-dependent decision in a ``FeatureSpec``:
medians, which indicator columns exist, whether the ratio feature exists, target encodings, low-variance
drops and the final feature lists. ``transform`` is then a pure projection plus two left joins, so a single
scored row gets exactly the columns and fill values of the training batch (no train/serve skew).

Aggregation passes at fit: one multi-expression ``agg`` (null counts, min of loanAmount), one distributed
exact-median job over all numeric columns (``ranking.column_quantiles``), one ``groupBy`` per encoded
category column, one ``agg`` of sample variances.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.expressions import day_diff, parse_ts, status_risk
from ..session import written
from . import joins, ranking

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


# ---------------------------------------------------------------------------------------------- steps

def add_date_features(df: DataFrame) -> DataFrame:
    """Parse the date texts (invalid -> null) and add year, month, day, weekday (Mon=0), hour and fractional
    days from application to origination."""
    if "applicationDate" not in df.columns:
        return df
    app = parse_ts("applicationDate")
    out = df.withColumn("__app_ts", app)
    a = F.col("__app_ts")
    parts = {
        "application_year": F.year(a), "application_month": F.month(a), "application_day": F.dayofmonth(a),
        "application_dayofweek": F.weekday(a), "application_hour": F.hour(a),
    }
    out = out.withColumns({k: v.cast("double") for k, v in parts.items()})
    if "originatedDate" in df.columns:
        out = out.withColumn("days_to_origination", day_diff(parse_ts("originatedDate"), a))
    return out.drop("__app_ts")


def base_frame(loan: DataFrame, clarity: DataFrame | None, payment: DataFrame | None,
               null_safe: bool = False) -> DataFrame:
    """join fraud score -> payment aggregates -> date parts (all lazy)."""
    df = loan
    if clarity is not None:
        df = joins.join_fraud(df, clarity, null_safe=null_safe)
    if payment is not None:
        df = joins.join_payments(df, payment)
    return add_date_features(df)


@dataclass
class FeatureSpec:
    """Frozen result of ``FeaturePipeline.fit`` (JSON-serialisable; encodings are a table)."""

    numeric_columns: list[str] = field(default_factory=list)
    medians: dict[str, float | None] = field(default_factory=dict)
    indicator_columns: list[str] = field(default_factory=list)
    categorical_features: list[str] = field(default_factory=list)
    numeric_features: list[str] = field(default_factory=list)
    ratio_feature: bool = False
    squared: list[str] = field(default_factory=list)
    encoded: list[str] = field(default_factory=list)
    encoding_global_mean: float | None = None
    variances: dict[str, float | None] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    output_columns: list[str] = field(default_factory=list)
    config: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(s: str) -> "FeatureSpec":
        return FeatureSpec(**json.loads(s))


def fill_missing(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Indicators (from the pre-fill nulls), median fill for numerics, 'Unknown' for strings, False for
    booleans, absent indicators as 0, date texts dropped."""
    ind = {}
    for c in C.MISSING_INDICATOR_COLUMNS:
        name = f"{c}_missing"
        ind[name] = (F.col(c).isNull().cast("int") if c in df.columns else F.lit(0)).cast("int")
    out = df.withColumns(ind)
    fills = {c: F.coalesce(F.col(c), F.lit(spec.medians.get(c)).cast(df.schema[c].dataType))
             for c in spec.numeric_columns if c in df.columns and spec.medians.get(c) is not None}
    fills.update({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in string_columns(df)})
    fills.update({c: F.coalesce(F.col(c), F.lit(False)) for c in boolean_columns(df)})
    out = out.withColumns(fills)
    return out.drop(*[c for c in C.DATE_COLUMNS if c in out.columns])


def add_interactions(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    cols = {}
    if "loanAmount" in df.columns and "apr" in df.columns:
        cols["loanAmount_x_apr"] = F.col("loanAmount") * F.col("apr")
    if spec.ratio_feature:
        cols["leadCost_to_loanAmount"] = F.try_divide(F.col("leadCost"), F.col("loanAmount"))
    return df.withColumns(cols) if cols else df


def add_squares(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    cols = {f"{c}_squared": F.col(c) * F.col(c) for c in spec.squared if c in df.columns}
    return df.withColumns(cols) if cols else df


def target_encodings(df: DataFrame, features: list[str], target: str = "originated") -> dict[str, DataFrame]:
    """In-sample mean of the boolean target per category value (one grouped aggregate per feature)."""
    return {f: df.groupBy(f).agg(F.avg(F.col(target).cast("int")).alias(f"{f}_target_encoded"))
            for f in features}


def apply_encodings(df: DataFrame, encodings: dict[str, DataFrame], global_mean: float | None) -> DataFrame:
    out = df
    for f, enc in encodings.items():
        # One row per category value: AQE broadcasts it when its measured size is small, else the
        # join stays a shuffle join (high-cardinality categories).
        out = joins.lookup_join(out, enc, f)
        if global_mean is not None:
            name = f"{f}_target_encoded"
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(float(global_mean))))
    return out


def add_target(df: DataFrame) -> DataFrame:
    """Risk target from the loan status (frames without a status, e.g. scoring requests, get none)."""
    if "loanStatus" not in df.columns:
        return df
    return df.withColumn("target", status_risk("loanStatus"))


class FeaturePipeline:
    """Fit/transform version of the feature build.

    Parameters follow the pipeline configuration; ``exclude`` lists columns never used as categorical
    features (ids, join keys, target source); ``include_base`` adds the base numerics to the feature list.
    """

    def __init__(self, config: dict | None = None, exclude: list[str] | None = None, include_base: bool = False):
        self.config = dict(C.FEATURE_CONFIG, **(config or {}))
        self.exclude = list(C.LEAKAGE_EXCLUDE if exclude is None else exclude)
        self.include_base = include_base
        self.encodings: dict[str, DataFrame] = {}

    # ------------------------------------------------------------------ fit
    def fit(self, base: DataFrame, cache: bool = True) -> FeatureSpec:
        """Freeze all data-dependent choices. ``base`` is scanned by a few aggregate passes, so it is
        persisted (memory and disk) for the duration of the fit when ``cache`` is set."""
        if cache:
            base = base.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(base)
        finally:
            if cache:
                base.unpersist()

    def _fit(self, base: DataFrame) -> FeatureSpec:
        cfg = self.config
        spec = FeatureSpec(config=cfg)
        num = numeric_columns(base)
        strs = string_columns(base)
        spec.numeric_columns = num
        # Pass 1 (one aggregate): null counts of every column, min loan amount, target mean.
        extra = []
        if "loanAmount" in base.columns:
            extra.append(F.min("loanAmount").alias("__min_amount"))
        if "originated" in base.columns:
            extra.append(F.avg(F.col("originated").cast("int")).alias("__target_mean"))
        row = base.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in num + strs], *extra).first()
        nulls = {c: int(row[c] or 0) for c in num + strs}
        # Pass 2: exact medians of every numeric column (sketches, then counts).
        if num:
            spec.medians = ranking.column_quantiles(base, num, 0.5)
        # Running feature lists, in the order the steps add them.
        numeric_features: list[str] = []
        if "clearfraudscore" in base.columns:
            numeric_features.append("clearfraudscore")
        numeric_features += [c for c in C.PAYMENT_FEATURES if c in base.columns]
        numeric_features += [c for c in C.DATE_PART_FEATURES if c in base.columns]
        if "days_to_origination" in base.columns:
            numeric_features.append("days_to_origination")
        with_nulls = [f"{c}_missing" for c in num if nulls.get(c, 0) > 0 and c in C.MISSING_INDICATOR_COLUMNS]
        absent = [f"{c}_missing" for c in C.MISSING_INDICATOR_COLUMNS if f"{c}_missing" not in with_nulls]
        spec.indicator_columns = with_nulls + absent
        numeric_features += [c for c in spec.indicator_columns if c not in numeric_features]
        categorical = [c for c in strs if nulls.get(c, 0) > 0 and c not in self.exclude]
        if not numeric_features or self.include_base:
            numeric_features = [c for c in C.BASE_NUMERIC if c not in numeric_features] + numeric_features
        if not categorical:
            categorical = list(C.BASE_CATEGORICAL)
        filled = fill_missing(base, spec)
        numeric_features = [c for c in numeric_features if c in filled.columns]
        categorical = [c for c in categorical if c in filled.columns]
        # Interactions: the ratio exists only if every (filled) loanAmount is > 0, decided here.
        if cfg.get("create_interactions"):
            if "loanAmount" in filled.columns and "apr" in filled.columns:
                numeric_features.append("loanAmount_x_apr")
            if "leadCost" in filled.columns and "loanAmount" in filled.columns:
                # every filled amount > 0  <=>  min of the non-null amounts > 0 (the median fill lies
                # between min and max).
                mn = row["__min_amount"]
                spec.ratio_feature = mn is not None and mn > 0
                if spec.ratio_feature:
                    numeric_features.append("leadCost_to_loanAmount")
        if cfg.get("polynomial_features"):
            spec.squared = [c for c in cfg.get("polynomial_features_list", []) if c in filled.columns]
            numeric_features += [f"{c}_squared" for c in spec.squared]
        df = add_squares(add_interactions(filled, spec), spec)
        if cfg.get("categorical_encoding", "onehot") == "target" and "originated" in df.columns:
            spec.encoded = list(categorical)
            # written once, one row a category value: a transform never reads the training rows again
            self.encodings = {k: written(v, f"encoding-{k}") for k, v in target_encodings(df, spec.encoded).items()}
            spec.encoding_global_mean = row["__target_mean"]
            df = apply_encodings(df, self.encodings, None)
            numeric_features += [f"{c}_target_encoded" for c in spec.encoded]
        if cfg.get("drop_low_variance"):
            thr = float(cfg.get("variance_threshold", 0.01))
            present = [c for c in numeric_features if c in df.columns]
            vrow = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in present]).first()
            spec.variances = {c: vrow[c] for c in present}
            spec.dropped = [c for c in present if vrow[c] is not None and vrow[c] < thr]
            numeric_features = [c for c in numeric_features if c not in spec.dropped]
            df = df.drop(*spec.dropped)
        spec.numeric_features = numeric_features
        spec.categorical_features = categorical
        spec.output_columns = add_target(df).columns
        return spec

    # ------------------------------------------------------------ transform
    def transform(self, base: DataFrame, spec: FeatureSpec) -> DataFrame:
        df = add_squares(add_interactions(fill_missing(base, spec), spec), spec)
        used = [k for k in spec.encoded if f"{k}_target_encoded" not in spec.dropped]
        if used:
            df = apply_encodings(df, {k: self.encodings[k] for k in used}, spec.encoding_global_mean)
        df = add_target(df.drop(*[c for c in spec.dropped if c in df.columns]))
        missing = [c for c in spec.output_columns if c not in df.columns]
        if missing:  # schema alignment: columns the spec expects but this input lacks
            df = df.withColumns({c: F.lit(0) for c in missing})
        return df.select(*spec.output_columns)

    def fit_transform(self, base: DataFrame) -> tuple[DataFrame, FeatureSpec]:
        spec = self.fit(base)
        return self.transform(base, spec), spec


def schema_align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add absent expected columns as constant 0 (e.g. indicators dropped at fit, expected by a model)."""
    missing = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(0) for c in missing}) if missing else df
