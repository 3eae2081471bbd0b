"""Column-level functions (risk bands, lookups, exact sums) and fixed values."""

from . import constants
from .expressions import (
    app_band, band3, day_diff, decision, display_normalize, exact_avg, exact_sum, lookup, md5_bucket,
    nan_to_null, parse_ts, pay_frequency_code, serving_band, status_risk,
)

__all__ = [
    "constants", "app_band", "band3", "day_diff", "decision", "display_normalize", "exact_avg", "exact_sum",
    "lookup", "md5_bucket", "nan_to_null", "parse_ts", "pay_frequency_code", "serving_band", "status_risk",
]
