"""riskframe: tabular risk scoring on Spark DataFrames and MLlib.

Layout
------
sources/    readers, optional sources, latest-run selection, sinks, domain views of the test tables
functions/  column expressions (risk bands, cuts, lookups, date parts, guarded arithmetic)
operators/  DataFrame operators: quality checks, joins, feature pipeline, statistics, ranking,
            evaluation, deployment gate, scoring, monitoring
plans/      the registered queries (one per SURVEY key) and their SQL oracles
streaming/  Structured Streaming jobs (daily drift windows, stream scoring, metric history)
"""

__version__ = "0.1.0"
