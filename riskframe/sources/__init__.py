"""riskframe sources."""
