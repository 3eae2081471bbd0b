"""riskframe streaming."""
