"""riskframe operators."""
