"""Driver contract: entry() smoke, queries()/oracle_sql() consistency."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25 and all(r["n_loans"] > 0 for r in rows)
    assert df.columns == ["state", "n_loans", "avg_target", "avg_success_rate", "avg_fraud_score", "total_paid"]


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
