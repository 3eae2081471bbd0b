"""Line dedup against brute force; runs, levels and the plan of the merge-anti-join."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.llm import line_runs
from tests.llm.helpers import documents, hard_rows

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, min_docs=5, min_chars=40):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    below = lambda i: -(1 << 63) if i is None else i
    held: dict[str, set] = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(below(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or below(i) == max(held[key(x)])]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    pool = [f"line {i} " + "x" * rng.choice((20, 34, 35, 60)) for i in range(12)] + ["ÉÀ Ünï " + "Zz" * 20, "İstanbul " + "Aa" * 20, "short", ""]
    rows = []
    for i in range(70):
        own = [rng.choice((str, str.upper))(rng.choice(pool[:2] if rng.random() < 0.4 else pool)) + rng.choice(("", " ", "\t\r", " ")) for _ in range(rng.randint(1, 9))]
        rows.append((i * 3, "\n".join(own), "en", "s"))
    return rows + [(9, rows[0][1], "en", "s"), (9, rows[0][1], "en", "s"), (None, rows[1][1], None, None), (None, None, None, None), (-5, rows[2][1] + "\n", "en", "s")]


@pytest.mark.parametrize("seed, few", [(1, 500_000), (2, 0)])
def test_dedup_equals_brute_force(spark, monkeypatch, seed, few):
    """The second case takes the joins that are not broadcast, and compacts after every second batch."""
    monkeypatch.setattr(line_runs, "SETTLED_ROWS", few)
    monkeypatch.setattr(line_runs, "DROPPED_PLACES", few)
    rows = rows_of(seed)
    got = line_runs.dedup(documents(spark, rows, extra=True), batches=5 if few else 7, fanout=3 if few else 2)
    want = brute(rows)
    assert sum(r[3] for r in want) > 50
    assert result(got) == want
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("line_runs_")]


def test_dedup_hard_rows_and_empty(spark):
    rows = [tuple(r) for r in hard_rows()]
    rows += [(200 + i, ("A long line that every one of these documents has got\n" * 3000) if i == 2 else "a LONG line that every one of these documents has got ", "en", "s") for i in range(6)]
    assert result(line_runs.dedup(documents(spark, rows))) == brute(rows)
    assert line_runs.dedup(documents(spark, [])).count() == 0
    one = [(1, None, None, None)]
    assert result(line_runs.dedup(documents(spark, one))) == [(1, "", 1, 0)]
    assert result(line_runs.dedup(documents(spark, one).select("doc_id"))) == [(1, "", 1, 0)]


def test_runs_levels_and_merge_anti_join(spark):
    index = line_runs.LineRuns(spark, enough=2, fanout=2)
    batch = lambda rows: spark.createDataFrame(rows, "id long, key string").withColumn("key", F.col("key").cast("binary"))
    try:
        index.add(batch([(9, "a"), (8, "a"), (9, "b"), (9, "b")]))
        plan = index.unseen(batch([(1, "a")]).groupBy("key").agg(F.count("*").alias("docs"), F.max("id").alias("top")))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the batch's own; the run is not moved
        index.add(batch([(7, "a"), (7, "b"), (7, "c")]))
        assert [len(x) for x in index.levels] == [0, 1]
        index.add(batch([(5, "c"), (5, "a"), (5, "d")]))
        assert [len(x) for x in index.levels] == [1, 1]
        rows = {bytes(r["key"]): (r["docs"], r["top"]) for run in index.runs() for r in run.collect() if bytes(r["key"]) in (b"a", b"d")}
        assert rows == {b"a": (2, 9), b"d": (1, 5)}  # the first run has settled a: no later entry
        merged = index.settled()._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" in merged and "Exchange" not in merged
        assert sorted((bytes(r["key"]), r["top"]) for r in index.settled().collect()) == [(b"a", 9), (b"b", 9), (b"c", 7)]
    finally:
        index.close()


def test_dedup_is_native(spark):
    plan = line_runs.dedup(documents(spark, rows_of(4)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
