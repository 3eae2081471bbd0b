"""The conversation trie against a trie built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskframe.llm import prefix_trie
from tests.llm.helpers import clash

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    own: dict[int, list] = {}
    for c, n, r, t in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, digest(r or "", t or ""), r or "", t or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, mine in own.items():
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(base, [])[:h] + mine[h:])
    nodes: dict[tuple, list] = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children: dict[tuple, list] = {}
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        kids = children.get(s, [])
        leaves[s] = sum(leaves[k] for k in kids) if kids else 1
        saved[s] = sum(saved[k] for k in kids) + (len(nodes[s]) - 1) * (len(WORD.findall(s[-1][1])) if s else 0)
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(s))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children.get(s, [])), leaves[s], saved[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def rows_of(seed, convs=90, longest=14):
    rng = random.Random(seed)
    said = [("user", "hello there"), ("assistant", "hi"), ("user", "one two three"), ("", "a b"), (None, None), ("user", "")]
    starts = [[rng.choice(said) for _ in range(longest)] for _ in range(3)]
    rows = []
    for c in range(convs):
        n = rng.randint(1, longest)
        line = rng.choice(starts)[:n] if rng.random() < 0.7 else []
        line = line[:rng.randint(0, n)] + [rng.choice(said) for _ in range(n)]
        rows += [(c * 2 - 21, i, *t) for i, t in enumerate(line[:n])]
    same = [(f"r{i % 2}", f"copy turn {i}") for i in range(9)]
    rows += [(1000 + c, i, *t) for c in range(60) for i, t in enumerate(same)]       # a group of copies
    rows += [(20, i, "user", f"long {i % 7}") for i in range(300)]                    # one long conversation, numbers not unique
    rows += [(41, None, "user", "no number"), (41, None, "user", "no number"), (None, 0, "user", "no id"), (43, 5, "x", "w " * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, piece, chunk", [(1, 1024, 1 << 16), (2, 3, 20)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, piece, chunk):
    """The second case sums prefixes in pieces of three blocks and joins ids in pieces of a few."""
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = rows_of(seed)
    df = clash(spark.createDataFrame(rows, SCHEMA)).withColumn("digest", F.lit("x")).withColumn("place", F.lit(0))
    assert result(prefix_trie.prefix_trie(df.repartition(7))) == brute(rows)


def test_trie_of_turnless_empty_and_missing_columns(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert prefix_trie.prefix_trie(make([])).count() == 0
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    turnless = [(c, 0, "user", "x") for c in h if h[c]]                 # their base is absent and takes their only turn
    assert result(prefix_trie.prefix_trie(make(turnless))) == brute(turnless) and len(brute(turnless)) == 1
    few = [(0, 0, "user", "base"), *[(c, i, "user", f"t{i}") for c in h for i in range(5)]]
    assert result(prefix_trie.prefix_trie(make(few))) == brute(few)
    bare = [(c, None, None, t) for c, _, _, t in few]
    assert result(prefix_trie.prefix_trie(make(bare).select("conv_id", "text"))) == brute(bare)


def test_places_without_one_task_a_conversation(spark):
    rows = [(1, i // 3, f"{i:05d}") for i in range(4000)] + [(c, i, "x") for c in range(2, 40) for i in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, digest string").repartition(5)
    got = prefix_trie.numbered(df, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], "t")
    assert got.where("conv_id = 1").select("digest", "place").where(F.col("digest").cast("int") != F.col("place")).count() == 0
    assert got.where("conv_id = 1").select("place").distinct().count() == 4000
    assert got.where("conv_id > 1").groupBy("conv_id").agg(F.max("place").alias("m")).where("m <> 4").count() == 0
