"""Document fingerprints: SimHash with weighted terms, and permuted block tables for Hamming search.

A term is three neighbouring words (a shorter text is one term), weighted by its length in characters; every
occurrence votes with its weight on the 128 signed bits of its hash. ``neighbours`` pairs each text with the next one in descending
id order: rows are range-partitioned and sorted, a task walks its rows in order holding one
text back, and only the rows at the partitions' ends (two a partition) are matched up afterwards.
``within`` finds, for a stated set of query fingerprints, all fingerprints within a Hamming radius: the bits
are cut into blocks, and any two fingerprints within the radius agree on some choice of whole blocks, so each
choice is one table and a join on its key is exhaustive; the distance is checked after. ``searched`` does so for the documents
whose id is divisible by 100 against all documents, by distinct fingerprints and their numbers of documents.

Defined results: null is the empty text, whose fingerprint is all zeros; two empty texts are alike (1),
an empty and another text are not (0); rows of one id are ordered by a hash of their text, a null id
comes last; a table of one row has itself as the next; texts of any length are read whole; an empty table
gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, code_points, columns_of, materialize, mix64, partitions, word_bounds, word_hashes

BITS, TERM = 128, 3
HEX = BITS // 4


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts x 2) uint64."""
    cp, off = code_points(texts)
    ws, we, doc = word_bounds(cp, off)
    out = np.zeros((len(texts), 2), np.uint64)
    if not ws.size:
        return out
    h, n = word_hashes(cp, ws, we), (we - ws).astype(np.float64)
    first = np.searchsorted(doc, np.arange(len(texts)))
    count = np.diff(np.append(first, ws.size))
    term, weight = h.copy(), n.copy()
    last = np.append(first[1:], ws.size)
    with np.errstate(over="ignore"):
        for k in range(1, TERM):  # words beyond the text's end add nothing, so a short text's first term is the whole text
            j = np.arange(ws.size) + k
            ok = j < last[doc]
            term[ok] = mix64(term[ok] * np.uint64(0x9E3779B97F4A7C15) + h[j[ok]])
            weight[ok] += n[j[ok]]
    bits = np.unpackbits(np.stack([mix64(term), mix64(term ^ np.uint64(0xC2B2AE3D27D4EB4F))], axis=1).view(np.uint8), axis=1)
    for i in np.flatnonzero(count):
        a = first[i]
        z = a + max(1, count[i] - TERM + 1)
        kind = np.float32 if z - a < 200_000 else np.float64  # sums stay exact
        w = weight[a:z].astype(kind)
        votes = 2 * (w @ bits[a:z].astype(kind)) - w.sum()
        out[i] = np.packbits(votes > 0).view(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """1 - Hamming distance / bits."""
    near = 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS
    return np.where(empty_a & empty_b, 1.0, np.where(empty_a | empty_b, 0.0, near))


def edit(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _blank(texts: list[str]) -> np.ndarray:
    return np.fromiter((not t.strip(" \t\n\v\f\r") for t in texts), bool, len(texts))


def _rows(ids: list, texts: list[str], nexts: list[str], own: np.ndarray, follow: np.ndarray) -> list[pa.Array]:
    edited = [edit(t, n) for t, n in zip(texts, nexts)]
    ef = fingerprints(edited)
    e0, e1, e2 = _blank(texts), _blank(edited), _blank(nexts)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([r.tobytes().hex() for r in own]), pa.array([r.tobytes().hex() for r in ef]),
            pa.array(likeness(own, ef, e0, e1)), pa.array(likeness(own, follow, e0, e2))]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(documents: DataFrame) -> DataFrame:
    """One row a document: NAMES."""
    spark = documents.sparkSession
    rows = columns_of(documents, doc_id="long", text="string").withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None  # held: the last row seen, its next is not known yet

        def end(kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            cells = [pa.nulls(1, a) for a in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            cells[0] = pa.array([doc_id], pa.int64())
            return pa.RecordBatch.from_arrays([*cells, pa.array([kind]), pa.array([part], pa.int32()), pa.array([text])], [*NAMES, "kind", "part", "text"])

        for df in chunks(batches, "text"):
            ids, texts = [None if i != i else int(i) for i in df["doc_id"].tolist()], [t or "" for t in df["text"]]
            own = fingerprints(texts)
            if held is None:
                yield end("first", ids[0], texts[0])
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
            held = ids[-1], texts[-1], own[-1:]
            if len(ids) > 1:
                cells = _rows(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([*cells, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], [*NAMES, "kind", "part", "text"])
        if held is not None:
            yield end("last", held[0], held[1])

    walked = materialize(rows.mapInArrow(walk, DDL + ", kind string, part int, text string"), "simhash")
    # two rows a partition: the last row of each goes with the first row of the next partition that has rows. Only the partitions' numbers
    # are put in order in one place; the texts meet by a join
    ends = materialize(walked.where("kind IS NOT NULL").select("part", "kind", "doc_id", "text"), "simhash-ends")
    first = ends.where("kind = 'first'").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")
    follows = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    pairs = ends.where("kind = 'last'").join(follows, "part").select("doc_id", "text", "next").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, nexts = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays(_rows(ids, texts, nexts, fingerprints(texts), fingerprints(nexts)), NAMES)

    return walked.where("kind IS NULL").select(*NAMES).unionByName(pairs.mapInArrow(finish, DDL))


def _longs(fp: Column) -> list[Column]:
    return [F.conv(F.substring(fp, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(HEX // 16)]


def within(queries: DataFrame, fingerprint_table: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, fingerprint, distance) for every distinct query fingerprint and every distinct fingerprint of the
    table at a distance of at most ``radius``. Both tables have a column ``fingerprint``."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be smaller than the number of blocks")
    cut = [round(i * HEX / blocks) for i in range(blocks + 1)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        fp = F.col(name)
        keys = [F.concat(F.lit(f"{k}:"), *[F.substring(fp, cut[b] + 1, cut[b + 1] - cut[b]) for b in pick])
                for k, pick in enumerate(combinations(range(blocks), blocks - radius))]
        return df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct().select(name, F.explode(F.array(*keys)).alias("key"))

    both = keyed(queries, "query").join(keyed(fingerprint_table, "found"), "key")
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_longs(F.col("query")), _longs(F.col("found")))), F.lit(0))
    return both.select("query", F.col("found").alias("fingerprint"), distance.alias("distance")).where(F.col("distance") <= radius).distinct()


EVERY = 100   # documents whose id is divisible by it are the queries of ``searched``. Fixed value of the contract.


def searched(fingerprinted: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """The rows of ``neighbours`` with ``n_within``: for a query document the number of other documents whose fingerprint lies within the radius;
    null for the others. Blank texts (fingerprint of zeros) are within nothing."""
    rows = materialize(fingerprinted, "simhash-rows")
    real = rows.where(F.col("fingerprint") != F.lit("0" * HEX))
    asked = F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False))
    table = real.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    found = within(real.where(asked), table, radius, blocks).join(table, "fingerprint").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("copies").alias("all_within"))
    queries = rows.where(asked).join(found, "fingerprint", "left").withColumn("n_within", F.greatest(F.coalesce("all_within", F.lit(1)) - 1, F.lit(0))).drop("all_within")
    return queries.unionByName(rows.where(~asked).withColumn("n_within", F.lit(None).cast("long")))
