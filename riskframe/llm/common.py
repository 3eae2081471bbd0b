"""Helpers shared by the operators of this subpackage: scratch tables, text arrays, components, ranks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.session import ensure_checkpoint_dir

#: White space of every word definition here: space and U+0009..U+000D. Fixed values of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
ROW_GROUP = 16 << 20     # bytes of a row group of scratch tables
ARROW_ROWS = 1000        # rows of an Arrow batch of whole texts
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Exactly the named columns, cast; a column that is absent reads as null. Extra columns (whatever
    their names) never reach an operator's own working columns."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[k.lower()]}`").cast(t) if k.lower() in have else F.lit(None).cast(t)).alias(k)
                       for k, t in wanted.items()])


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Survives lost executors. Small row groups bound what a writer holds."""
    path = scratch_path(df.sparkSession, tag)
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(doc_id: Column) -> Column:
    """The held-out fold: crc32 of the id as text, remainder 0 by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


# ---------------------------------------------------------------- text as flat arrays

_LOWER_TABLE: np.ndarray | None = None


def lower_table() -> np.ndarray:
    """Code point -> simple lower case, for the basic plane (others stay)."""
    global _LOWER_TABLE
    if _LOWER_TABLE is None:
        t = np.arange(0x10000, dtype=np.uint32)
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000:
                low = chr(c).lower()
                if len(low) == 1:
                    t[c] = ord(low)
        _LOWER_TABLE = t
    return _LOWER_TABLE


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat code points, offsets): text i is flat[offsets[i]:offsets[i + 1]]."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum(lens)))


def is_space(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def word_bounds(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of all words; a word never crosses a text's end."""
    if cp.size == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~is_space(cp)
    first = np.zeros(cp.size, bool)
    first[offsets[:-1][offsets[:-1] < cp.size]] = True
    prev = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (first | ~prev))
    nxt = np.concatenate((word[1:], [False]))
    last = np.concatenate((first[1:], [True]))
    ends = np.flatnonzero(word & (last | ~nxt)) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (uint64 in, uint64 out)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: sum of mixed (code point, place) pairs, mixed again with the length."""
    if starts.size == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = ends - starts
        place = np.arange(int(run.sum()), dtype=np.int64) - np.repeat(np.cumsum(run) - run, run)
        at = np.repeat(starts, run) + place
        v = mix64(cp[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        total = np.add.reduceat(v, np.cumsum(run) - run)
        return mix64(total + run.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def chunks(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1_500_000) -> Iterator[pd.DataFrame]:
    """Arrow batches re-cut so that each piece holds about ``chars`` characters of column ``text`` (at least
    one row): a worker's memory is bounded whatever the batch size and however long the texts."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = np.asarray([0 if v is None else v for v in pa.compute.binary_length(col).to_pylist()], dtype=np.int64)
        cut = np.cumsum(size) // chars
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield b.slice(a, z - a).to_pandas()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS texts unless the session has a number of its own: JVM and worker hold a batch each, off the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(ARROW_ROWS))


def over_texts(returns: str, start: Callable[[], Callable[[list], pa.Array]], chars: int = 250_000) -> Callable[[Column], Column]:
    """A function of a text column alone; the other columns never leave the JVM. ``start`` is called once a task and gives the function
    from some texts (None for null) to as many results; it gets about ``chars`` characters at once (one text at least).
    Marked as nondeterministic so that a filter on the result does not compute it twice."""
    @F.arrow_udf(returns)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for a in arrays:
            parts, held, size = [], [], 0
            for v in a:
                held.append(v.as_py())
                size += len(held[-1] or "")
                if size > chars:
                    parts, held, size = [*parts, work(held)], [], 0
            if held or not parts:
                parts.append(work(held))
            yield pa.concat_arrays(parts)

    return run.asNondeterministic()


def real_name(df: DataFrame, name: str) -> str | None:
    """The column of that name in whatever case, quoted; None if there is none."""
    return next((f"`{c}`" for c in df.columns if c.lower() == name.lower()), None)


# ---------------------------------------------------------------- order and components

def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component): component = the smallest id reachable by ``links`` (a, b), itself included.

    Large-star / small-star rounds: every round hangs each node's larger neighbours, then its whole
    neighbourhood, on the smallest neighbour, until nothing changes. Only edges are shuffled; a hub's
    neighbours are reduced by a minimum (map-side first), never gathered in one place.
    """
    spark = nodes.sparkSession
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "cc")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == last:
            break
        last = (now["n"], now["s"])
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(found, nodes["id"] == found["u"], "left").select(nodes["id"], F.coalesce("m", nodes["id"]).alias("component"))


LONG, DOUBLE, STRING, INT, BINARY = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BinaryType()
