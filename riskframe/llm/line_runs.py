"""Line dedup by levelled sorted runs of line hashes. DataFrame functions only.

``LineRuns`` is an index of line hashes: a run is a table (key, docs, top) that is bucketed and sorted by key, with the
number of documents of its batch that hold the line and the largest id among them. A new batch is merge-anti-joined
with every run: lines that a run has already seen in enough documents need no further entry; the rest becomes a run of
its own on level 0. As soon as a level has FANOUT runs, they are compacted to one run of the next level (documents added
up, largest id kept) and dropped. Runs share their bucketing, so only the batch is shuffled, once, by its own
aggregation; runs are never moved again.

``dedup`` writes the hashes of all long lines once (id, row, place, key), deals them to BATCHES ranges of ids and
adds those from the largest ids down: a line that is settled early thereby has its largest id already. What the index
then holds in at least ``min_docs`` documents is joined with the lines; lines outside the largest id are dropped by
place. A line is counted map-side first, so one that is in a third of all documents is a row a task; joins with
settled lines or with the documents are broadcast up to a counted size and otherwise left to Spark, which splits skewed keys.

Defined results: a null or empty text is one empty line; documents are told apart by id, repeated rows of an id are one
document with the lines of all of them; a null id counts as one document, below all others; lines of every length are
hashed whole, texts of any length are split whole; ties cannot occur, as the largest id holds a line alone and keeps all its
repetitions; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir

from .common import LOWER, UPPER, columns_of, materialize, partitions, scratch_path

BATCHES, FANOUT = 4, 3
SETTLED_ROWS = 500_000      # settled lines up to this number (40 bytes each) are broadcast
DROPPED_PLACES = 500_000    # places of dropped lines (and documents) up to this number (about 100 bytes each) are broadcast
BLANK = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)          # stands for a null id, below all others


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case. Lines of ASCII only take the faster way."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """The index: levels of runs, each a table bucketed and sorted by key, in a database of its own in the shared folder."""

    def __init__(self, spark: SparkSession, enough: int, fanout: int = FANOUT) -> None:
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.buckets, self.levels, self.made = partitions(spark), [[]], 0
        ensure_checkpoint_dir(spark)
        self.name = f"line_runs_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{scratch_path(spark, 'line-runs')}'")

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}.run_{self.made}"
        self.made += 1
        rows.select("key", "docs", "top").write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's rows (key, docs, top) without the lines that some run holds in enough documents."""
        for run in self.runs():
            batch = batch.join(run.where(F.col("docs") >= self.enough).select("key").hint("merge"), "key", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """A batch (id, key) of documents that no earlier batch held; ids go down from batch to batch."""
        own = batch.distinct().groupBy("key").agg(F.count("*").alias("docs"), F.max("id").alias("top"))
        self._write(self.unseen(own), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merge([self.spark.table(t) for t in old]), level + 1)
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")
            level += 1

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Merge-joins the runs, which are bucketed and sorted alike: nothing is shuffled, a line has a row a run at most.
        (A union of bucketed tables under an aggregation gives wrong sums in Spark 4.1, as it is taken for co-partitioned.)"""
        rows = runs[0]
        for r in runs[1:]:
            other = r.select("key", F.col("docs").alias("more"), F.col("top").alias("also"))
            rows = rows.hint("merge").join(other.hint("merge"), "key", "full_outer") \
                .select("key", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("top", "also").alias("top"))
        return rows

    def settled(self) -> DataFrame:
        """(key, top): lines in enough documents, with the largest id."""
        return self._merge(self.runs()).where(F.col("docs") >= self.enough).select("key", "top")

    def close(self) -> None:
        """Runs end with the job that built them."""
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def dedup(documents: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped; one row a document."""
    spark = documents.sparkSession
    docs = columns_of(documents, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("row", F.xxhash64("text"))
    cuts = docs.select("id").agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else None
    batch = sum(((F.col("id") <= c).cast("int") for c in sorted(set(cuts or []), reverse=True)), F.lit(0))  # 0: the largest ids
    lines = docs.select("id", "row", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("bare", line_key(F.col("line"))) \
        .where(F.char_length("bare") >= min_chars).select("id", "row", "place", F.unhex(F.md5("bare")).alias("key"), batch.alias("batch"))
    path = scratch_path(spark, "line-hashes")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    index = LineRuns(spark, min_docs, fanout)
    try:
        for b in range(len(set(cuts or [])) + 1):
            index.add(lines.where(F.col("batch") == b).select("id", "key"))
        settled = materialize(index.settled(), "line-settled")
    finally:
        index.close()

    few = settled.limit(SETTLED_ROWS + 1).count() <= SETTLED_ROWS
    dropped = lines.join(_sized(settled, few), "key").where("id < top").select("id", "row", "place").distinct() \
        .groupBy("id", "row").agg(F.collect_list("place").alias("gone"))   # the places of one text: never more than its lines
    dropped = materialize(dropped, "line-dropped")
    size = dropped.agg(F.count("*").alias("n"), F.sum(F.size("gone")).alias("places")).first()
    small = size["n"] + (size["places"] or 0) <= DROPPED_PLACES
    out = docs.join(_sized(dropped, small), ["id", "row"], "left").withColumn("lines", F.split("text", "\n")).withColumn("n", F.size("lines"))
    # places that stay, by a hash set: linear in the lines of a text
    stay = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    return out.select("doc_id", kept.alias("text"), F.col("n").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
