"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

``targets`` shares the total size among sources by weight; a source stops at ``max_epochs`` times its own
size and its excess goes to the others by weight, round after round, until none is above its cap.
``mix`` turns target / size into whole repetitions for every document plus a fraction: documents of a
source in the order of a seeded hash take one more repetition until the fraction's words are reached; the
one document that crosses the line takes only the words that are missing. So each source hits its
target to the word, a rerun agrees, and nothing depends on partitioning.

The line is found by narrowing: size is summed by (source, hash prefix); only the bucket in which the
line falls is split further, so a source with a third of all rows is never ordered in one task.

Defined results: null text has size 0 and takes 0 words; a null source is a source of its own, last in
order; documents of size 0 take part with 0 words; an empty table gives an empty result; the hash is of id and
text, so rows without an id are told apart by their texts; if the line falls on rows equal in both, they are counted, as many as
fit take one more repetition and one row the rest; extra columns are kept apart and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, materialize

SEED = 20
LEVEL_BITS = 11   # hash bits per narrowing level: 2048 buckets a source and level
BROADCAST_SOURCES = 10_000  # rows of about 100 bytes
SALTS = 32        # a source's documents are spread over so many join keys
LEVELS = 3        # 33 bits in all, then documents of one prefix are summed exactly


def word_count(text: Column) -> Column:
    """Number of words of the whole text, 0 for null; native."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """source, source_size, weight: one row a source, weights repeating in code point order, null last."""
    per = materialize(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs")), "mix-sources")
    ranked = rank_strings(per, "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", w)


def rank_strings(df: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` from 0 in code point order, null last. Ranges of the key are ordered each in a window of
    its own and the counts of the ranges before are added, so no task holds all keys."""
    parts = materialize(df.repartitionByRange(_ranges(df), F.col(key).asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranks")
    per = parts.groupBy("range").agg(F.count("*").alias("n")).collect()  # one row a range, at most _ranges rows
    before, total = {}, 0
    for r in sorted(per, key=lambda r: r["range"]):
        before[r["range"]] = total
        total += r["n"]
    if not before:
        return parts.withColumn("rank", F.lit(0).cast("long")).drop("range")
    at = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("range"))
    inner = F.row_number().over(Window.partitionBy("range").orderBy(F.col(key).asc_nulls_last())) - 1
    return parts.withColumn("rank", (at + inner).cast("long")).drop("range")


def _ranges(df: DataFrame) -> int:
    return max(1, min(64, df.count() // 10_000 + 1))


def targets(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target``. Rounds of one small aggregate each; at most one round a clamped group."""
    state = materialize(sources.withColumn("clamped", F.col("source_size") <= 0), "mix-state")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    while True:
        s = state.agg(F.sum("source_size").alias("total"), F.sum(F.when(F.col("clamped"), cap)).alias("fixed"),
                      F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("w")).first()
        if not s["w"]:
            level = 0.0
            break
        level = (float(s["total"]) - float(s["fixed"] or 0.0)) / float(s["w"])
        over = (~F.col("clamped")) & (F.col("weight") * F.lit(level) > cap)
        if state.where(over).limit(1).count() == 0:
            break
        state = materialize(state.withColumn("clamped", F.col("clamped") | over), "mix-state")
    return state.withColumn("target", F.when(F.col("clamped"), cap).otherwise(F.col("weight") * F.lit(level)).cast("double")).drop("clamped")


def _hash(doc_id: Column, text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1)


def _plan(rows: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """src, source_size, target, whole, line, line_h, line_words: one row a source."""
    src = targets(source_sizes(rows, weights), max_epochs)
    src = src.withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) \
        .withColumn("whole", F.least(F.floor("epochs"), F.lit(max_epochs)).cast("long")) \
        .withColumn("need", F.greatest(F.round(F.col("target")) - F.col("whole") * F.col("source_size"), F.lit(0)).cast("long"))
    return materialize(_lines(rows, materialize(src.select(F.col("source").alias("src"), "source_size", "target", "whole", "need"), "mix-plan")), "mix-lines")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, reps, part_words: below the line one repetition more, on it the words that are missing."""
    key = F.shiftright("h", 63 - LEVEL_BITS * LEVELS)
    met = _meet(rows, plan)
    if plan.where("line_n > 1").limit(1).count():
        on = (F.col("line_n") > 1) & (F.col("h") == F.col("line_h"))
        met = met.where(~on).withColumn("place", F.lit(0).cast("long")).unionByName(_numbered(met.where(on)))
    else:
        met = met.withColumn("place", F.lit(0).cast("long"))
    return met \
        .withColumn("extra", F.when(key < F.col("line"), F.col("size"))
                    .when((key == F.col("line")) & (F.col("h") < F.col("line_h")), F.col("size"))
                    .when((key == F.col("line")) & (F.col("h") == F.col("line_h")), F.greatest(F.least(F.col("size"), F.col("line_words") - F.col("place") * F.col("size")), F.lit(0))).otherwise(F.lit(0))) \
        .withColumn("reps", F.when(F.col("size") > 0, F.col("whole") + (F.col("extra") == F.col("size")).cast("long")).otherwise(F.col("whole"))) \
        .withColumn("part_words", F.when((F.col("size") > 0) & (F.col("extra") < F.col("size")), F.col("extra")).otherwise(F.lit(0)).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``place``, from 0 among the rows of a source. Rows are numbered in the parts they lie in and the counts of the parts
    before are added, so no task holds them all."""
    parts = materialize(rows.withColumn("part", F.spark_partition_id()), "mix-equal")
    before = Window.partitionBy("src2").orderBy("part2").rowsBetween(Window.unboundedPreceding, -1)
    per = parts.groupBy(F.col("src").alias("src2"), F.col("part").alias("part2")).agg(F.count("*").alias("n")) \
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # one row a source and part
    inner = F.row_number().over(Window.partitionBy("src", "part").orderBy("h")) - 1
    return parts.withColumn("inner", inner).join(per, F.col("src").eqNullSafe(F.col("src2")) & (F.col("part") == F.col("part2"))) \
        .withColumn("place", (F.col("inner") + F.col("before")).cast("long")).drop("inner", "before", "part", "src2", "part2")


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    """row (all columns of the documents), doc_id, source, size, h, salt."""
    have = {c.lower(): F.col(f"`{c}`") for c in documents.columns}
    none = F.lit(None)
    doc_id, text, source = (have.get(c, none) for c in ("doc_id", "text", "source"))
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), doc_id.cast("long").alias("doc_id"),
                            source.cast("string").alias("source"), word_count(text.cast("string")).alias("size"), text.cast("string").alias("words")) \
        .withColumn("h", _hash(F.col("doc_id"), F.col("words"), seed)).drop("words").withColumn("salt", F.pmod("h", F.lit(SALTS)))


def mix(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, reps (whole repetitions), part_words (words of one more,
    partial repetition), taken. ``taken = reps * size + part_words``."""
    rows = materialize(_sized(documents, seed).drop("row"), "mix-docs")
    return _taken(rows, _plan(rows, weights, max_epochs)).withColumn("taken", F.col("reps") * F.col("size") + F.col("part_words")) \
        .select("doc_id", "source", "size", "source_size", "target", "reps", "part_words", "taken")


def repeat(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """The mixed corpus itself: the columns of ``documents``, one row a repetition; a partial repetition is the
    first ``part_words`` words of the text, joined by spaces. Texts meet their source's plan, a row a source, and are
    not shuffled by document."""
    rows = _sized(documents, seed)
    plan = _plan(materialize(rows.drop("row"), "mix-docs"), weights, max_epochs)
    out = _taken(rows, plan).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reps")))) \
        .where("copy < reps OR part_words > 0").withColumn("whole_copy", F.col("copy") < F.col("reps"))
    name = {c.lower(): c for c in documents.columns}
    words = F.filter(F.split(F.col("row").getField(name["text"]), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    part = F.concat_ws(" ", F.slice(words, F.lit(1), F.greatest(F.col("part_words"), F.lit(1)).cast("int")))
    out = out.withColumn("new_text", F.when(F.col("whole_copy"), F.col("row").getField(name["text"])).otherwise(part))
    cells = []
    for c in documents.columns:
        cell = F.col("row").getField(c)
        if c.lower() == "text":
            cell = F.col("new_text")
        elif c.lower() == "n_chars":
            cell = F.when(F.col("whole_copy"), cell).otherwise(F.length("new_text").cast(documents.schema[c].dataType))
        cells.append(cell.alias(c))
    return out.select(*cells)


def _meet(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Documents with their source's row. The sources' rows are broadcast if their counted number is small; else each is
    copied to every salt, so that no source is one join key."""
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per_source), rows["source"].eqNullSafe(per_source["src"]))
    p = per_source.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(p, rows["source"].eqNullSafe(p["src"]) & (rows["salt"] == p["salt2"])).drop("salt2")


def _lines(rows: DataFrame, src: DataFrame) -> DataFrame:
    """src plus, per source, the hash prefix ``line``, hash ``line_h`` and words ``line_words`` where the fraction ends."""
    at = src.withColumn("line", F.lit(0).cast("long")).withColumn("left", F.col("need"))
    for level in range(1, LEVELS + 1):
        down = 63 - LEVEL_BITS * level
        above = F.shiftright("h", down + LEVEL_BITS)
        sums = _meet(rows, at.select("src", "line")).where(above == F.col("line")) \
            .groupBy("src", F.shiftright("h", down).alias("next")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("src").orderBy("next")  # at most 2048 rows a source
        run = sums.withColumn("upto", F.sum("words").over(w))
        step = run.join(at.select(F.col("src").alias("s"), "left"), F.col("src").eqNullSafe(F.col("s"))).where("upto > left") \
            .groupBy("src").agg(F.min_by(F.struct("next", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left")), "next").alias("m")) \
            .select("src", "m.next", F.col("m.left").alias("rest"))
        a, b = at.drop("line", "left"), step.withColumnRenamed("src", "s2")
        # no bucket passes the need: the line lies beyond the last hash (a source that needs nothing more stops at once)
        at = materialize(at.select("src", "source_size", "target", "whole", "need", "line", "left")
                         .join(b, F.col("src").eqNullSafe(F.col("s2")), "left")
                         .select("src", "source_size", "target", "whole", "need",
                                 F.coalesce("next", F.shiftleft(F.col("line") + 1, LEVEL_BITS) - 1).alias("line"),
                                 F.coalesce("rest", "left").alias("left")), "mix-line")
    # documents of one 33-bit prefix: almost always one; equal hashes are one unit
    last = _meet(rows, at.select("src", "line", "left")).where(F.shiftright("h", 63 - LEVEL_BITS * LEVELS) == F.col("line")) \
        .groupBy("src", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left"))
    w = Window.partitionBy("src").orderBy("h")
    last = last.withColumn("upto", F.sum("words").over(w)).where("upto > left") \
        .groupBy("src").agg(F.min_by(F.struct("h", F.expr("left - (upto - words)").alias("words"), "n"), "h").alias("m")) \
        .select(F.col("src").alias("s2"), F.col("m.h").alias("line_h"), F.col("m.words").alias("line_words"), F.col("m.n").alias("line_n"))
    return at.join(last, F.col("src").eqNullSafe(F.col("s2")), "left") \
        .select("src", "source_size", "target", "whole", "line", F.coalesce("line_h", F.lit(2**63 - 1)).alias("line_h"), F.coalesce("line_words", F.lit(0)).cast("long").alias("line_words"),
                F.coalesce("line_n", F.lit(0)).alias("line_n"))
