"""Conversation prefix trie by fixed-length block hashing.

A conversation is a sequence of turns; a node of the trie is a distinct sequence of first turns, its members are the
conversations that begin with it. Turns are hashed at the scan, texts never move. Then:

1. *Places.* Turns are numbered by (turn, hash) within range partitions of (conversation, turn, hash); what lies in
   earlier partitions is added from a small table, so no conversation, however long, is sorted in one task.
2. *Blocks.* BLOCK turns in a row are one block row with its digest. The key of the prefix in front of a block is a sum of
   hashes of (block number, digest), as four 32-bit words: sums need no order, so long conversations are summed in
   pieces of PIECE blocks.
3. *Grouping by blocks.* Conversations are grouped by (prefix key, block digest): a shared block, on however many conversations,
   becomes one row with their count and smallest id.
4. *Refining.* Where all members of a prefix continue with one block, its inner turn boundaries have that block's members. Only
   where siblings diverge inside a block (several blocks behind one prefix) are the blocks cut into their turns, and equal
   beginnings added up.
5. *Subtrees.* A node belongs to its smallest member, a leaf to one conversation. So the sums over a subtree are sums over the
   node's members of what each owns, and take one more pass of steps 3 and 4 instead of one a level.
6. *Ends.* Ids of equal conversations are sorted by range, joined to pieces of text, and the pieces are hashed in order; a group of
   copies is hashed as a stream and never held.

Defined results: a null role or text is empty; turns are ordered by turn (null first), equal turns by hash; repeated rows are turns of
their own; rows without a conversation id are left out; an empty table has no node, not even the root; texts of any length are
hashed whole; ties for the smallest member cannot occur; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, materialize, partitions

BLOCK = 4            # turns of a block
PIECE = 1024         # blocks of one conversation that are summed in one window
CHUNK = 1 << 16      # bytes of joined ids of one piece
GROUP, SHARED = 20, 4   # conversations that start alike, and the modulus of the number of turns they share


# ---------------------------------------------------------------- turns

def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (16 bytes), words of every turn with an id."""
    rows = columns_of(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    return rows.select("conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def numbered(rows: DataFrame, group: str, order: list[Column], tag: str) -> DataFrame:
    """rows with ``place``: 0, 1, ... within ``group`` by ``order``, without sorting a group in one task."""
    spark = rows.sparkSession
    dealt = materialize(rows.repartitionByRange(partitions(spark), group, *order).withColumn("part", F.spark_partition_id()), tag)
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("n"))
    over = counts.groupBy(group).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(group)
    # only groups that cross a partition's end: two rows a partition at most
    before = counts.join(over, group).withColumn("before", F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    local = dealt.withColumn("here", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1)
    return local.join(F.broadcast(before.select(group, "part", "before")), [group, "part"], "left") \
        .withColumn("place", (F.col("here") + F.coalesce("before", F.lit(0))).cast("long")).drop("here", "before", "part")


def rebuilt(numbered_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after sharing starts: conversation c gets the first h turns of c - c % GROUP (all if fewer, none if it
    is absent), h = crc32(decimal c) % SHARED, and then its own turns after its first h. conversations: conv_id, base, h, front."""
    t = numbered_turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED)
    head = numbered_turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < SHARED - 1))  # a few turns each
    have = head.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("have"))
    convs = t.select("conv_id", "h").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(have, "base", "left") \
        .withColumn("front", F.least("h", F.coalesce("have", F.lit(0)))).select("conv_id", "base", "h", "front")
    convs = materialize(convs, "trie-convs")
    lent = convs.where("front > 0").join(head.select(F.col("conv_id").alias("base"), "place", "digest", "words"), "base").where("place < front") \
        .select("conv_id", "place", "digest", "words")
    # own turns move up only where the base is shorter than h
    short = convs.where("front < h").select("conv_id", "front")
    own = t.where("place >= h").join(short, "conv_id", "left") \
        .select("conv_id", (F.col("place") - F.col("h") + F.coalesce("front", "h")).alias("place"), "digest", "words")
    return lent.unionByName(own), convs


# ---------------------------------------------------------------- blocks

def _short(*parts: Column) -> Column:
    """16 bytes of a SHA-256 over parts that are bytes of fixed length."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _bytes(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def blocks(all_turns: DataFrame) -> DataFrame:
    """conv_id, block, before, after, digest, chain, words, front: one row a block of a conversation.

    before/after: keys of the prefixes in front of and behind it; chain: for every j the digest of the block's first j turns; words: of
    each turn; front: of all turns in front of the block."""
    row = all_turns.withColumn("block", F.floor(F.col("place") / BLOCK)).withColumn("piece", F.floor(F.col("block") / PIECE)).repartition(partitions(all_turns.sparkSession), "conv_id", "piece")
    met = row.groupBy("conv_id", "piece", "block").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("t"))  # at most BLOCK turns
    met = met.withColumn("d", F.col("t.digest")).withColumn("words", F.col("t.words"))
    met = met.withColumn("chain", F.transform(F.sequence(F.lit(1), F.size("d")), lambda j: F.unhex(F.substring(F.sha2(F.array_join(F.transform(F.slice("d", F.lit(1), j), lambda x: F.hex(x)), ""), 256), 1, 32))))
    met = met.withColumn("digest", F.element_at("chain", -1)).withColumn("sum", F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b))
    piece = F.sha2(F.concat(_bytes(F.col("block")), F.col("digest")), 256)
    for i in range(4):  # 32-bit words: sums of fewer than 2**31 blocks stay inside a long
        met = met.withColumn(f"h{i}", F.conv(F.substring(piece, 8 * i + 1, 8), 16, 10).cast("long"))
    sums = ["h0", "h1", "h2", "h3", "sum"]
    upto = Window.partitionBy("conv_id", "piece").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    met = met.select("conv_id", "piece", "block", "chain", "digest", "words", *sums, *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"b_{c}") for c in sums])
    met = materialize(met, "trie-blocks")
    pieces = met.groupBy("conv_id", "piece").agg(*[F.sum(c).alias(f"s_{c}") for c in sums])
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = pieces.select("conv_id", "piece", *[F.sum(f"s_{c}").over(ahead).alias(f"a_{c}") for c in sums]).where("piece > 0")  # one row in BLOCK * PIECE turns
    met = met.join(ahead, ["conv_id", "piece"], "left")
    for c in sums:
        met = met.withColumn(f"b_{c}", F.col(f"b_{c}") + F.coalesce(f"a_{c}", F.lit(0)))
    key = lambda n, add: _short(_bytes(n), *[_bytes(F.col(f"b_h{i}") + (F.col(f"h{i}") if add else 0)) for i in range(4)])
    return met.select("conv_id", "block", key(F.col("block"), False).alias("before"), key(F.col("block") + 1, True).alias("after"), "digest", "chain", "words",
                      F.col("b_sum").alias("front"))


def root_key() -> Column:
    return _short(*[_bytes(F.lit(0))] * 5)


def boundaries(groups: DataFrame, *carry: str) -> DataFrame:
    """The turn boundaries inside blocks: key, parent, depth, j, word (of the last turn), ahead (of all turns before it), and ``carry``."""
    inner = lambda j: F.when(j == BLOCK, F.col("after")).otherwise(_short(F.col("before"), F.get("chain", j - 1)))
    each = groups.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("chain"))))
    ahead = F.aggregate(F.slice("words", F.lit(1), F.col("j") - 1), F.col("front"), lambda a, b: a + b)
    return each.select(inner(F.col("j")).alias("key"), F.when(F.col("j") == 1, F.col("before")).otherwise(inner(F.col("j") - 1)).alias("parent"),
                       (F.col("block") * BLOCK + F.col("j")).alias("depth"), "j", F.get("words", F.col("j") - 1).alias("word"), ahead.alias("ahead"), *carry)


# ---------------------------------------------------------------- nodes

def ends_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 from (key, conv_id): the hash of the ids, ascending, comma-joined."""
    n = partitions(ends.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, text = None, 0, []
        size = 0
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and (k != key or size > CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(text)])], ["key", "first", "ids"])
                    text, size = [], 0
                if not text:
                    key, first = k, c
                text.append(str(c))
                size += len(text[-1]) + 1
        if text:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(text)])], ["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, n = None, None, 0
        done: tuple[list, list] = ([], [])
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if h is not None:
                        done[0].append(key), done[1].append(h.hexdigest())
                    key, h, n = k, hashlib.sha256(), 0
                h.update((b"," if n else b"") + ids.encode())
                n += 1
            if len(done[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1])], ["key", "ends_sha256"])
                done = ([], [])
        if h is not None:
            done[0].append(key), done[1].append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["key", "ends_sha256"])

    pieces = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def trie(all_turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv_id, place, digest, words) turns of the conversations in ``convs``, which may be turnless.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key."""
    rows = materialize(blocks(all_turns), "trie-rows")
    total = rows.groupBy("conv_id").agg(F.max(F.struct("block", F.when(F.size("chain") == BLOCK, F.col("after")).otherwise(_short(F.col("before"), F.col("digest"))).alias("key"),
                                                        (F.col("front") + F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)).alias("w"))).alias("m"))
    whole = materialize(convs.select("conv_id").distinct().join(total, "conv_id", "left")
                        .select("conv_id", F.coalesce("m.w", F.lit(0)).alias("total"), F.coalesce("m.key", root_key()).alias("end")), "trie-whole")
    all_of = whole.agg(F.count("*").alias("n"), F.min("conv_id").alias("lo"), F.sum("total").alias("total")).first()

    # conversations by blocks: one row for each distinct block behind a prefix
    groups = rows.join(whole.select("conv_id", "total"), "conv_id").groupBy("before", "block", "digest") \
        .agg(F.count("*").alias("n"), F.min("conv_id").alias("lo"), F.sum("total").alias("total"), *[F.any_value(c).alias(c) for c in ("after", "chain", "words", "front")])
    groups = materialize(groups, "trie-groups")
    forks = groups.where("block > 0").groupBy("before").count().where("count > 1").select("before", F.lit(True).alias("fork"))
    # first blocks all hang on the root, which counts as a fork: no join on that one key
    later = groups.where("block > 0").join(forks, "before", "left").withColumn("fork", F.coalesce("fork", F.lit(False)))
    groups = materialize(later.unionByName(groups.where("block = 0").withColumn("fork", F.lit(True))), "trie-forks")

    sums = lambda *c: [F.sum(x).alias(x) for x in c]
    same = ["parent", "depth", "j", "word", "ahead"]
    refined = boundaries(groups.where("fork"), "n", "lo", "total").groupBy("key").agg(*[F.any_value(c).alias(c) for c in same], *sums("n", "total"), F.min("lo").alias("lo"))
    plain = boundaries(groups.where("NOT fork"), "n", "lo", "total")
    nodes = materialize(refined.unionByName(plain), "trie-nodes")
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "trie-children")

    # what each conversation owns: the nodes whose smallest member it is, and the leaf it ends in
    owned = nodes.groupBy(F.col("lo").alias("conv_id")).agg(F.sum("word").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owned = materialize(whole.join(owned, "conv_id", "left").select("conv_id", "total", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-owned")
    by_group = rows.select("conv_id", "before", "block", "digest").join(owned, "conv_id").groupBy("before", "block", "digest").agg(*sums("own", "leaf"))
    sub = groups.join(by_group, ["before", "block", "digest"])
    sub = boundaries(sub.where("fork"), "own", "leaf").groupBy("key").agg(*sums("own", "leaf")).unionByName(boundaries(sub.where("NOT fork"), "own", "leaf").select("key", "own", "leaf"))
    nodes = nodes.join(sub, "key")

    # saved: members' words from the node's last turn on, less each node of the subtree once (the smallest member owns the whole path from here on)
    first = owned.select(F.col("conv_id").alias("lo"), F.col("total").alias("lo_total"), F.col("own").alias("lo_own"))
    nodes = nodes.join(first, "lo")
    saved = (F.col("total") - F.col("n") * F.col("ahead")) - (F.col("own") - F.col("lo_own") + F.col("lo_total") - F.col("ahead"))
    nodes = materialize(nodes.select("key", "parent", "depth", F.col("lo").alias("conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens")), "trie-sums")
    # depth 1 hangs on the root: again no join on that one key
    up = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.where("depth > 1").join(up, "parent").unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(all_of["lo"]).cast("long"))).drop("parent")
    if all_of["n"]:  # the root: all conversations; it is a leaf itself if nobody has a turn
        n_children = nodes.where("depth = 1").count()
        of_all = owned.agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf")).first()
        # the smallest conversation owns its whole path, so what all own is what all nodes say
        row = (all_of["lo"], 0, None, all_of["n"], n_children, of_all["leaf"] if n_children else 1, all_of["total"] - of_all["own"])
        root = rows.sparkSession.createDataFrame([row], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
        out = out.unionByName(root.withColumn("key", root_key()))
    digest = ends_digest(whole.select(F.col("end").alias("key"), "conv_id"))
    return out.join(digest, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))) \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row a node of the trie of the
    rebuilt conversations (see ``rebuilt``)."""
    placed = materialize(numbered(turns(conversations), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], "trie-dealt"), "trie-turns")
    all_turns, convs = rebuilt(placed)
    return trie(all_turns, convs).drop("key")
