"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A document is the set of its distinct word shingles, as 64-bit hashes. Two documents link when their Jaccard
similarity reaches the threshold t. Equal sets are one class. Then:

1. *Tiles.* Sizes fall into bands. Within a band the hash space is cut into parts, and a document's tile keys
   are (band, part, hash of its shingles in the part). Linked sets of sizes a and b differ in at most
   (a + b)(1 - t)/(1 + t) shingles, and a difference spoils one part at most. So two linked sets agree on a
   non-empty part among the first k + 1 non-empty ones of either, with k that bound for the largest possible
   partner; only those keys are sent. (A set with fewer non-empty parts also sends one extra key of its
   band, and meets all others of that kind there.) A document near the lower end of its band also takes
   part in the band below. A shared passage alone rarely fills a part, so unrelated documents seldom meet.
2. *Small tiles* (up to SMALL members) propose all their pairs; large ones first propose stars around
   a few members. Proposals are checked; links give components.
3. *Large tiles*, second pass: only members of different components can still matter. Tiles with the same smallest
   member are joined to one, cut into blocks, and the members' bitmaps
   (each shingle sets one bit of a width fixed by the size) are compared block by block: bits of one that the other
   lacks bound the overlap from above. Pairs that pass are proposed and checked.
4. *Check*: the bit-count bound again, then the exact intersection of the sorted arrays.

Components need no further link: every pair that shares a tile key is either proposed or already connected.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer words than a shingle
are one shingle, the whole sequence; texts of any length are read whole; equal rows are linked;
rows that share an id are one node; a null id links with nothing and has component null; an empty table gives an
empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, columns_of, connected_components, materialize, mix64, small_batches, word_bounds, word_hashes

WORDS, NUM, DEN = 5, 80, 100     # shingle length; link when DEN * intersection >= NUM * union
BAND = 1.5                       # ratio of a band's ends
SMALL, STARS = 6, 3              # members of a tile that propose all pairs; star centres of larger tiles
GRID = 512                       # documents compared at once in a large tile
BLOCK = 2048                     # members of a star that one task of the second pass compares with as many others
BROADCAST_ROWS = 2_000_000       # id lists up to this counted size are broadcast, longer ones are joined by shuffle
KEYS_PER_TASK = 2_000_000        # tile keys that one task sorts, about
SALTS = 16                       # parts of a star's members, and of the rows of one set, in joins
CHARS = 500_000                  # characters that a task turns into arrays at once

U64 = np.uint64


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingles of all texts, offsets by text)."""
    cp, off = code_points(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    ws, we, doc = word_bounds(cp, off)
    h = word_hashes(cp, ws, we)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    last = first[1:]
    sh = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, words):
            j = np.arange(h.size) + k
            ok = j < last[doc] if h.size else np.zeros(0, bool)
            sh[ok] = mix64(sh[ok] * U64(0x9E3779B97F4A7C15) + h[j[ok]] + U64(k))
    n = np.diff(first)
    keep = np.arange(h.size) - first[:-1][doc] <= np.maximum(n - words, 0)[doc] if h.size else np.zeros(0, bool)
    sh, doc = sh[keep], doc[keep]
    by = np.lexsort((sh, doc))
    sh, doc = sh[by], doc[by]
    new = np.ones(sh.size, bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    sh, doc = sh[new], doc[new]
    return sh, np.searchsorted(doc, np.arange(len(texts) + 1))


def band_of(size: np.ndarray) -> np.ndarray:
    """Band b holds the sizes from edge(b) up to, but not including, edge(b + 1)."""
    return np.searchsorted(_EDGES, size, side="right") - 1


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.asarray(out, np.int64)


_EDGES = _edges()


def differ(total: int) -> int:
    """Most shingles that two linked sets of ``total`` shingles together can differ in."""
    return total * (DEN - NUM) // (DEN + NUM)


def _parts(band: int) -> int:
    top = int(_EDGES[band + 1]) - 1
    return int(np.ceil(0.27 * top + 0.8 * np.sqrt(top) + 2))


def tile_keys(s: np.ndarray) -> np.ndarray:
    """The tile keys of one set, as int64."""
    n = s.size
    if not n:
        return np.zeros(0, np.int64)
    out = []
    own = int(band_of(np.asarray([n]))[0])
    most = DEN * n // NUM                     # a linked partner's largest size
    least = -(-NUM * n // DEN)                # and its smallest
    for band in range(int(band_of(np.asarray([least]))[0]), own + 1):
        m = _parts(band)
        k = differ(n + (most if band == own else min(most, int(_EDGES[band + 1]) - 1)))
        with np.errstate(over="ignore"):
            part = ((s >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)  # s is sorted, so parts are runs
            start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mix64(s), start)
            take = min(k + 1, start.size)
            keys = mix64(sums[:take] + mix64(part[start[:take]].astype(U64) + U64(band << 40)))
        out.append(keys)
        if start.size < k + 1:
            out.append(mix64(np.asarray([(band << 40) + (1 << 39)], U64)))
    return np.concatenate(out).view(np.int64)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set: two mixed sums."""
    with np.errstate(over="ignore"):
        a, b = mix64(s).sum(dtype=U64), mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """One bit a shingle; the width is a power of two of at least four bits a shingle."""
    width = 64
    while width < 4 * s.size:
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(mix64(s) & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(raw: bytes, width: int) -> np.ndarray:
    """A bitmap at a smaller width (bytes): halves are laid over each other."""
    b = np.frombuffer(raw, np.uint8)
    while b.size > width:
        b = b[:b.size // 2] | b[b.size // 2:]
    return b


def overlap_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest intersection with which sets of these sizes link."""
    return -(-(a + b) * NUM // (DEN + NUM))


def may_link(ma: np.ndarray, mb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """(a x b) bool from bitmaps (rows of uint64) and sizes: the bit-count bound."""
    bound = np.full((ma.shape[0], mb.shape[0]), 0, np.int64)
    only_a, only_b = bound.copy(), bound
    for i in range(ma.shape[0]):
        only_a[i] = np.bitwise_count(ma[i] & ~mb).sum(axis=1)
        only_b[i] = np.bitwise_count(mb & ~ma[i]).sum(axis=1)
    most = np.minimum(na[:, None] - only_a, nb[None, :] - only_b)
    return most >= overlap_needed(na[:, None], nb[None, :])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: the intersection of two sorted arrays of distinct shingles."""
    if a.size > b.size:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    both = int((b[at] == a).sum())
    return DEN * both >= NUM * (a.size + b.size - both)


def _sets(documents: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2, keys: size, set key and tile keys of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in chunks(batches, "text", CHARS):
            s, off = shingle_sets([t or "" for t in df["text"]])
            cut = [s[a:z] for a, z in zip(off[:-1], off[1:])]
            key = [_set_key(x) for x in cut]
            yield pa.RecordBatch.from_arrays([pa.array(df["doc_id"], pa.int64(), from_pandas=True), pa.array(np.diff(off), pa.int64()),
                                              pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.int64()),
                                              pa.array([tile_keys(x) for x in cut], pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "keys"])

    return columns_of(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, keys array<long>")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list]:
    """Runs of equal first column of sorted batches, as lists of python columns; a run may cross batches."""
    held: list[list] = [[] for _ in range(width)]
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(width)]
        key = cols[0]
        at = 0
        for i in range(len(key)):
            if held[0] and key[i] != held[0][0] or (i > at and key[i] != key[at]):
                for h, c in zip(held, cols):
                    h += c[at:i]
                yield held
                held, at = [[] for _ in range(width)], i
        for h, c in zip(held, cols):
            h += c[at:]
    if held[0]:
        yield held


def _distinct(p: np.ndarray) -> np.ndarray:
    """The distinct columns of a 2 x n array."""
    p = p[:, np.lexsort((p[1], p[0]))]
    first = np.ones(p.shape[1], bool)
    first[1:] = (p[:, 1:] != p[:, :-1]).any(axis=0)
    return p[:, first]


def _propose(rows: DataFrame) -> DataFrame:
    """From (key, id) rows that are partitioned by key: (a, b, star) with a < b. star is null for a proposal; for the
    members of large tiles, (star, a) rows come besides, with b null, where star is the tile's smallest member: tiles of
    one group of copies mostly have the same, so the second pass sees a document a few times, not once a tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
        del t, got
        by = np.lexsort((ids, key))
        key, ids = key[by], ids[by]
        new = np.ones(key.size, bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[new], ids[new]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, key.size))
        pairs = []
        for m in range(2, SMALL + 1):
            at = start[size == m]
            pairs += [np.stack([ids[at + i], ids[at + j]]) for i in range(m) for j in range(i + 1, m)]
        big = np.flatnonzero(size > SMALL)
        member = np.zeros(0, np.int64)
        if big.size:
            n = size[big]
            member = np.arange(int(n.sum())) + np.repeat(start[big] - (np.cumsum(n) - n), n)
            pairs += [np.stack([np.repeat(ids[start[big] + k], n), ids[member]]) for k in range(STARS)]
        if pairs:
            p = np.sort(np.concatenate(pairs, axis=1), axis=0)
            p = _distinct(p[:, p[0] != p[1]])
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), pa.nulls(p.shape[1], pa.int64())], ["a", "b", "star"])
        if big.size:
            m = _distinct(np.stack([np.repeat(ids[start[big]], n), ids[member]]))
            yield pa.RecordBatch.from_arrays([pa.array(m[1]), pa.nulls(m.shape[1], pa.int64()), pa.array(m[0])], ["a", "b", "star"])

    return rows.mapInArrow(run, "a long, b long, star long")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _sized(ids: DataFrame) -> DataFrame:
    """A broadcast only if its counted rows are few; else Spark joins by shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _details(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, map, body (the sorted shingles as bytes) of the documents in ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in chunks(batches, "text", CHARS):
            s, off = shingle_sets([t or "" for t in df["text"]])
            cut = [s[a:z] for a, z in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(df["doc_id"], pa.int64()), pa.array(np.diff(off), pa.int64()),
                                              pa.array([bitmap(x) for x in cut], pa.binary()), pa.array([x.tobytes() for x in cut], pa.binary())],
                                             ["id", "n", "map", "body"])

    docs = columns_of(documents, doc_id="long", text="string")
    return docs.join(_sized(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(run, "id long, n long, map binary, body binary")


def _check(pairs: DataFrame, details: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b)."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            ok = np.minimum(na, nb) >= overlap_needed(na, nb)
            for i in np.flatnonzero(ok):
                ma, mb = b.column(3)[i].as_py(), b.column(5)[i].as_py()
                w = min(len(ma), len(mb))
                ok[i] = may_link(_fold(ma, w).view(U64)[None], _fold(mb, w).view(U64)[None], na[i:i + 1], nb[i:i + 1])[0, 0]
            yield b.select([0, 1]).filter(pa.array(ok))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def side(name: str, *what: str) -> DataFrame:
        return details.select(F.col("id").alias(name), *[F.col(w).alias(w + name) for w in what])

    some = pairs.join(side("a", "n", "map"), "a").join(side("b", "n", "map"), "b").select("a", "b", "na", "mapa", "nb", "mapb").mapInArrow(bits, "a long, b long")
    some = materialize(some, "jac-bits")
    need = some.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    details = details.join(_sized(need), "id", "left_semi")  # only these sets move
    return some.join(side("a", "body"), "a").join(side("b", "body"), "b").select("a", "b", "bodya", "bodyb").mapInArrow(exact, "a long, b long")


def _second_pass(tiles: DataFrame, component: DataFrame, details: DataFrame) -> DataFrame:
    """(a, b): pairs of different components within large tiles of one star that pass the bit-count bound.

    Of a star with several components, the largest one's members need no comparison with each other. They are dealt to blocks of about
    BLOCK, the other members to blocks of their own; a task compares one block of either kind with one block of the others. A group of copies
    that is one component already but for a few strays thus costs a row a member, and no group, however large, lies in one task."""
    t = materialize(tiles.join(component, "id"), "jac-tiles")
    size = t.groupBy("star", "component").agg(F.count("*").alias("c"))
    open_ = size.groupBy("star").agg(F.max(F.struct("c", F.col("component").alias("main"))).alias("m"), F.sum("c").alias("all")).where(F.col("all") > F.col("m.c")) \
        .select("star", F.col("m.main").alias("main"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("n_main"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK).cast("int").alias("n_rest"))
    # dealt by (star, hash): one star may hold a third of the rows
    salted = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = t.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(SALTS)).cast("int")).join(salted, ["star", "salt"])
    rows = rows.withColumn("is_main", F.col("component") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    rest = F.sequence(F.lit(0), F.col("n_rest") - 1)
    # a place is (i, j): i a block of the main component (from 0) or of the others (-1 - block, at most j), j a block of the others
    place = F.when(F.col("is_main"), F.transform(rest, lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))) \
        .otherwise(F.concat(F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))),
                            F.transform(rest, lambda j: F.struct((-1 - F.least(j, "own")).alias("i"), F.greatest(j, "own").alias("j")))))
    rows = rows.withColumn("at", F.explode(place)).select("id", "component", "star", "at.i", "at.j", "own", "is_main").join(details.select("id", "n", "map"), "id")
    rows = rows.select(F.xxhash64("star", "i", "j").alias("key"), "star", "i", "j", "own", "is_main", "id", "component", "n", "map")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, star, i, j, own, main, ids, comp, n, maps in _groups(batches, 10):
            ids, comp, n, own, main = np.asarray(ids), np.asarray(comp), np.asarray(n), np.asarray(own), np.asarray(main)
            w = min(map(len, maps))
            m = np.stack([_fold(x, w) for x in maps]).view(U64)
            by = np.argsort(comp, kind="stable")  # pieces of one component are skipped whole
            if i[0] >= 0:
                sides = [by[main[by]], by[~main[by]]]
            else:
                sides = [by] if -1 - i[0] == j[0] else [by[own[by] == -1 - i[0]], by[own[by] == j[0]]]
            left, right = sides[0], sides[-1]
            for x in range(0, left.size, GRID):
                for y in range(x if len(sides) == 1 else 0, right.size, GRID):
                    a, b = left[x:x + GRID], right[y:y + GRID]
                    if comp[a[0]] == comp[b[-1]] == comp[a[-1]] == comp[b[0]]:
                        continue
                    ok = may_link(m[a], m[b], n[a], n[b]) & (comp[a][:, None] != comp[b][None, :])
                    if len(sides) == 1 and x == y:
                        ok = np.triu(ok, 1)
                    p, q = np.nonzero(ok)
                    if p.size:
                        u, v = ids[a[p]], ids[b[q]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    return rows.repartition(_partitions(t), "key").sortWithinPartitions("key", "star", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document."""
    spark = documents.sparkSession
    small_batches(spark)
    members = materialize(_sets(documents).select("doc_id", "n", "k1", "k2"), "jac-members")
    real = members.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets: only those of several rows need their smallest id, and meet it by (set, hash), as one may hold a third of the rows
    classes = real.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("c")).where("c > 1").select("k1", "k2", "cid") \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_class = materialize(real.select("doc_id", "k1", "k2", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
                             .join(classes, ["k1", "k2", "salt"]).select("doc_id", "k1", "cid"), "jac-classes")
    copies = with_class.where("doc_id <> cid").select("doc_id", "k1").distinct()
    keyed = _sets(documents).where("n > 0 AND doc_id IS NOT NULL").join(_sized(copies), ["doc_id", "k1"], "left_anti") \
        .select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    total = real.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total * 4 // 10 // KEYS_PER_TASK))
    proposed = materialize(_propose(keyed.repartition(parts, "key")), "jac-proposed")
    pairs = materialize(proposed.where("b IS NOT NULL").select("a", "b").distinct(), "jac-pairs")
    tiles = proposed.where("b IS NULL").select("star", F.col("a").alias("id")).distinct()
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jac-ids")
    details = materialize(_details(documents, ids), "jac-details")
    links = materialize(_check(pairs, details), "jac-links")
    comp = materialize(connected_components(ids, links), "jac-comp")
    more = materialize(_second_pass(tiles, comp, details), "jac-more")
    links = links.unionByName(_check(more, details))
    # copies hang on their class
    own = with_class.where("doc_id <> cid").select(F.col("doc_id").alias("a"), F.col("cid").alias("b")).distinct()
    links = materialize(links.unionByName(own), "jac-all")
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    comp = connected_components(nodes, links).withColumnRenamed("id", "doc_id")
    return members.select("doc_id", F.col("n").alias("n_shingles")).join(comp, "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group stays: one with the smallest id. Rows without an id or shingles all stay.

    Rows that share an id are nodes of their own under a drawn label, so copies of a row are a group like any other, and a text is
    not dropped for another one under its id."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"), F.col("text").alias("body"))
    many = materialize(rows.where("key IS NOT NULL").groupBy("key").count().where("count > 1").select(F.col("key").alias("many_id")), "jac-many")
    labelled, again = rows.withColumn("label", F.col("key")), None
    if many.limit(1).count():
        # written once, so a label is the same in every later read
        again = materialize(rows.join(_sized(many), F.col("key") == F.col("many_id"), "left_semi")
                            .withColumn("label", F.xxhash64("key", F.monotonically_increasing_id())), "jac-again")
        labelled = labelled.join(_sized(many), F.col("key") == F.col("many_id"), "left_anti").unionByName(again)
    linked = materialize(components(labelled.select(F.col("label").alias("doc_id"), F.col("body").alias("text")))
                         .where("doc_id <> component_id").select("doc_id", "component_id").distinct(), "jac-linked")
    gone = linked.select(F.col("doc_id").alias("gone_id"))
    if again is not None:
        gone = materialize(_gone(linked, again.select("label", "key")), "jac-gone")
    return labelled.join(_sized(gone), F.col("label") == F.col("gone_id"), "left_anti").select("row.*")


def _gone(linked: DataFrame, ids: DataFrame) -> DataFrame:
    """gone_id: every label of a group but the one whose id is smallest. Groups without a drawn label are settled."""
    members = linked.unionByName(linked.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
    members = materialize(members.join(_sized(ids), F.col("doc_id") == F.col("label"), "left")
                          .select("doc_id", "component_id", F.col("label").isNotNull().alias("drawn"), F.coalesce("key", "doc_id").alias("id")), "jac-members-of")
    stays = members.groupBy("component_id").agg(F.max("drawn").alias("any_drawn"), F.min(F.struct("id", "doc_id")).alias("m")).where("any_drawn") \
        .select(F.col("component_id").alias("group"), F.col("m.doc_id").alias("stays"))
    stays = materialize(stays, "jac-stays")
    met = members.join(_sized(stays), F.col("component_id") == F.col("group"), "left")
    return met.where(F.col("doc_id") != F.coalesce("stays", "component_id")).select(F.col("doc_id").alias("gone_id"))
