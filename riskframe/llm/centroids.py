"""Centroid clustering with zone maps: integer k-means whose assignment skips centroids by box distances.

Vectors become integer grids (``floor(scale * x)``) and are ordered along a Hilbert curve through the range of all
components; runs of the curve are cut into blocks of at most BLOCK vectors, each with its smallest and largest value
by component (its box). A block row holds ids and vectors as bytes. In every round a block compares its box with the
centroids: the squared distance from the box's nearest corner bounds a centroid from below, that of its furthest corner
from above. Centroids whose lower bound exceeds the smallest upper bound cannot be nearest to any vector of the block;
the others are its candidates and are compared exactly, all vectors at once. A task adds up its blocks and sends one
row a centroid and component range; the driver sees k x components sums.

Curve order needs no single task: blocks are cut inside range partitions, equal vectors are dealt by a hash of their
id, so a third of all rows being one vector is spread like anything else. The result never depends on the blocks.

Defined results: vectors of another length, null vectors, and vectors with a null, non-finite or out-of-range component
(``abs(x) >= 2**27 / scale``, beyond which a squared distance does not fit a long) are left out; rows that share an id are
vectors of their own; ties between centroids go to the smaller number; a null id is never a seed while other ids
are left; fewer vectors than ``k`` give fewer centroids; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, materialize, partitions

BLOCK = 256          # vectors of a block
CURVE_BITS = 2       # bits a component on the Hilbert curve
LIMIT = 1 << 27      # integer components stay below this
EXACT = 1 << 22      # below this, products of doubles are exact for up to 256 components


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """(n x d) ints of ``bits`` bits -> (n x d*bits/8) bytes, ordered as the d-dimensional Hilbert curve visits the cells.

    Works on all rows at once: from the highest bit down, the axes are reflected and exchanged as the curve
    turns, then Gray-decoded; the key takes one bit of every axis in turn."""
    x = cells.astype(np.uint32).T.copy()
    d = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(d):
            turned = (x[i] & np.uint32(q)) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[d - 1] & np.uint32(q), np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = [((x >> np.uint32(b)) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def box_bounds(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance from each centre to a point of the box, as int64."""
    under, over = low[None, :] - centres, centres - high[None, :]
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(under), np.abs(over))
    return (near * near).sum(1), (far * far).sum(1)


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centres that may be nearest to some point of the box."""
    near, far = box_bounds(low, high, centres)
    return np.flatnonzero(near <= far.min())


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of every vector of a block, exact; the smaller number wins a tie."""
    among = candidates(low, high, centres)
    c = centres[among]
    if max(int(np.abs(low).max()), int(np.abs(high).max()), int(np.abs(c).max())) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    else:
        d = np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)
    best = d.argmin(1)
    return among[best], d[np.arange(len(x)), best]


def quantised(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, q (array<long>): the vectors that take part."""
    rows = columns_of(embeddings, vec_id="long", embedding="array<double>")
    # a null component is neither in range nor out of it: coalesce makes it out
    sound = (F.size("embedding") == dims) & F.forall("embedding", lambda v: F.coalesce(F.abs(v) * scale < LIMIT, F.lit(False)) & ~F.isnan(v))
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("embedding", lambda v: F.floor(v * scale).cast("long")).alias("q"))


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The first ``k`` vectors by SHA-256 of ``1:<vec_id>``; null ids and then components break what ties are left."""
    rows = vectors.select("q", F.col("vec_id").isNull().alias("none"), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"))
    return np.asarray([r["q"] for r in rows.orderBy("none", "h", "q").limit(k).collect()], np.int64)


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """n, low, high, ids, holes, body: curve-ordered blocks. low/high/body are int64 bytes, ids int64 bytes, holes marks null ids."""
    # 8-byte components keep every allowed value; Parquet's compression removes what small values leave unused
    span = vectors.select(F.posexplode("q").alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # dims rows
    low, high = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for r in span:
        low[r["i"]], high[r["i"]] = r["lo"], r["hi"]
    width = np.maximum(high - low + 1, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, dims)
            key = hilbert_keys((x - low) * (1 << CURVE_BITS) // width, CURVE_BITS)
            raw = np.ascontiguousarray(x, "<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.tobytes() for k in key], pa.binary()), pa.array([v.tobytes() for v in raw], pa.binary())], ["vec_id", "key", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks()
                full = whole.num_rows // BLOCK * BLOCK
                yield from (_block(whole.slice(a, BLOCK), dims) for a in range(0, full, BLOCK))
                held = whole.slice(full).to_batches()
        if held and (rest := pa.Table.from_batches(held)).num_rows:
            yield _block(rest, dims)

    spark = vectors.sparkSession
    ordered = vectors.mapInArrow(keyed, "vec_id long, key binary, body binary").withColumn("deal", F.xxhash64("vec_id", "body")) \
        .repartitionByRange(partitions(spark), "key", "deal").sortWithinPartitions("key", "deal").select("vec_id", "body")
    return ordered.mapInArrow(cut, "n int, low binary, high binary, ids binary, holes binary, body binary")


def _block(t: pa.Table, dims: int) -> pa.RecordBatch:
    t = t.combine_chunks()
    ids, body = t.column(0), b"".join(t.column(1).to_pylist())
    x = np.frombuffer(body, "<i8").reshape(-1, dims)
    holes = np.packbits(np.asarray(ids.is_null().to_pylist(), bool)).tobytes()
    row = [len(x), x.min(0).tobytes(), x.max(0).tobytes(), ids.fill_null(0).combine_chunks().to_numpy(zero_copy_only=False).astype("<i8").tobytes(), holes, body]
    return pa.RecordBatch.from_arrays([pa.array([v], t_) for v, t_ in zip(row, [pa.int32(), *[pa.binary()] * 5])], ["n", "low", "high", "ids", "holes", "body"])


def _opened(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(low, high, vectors, ids, holes) of one block after the other."""
    for b in batches:
        for i in range(b.num_rows):
            n, low, high, ids, holes, body = (c[i].as_py() for c in b.columns)
            yield (np.frombuffer(low, "<i8"), np.frombuffer(high, "<i8"), np.frombuffer(body, "<i8").reshape(n, dims),
                   np.frombuffer(ids, "<i8"), np.unpackbits(np.frombuffer(holes, np.uint8))[:n].astype(bool))


def recentred(zone: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Every centre that some vector is nearest to moves to the floor of its vectors' exact mean."""
    k, dims = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, high = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for low, top, x, _, _ in _opened(batches, dims):
            own, _ = nearest(x, low, top, centres)
            count += np.bincount(own, minlength=k)
            for c in np.unique(own):
                total[c] += x[own == c].sum(0)
            high += total >> 40      # two limbs, so that no number of vectors overflows a long
            total &= (1 << 40) - 1
        on = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(count[on]), pa.array(list(total[on]), pa.list_(pa.int64())),
                                          pa.array(list(high[on]), pa.list_(pa.int64()))], ["cluster", "n", "low", "high"])

    each = zone.mapInArrow(add, "cluster int, n long, low array<long>, high array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = each.select("cluster", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s")) \
        .select("cluster", "i", "n", "s.low", "s.high").groupBy("cluster", "i").agg(wide("n"), wide("low"), wide("high")).collect()  # k x dims rows
    moved = centres.copy()
    for r in sums:
        moved[r["cluster"], r["i"]] = ((int(r["high"]) << 40) + int(r["low"])) // int(r["n"])
    return moved


def assigned(zone: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, high, x, ids, holes in _opened(batches, dims):
            own, d = nearest(x, low, high, centres)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=holes), pa.array(own, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return zone.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one row a vector that takes part.

    The sums are decimals cast to long; a sum beyond a long reads as null instead of ending the job."""
    spark = embeddings.sparkSession
    vectors = quantised(embeddings, dims, scale)
    centres = seeds(vectors, k)
    if not len(centres):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"),
                                                                                   ("inertia", "long"), ("centroid_sha256", "string"))])
    zone = materialize(blocks(vectors, dims), "zone-blocks")
    for _ in range(rounds):
        centres = recentred(zone, centres)
    found = materialize(assigned(zone, centres), "zone-assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda v: v if v < 2**63 else None
    rows = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    own = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
