"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one class with a weight. The classes of a label larger than a block are dealt to the nearest of its own
pivots (a sample of the label, one for each block), the cells to blocks of about BLOCK vectors, SIDE blocks to a strip.
Two strips meet in a tile unless all their blocks' pivots are further apart than both covering radii and the threshold distance
together, so a vector is sent once for each strip of its label that may hold a partner. A tile builds a cover tree of each block:
nested levels whose radii halve; for two blocks it goes down both trees at once and drops every pair of nodes that is further apart
than both nodes' covering radii and the threshold distance. What is left at the leaves is compared exactly, in double precision. A
tile sends back sums (linked weight of each class) and a spanning forest of its links, never its pairs.

In vectors without cluster structure no exact bound can prune much above the leaves, so work there is quadratic
in the size of a label, in matrix products; groups of near copies cost one tile's sums.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose label or
id is null, links with nothing (0 links; component_id is its own id, kept is true unless the id is null);
vectors of different length do not link; copies count as linked with each other; rows that share an id are one
node of the graph; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, connected_components, materialize

BLOCK = 1024
SIDE = 8                          # blocks of a strip
MAX_PIVOTS, ALL_PIVOTS = 1024, 65_536   # pivots of a label and of all labels; they steer the pruning, never the result
RADII = (1.0, 0.5, 0.25, 0.125)   # halving covering radii below the root (unit vectors lie within 2)
SLACK = 1e-7                      # on distances, so that rounding never prunes a true pair


class CoverTree:
    """Nested levels over unit vectors: level k splits every node of the level above into nodes of at most RADII[k]."""

    def __init__(self, x: np.ndarray) -> None:
        n = x.shape[0]
        self.node = [np.zeros(n, np.int64)]       # node of each point, by level; level 0 is the root
        self.center, self.parent = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.radius = [np.asarray([np.sqrt(max(0.0, ((x - x[0]) ** 2).sum(1).max()))])]
        for r in RADII:
            above, own = self.node[-1], np.full(n, -1, np.int64)
            centers, radii = [], []
            free = np.arange(n)
            while free.size:
                near = free[above[free] == above[free[0]]]
                d2 = 2 - 2 * (x[near] @ x[free[0]])
                mine = d2 <= r * r
                mine[0] = True
                own[near[mine]] = len(centers)
                radii.append(np.sqrt(max(0.0, d2[mine].max())))
                centers.append(free[0])
                free = free[own[free] < 0]
            self.node.append(own)
            self.center.append(np.asarray(centers))
            self.parent.append(above[centers])
            self.radius.append(np.asarray(radii))
            if len(centers) > 0.9 * n:  # nearly every point is a node of its own: the leaves come next
                break


def dual_traversal(a: CoverTree, b: CoverTree, xa: np.ndarray, xb: np.ndarray, reach: float) -> np.ndarray:
    """(points of a x points of b) bool: pairs that no node bound excludes."""
    keep = np.ones((1, 1), bool)
    depth = min(len(a.node), len(b.node))
    for k in range(depth):
        if k:
            keep = keep[a.parent[k]][:, b.parent[k]]
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (xa[a.center[k]] @ xb[b.center[k]].T)))
        keep &= d <= reach + SLACK + a.radius[k][:, None] + b.radius[k][None, :]
        if not keep.any():
            return np.zeros((xa.shape[0], xb.shape[0]), bool)
    return keep[a.node[depth - 1]][:, b.node[depth - 1]]


def tile_links(xa: np.ndarray, xb: np.ndarray, same: bool, threshold: float, ta: CoverTree | None = None, tb: CoverTree | None = None) -> np.ndarray:
    """(a x b) bool: cosine at least the threshold; of one block with itself, no vector with itself. The trees may come with the call."""
    na, nb = np.sqrt((xa * xa).sum(1)), np.sqrt((xb * xb).sum(1))
    ua, ub = xa / na[:, None], xb / nb[:, None]
    ta = ta or CoverTree(ua)
    links = dual_traversal(ta, tb or (ta if same else CoverTree(ub)), ua, ub, np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if rows.size:
        cos = (xa[rows] @ xb[cols].T) / (na[rows][:, None] * nb[cols][None, :])
        links[np.ix_(rows, cols)] &= cos >= threshold
    if same:
        np.fill_diagonal(links, False)
    return links


def forest(links: np.ndarray, ida: np.ndarray, idb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id that it reaches inside the tile) of all linked rows."""
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    sub, la, lb = links[np.ix_(rows, cols)], ida[rows].copy(), idb[cols].copy()
    while rows.size:
        na = np.minimum(la, np.where(sub, lb[None, :], np.iinfo(np.int64).max).min(1))
        nb = np.minimum(lb, np.where(sub, na[:, None], np.iinfo(np.int64).max).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return np.concatenate([ida[rows], idb[cols]]), np.concatenate([la, lb])


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row a vector."""
    rows = columns_of(embeddings, vec_id="long", embedding="array<double>", label="string")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) \
        & ~F.exists("embedding", lambda v: v.isNull()) & (square > 0) & (square < F.lit(float("inf")))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))) \
        .withColumn("dim", F.when(F.col("sound"), F.size("embedding"))).withColumn("label", F.when(F.col("sound"), F.col("label"))) \
        .withColumn("k1", F.when(F.col("sound"), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(3), "embedding")))
    key = ["label", "dim", "k1", "k2"]
    classes = materialize(rows.where("sound").groupBy(*key).agg(F.min("vec_id").alias("cid"), F.count("*").alias("w"), F.min("embedding").alias("embedding")), "ct-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n")).first()[0]
    if not top:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    spark = embeddings.sparkSession
    # pivots of labels larger than a block: one a block, from the first rows by hash of a sample that is about four times as large
    total = sizes.where(F.col("n") > BLOCK).agg(F.sum(F.ceil(F.col("n") / BLOCK)).alias("s")).first()["s"] or 0
    want = F.least(F.ceil(F.col("n") / BLOCK), F.lit(MAX_PIVOTS), F.greatest(F.floor(F.col("n") / BLOCK * F.lit(min(1.0, ALL_PIVOTS / max(int(total), 1)))), F.lit(2)))
    large = sizes.where(F.col("n") > BLOCK).withColumn("want", want)
    h = F.xxhash64("k1", "k2")
    drawn = classes.join(large, ["label", "dim"]).where(F.pmod(h, F.lit(1 << 30)) < F.col("want") * 4 / F.col("n") * (1 << 30)) \
        .withColumn("no", F.row_number().over(Window.partitionBy("label", "dim").orderBy(h, "cid")) - 1).where(F.col("no") < F.col("want"))
    unit = F.transform("embedding", lambda v: v / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))
    pivots = materialize(drawn.select("label", "dim", F.col("no").cast("long").alias("cell"), unit.alias("pivot")), "ct-pivots")
    by_label: dict[tuple, list] = {}
    for r in pivots.orderBy("label", "dim", "cell").collect():  # at most ALL_PIVOTS and two a large label
        by_label.setdefault((r["label"], r["dim"]), []).append(r["pivot"])
    send = spark.sparkContext.broadcast({k: np.asarray(v, np.float64) for k, v in by_label.items()})

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            labels, dims, emb = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()
            cell, dist, raw = np.zeros(len(emb), np.int64), np.zeros(len(emb)), [None] * len(emb)
            rows_of: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, dims)):
                rows_of.setdefault(k, []).append(i)
            for k, at in rows_of.items():
                x = np.asarray([emb[i] for i in at], np.float64)
                for i, v in zip(at, x):
                    raw[i] = v.tobytes()
                if k in send.value:
                    p = send.value[k]
                    u = x / np.sqrt((x * x).sum(1))[:, None]
                    cell[at] = (u @ p.T).argmax(1)
                    dist[at] = np.sqrt(((u - p[cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(cell), pa.array(dist), pa.array(raw, pa.binary())], ["cid", "k1", "w", "label", "dim", "cell", "dist", "vec"])

    dealt = materialize(classes.select("cid", "k1", "w", "label", "dim", "embedding")
                        .mapInArrow(deal, "cid long, k1 long, w long, label string, dim int, cell long, dist double, vec binary"), "ct-dealt")
    cells = materialize(dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("subs"), F.max("dist").alias("radius")), "ct-cells")
    blocks = cells.join(pivots, ["label", "dim", "cell"], "left").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))) \
        .withColumn("block", F.row_number().over(Window.partitionBy("label", "dim").orderBy("cell", "sub")) - 1)  # a row in BLOCK vectors
    blocks = materialize(blocks.withColumn("strip", F.floor(F.col("block") / SIDE)), "ct-blocks")
    other = blocks.select("label", "dim", F.col("strip").alias("strip2"), F.col("radius").alias("radius2"), F.col("pivot").alias("pivot2"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    gap = F.sqrt(F.aggregate(F.zip_with("pivot", "pivot2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    pairs = blocks.join(other, ["label", "dim"]).where("strip <= strip2") \
        .where((F.col("strip") == F.col("strip2")) | F.coalesce(gap <= F.col("radius") + F.col("radius2") + reach + SLACK, F.lit(True))) \
        .select("label", "dim", "strip", "strip2").distinct()
    pairs = materialize(pairs, "ct-pairs")
    placed = dealt.join(cells.select("label", "dim", "cell", "subs"), ["label", "dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("k1"), F.col("subs"))) \
        .join(blocks.select("label", "dim", "cell", "sub", "block", F.col("strip").alias("at")), ["label", "dim", "cell", "sub"]).select("label", "dim", "at", "block", "cid", "k1", "w", "vec")
    cols = ["label", "dim", "strip", "strip2", "side", "block", "cid", "k1", "w", "vec"]
    left = placed.join(pairs.withColumnRenamed("strip", "at"), ["label", "dim", "at"]).withColumn("strip", F.col("at")).withColumn("side", F.lit(0)).select(cols)
    right = placed.join(pairs.where("strip <> strip2").withColumnRenamed("strip2", "at"), ["label", "dim", "at"]) \
        .withColumn("strip2", F.col("at")).withColumn("side", F.lit(1)).select(cols)

    def tile(df: pd.DataFrame) -> pd.DataFrame:
        def side(k: int) -> list[tuple]:
            own = []
            for _, part in df[df["side"] == k].sort_values(["block", "cid", "k1"]).groupby("block", sort=True):
                x = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(len(part), -1)
                own.append((x, CoverTree(x / np.sqrt((x * x).sum(1))[:, None]), part["cid"].to_numpy(), part["k1"].to_numpy(), part["w"].to_numpy()))
            return own

        one, two = side(0), side(1)
        within = not two
        out = []
        for i, (xa, ta, ia, ka, wa) in enumerate(one):
            for j, (xb, tb, ib, kb, wb) in enumerate(one if within else two):
                if within and j < i:
                    continue
                same = within and i == j
                links = tile_links(xa, xb, same, threshold, ta, tb)
                ra, rb = links.any(1), links.any(0)
                if not ra.any():
                    continue
                ids, low = forest(links, ia, ib)
                sums = np.concatenate([links[ra] @ wb, (links[:, rb].T @ wa) * (0 if same else 1)])
                out.append(pd.DataFrame({"cid": ids, "k1": np.concatenate([ka[ra], kb[rb]]), "links": sums.astype(np.int64), "low": low}))
        found = pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("cid", "k1", "links", "low")})
        found.insert(0, "label", df["label"].iloc[0])
        found.insert(1, "dim", int(df["dim"].iloc[0]))
        return found

    found = materialize(left.unionByName(right).groupBy("label", "dim", "strip", "strip2").applyInPandas(tile, "label string, dim int, cid long, k1 long, links long, low long"), "ct-found")
    counts = found.groupBy("label", "dim", "cid", "k1").agg(F.sum("links").alias("others"))  # an id may have a row under several labels
    comp = connected_components(classes.select(F.col("cid").alias("id")).distinct(), found.select(F.col("cid").alias("a"), F.col("low").alias("b")).distinct())
    done = classes.select("label", "dim", "k1", "k2", "cid", "w").join(counts, ["label", "dim", "cid", "k1"], "left").join(comp.withColumnRenamed("id", "cid"), "cid") \
        .select("label", "dim", "k1", "k2", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "component")
    done = materialize(done, "ct-done")
    # the unsound rows need no class; the others meet theirs (one row a class, so a hot class never multiplies)
    loose = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    tied = rows.where("sound").select("vec_id", *key).join(done, key).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return tied.unionByName(loose).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
