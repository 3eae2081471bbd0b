"""Gradient boosting over histograms: the learner behind ``model.estimator`` for numbers and two classes.

The algorithm is that of MLlib's GBTRegressor and GBTClassifier, whose parameters it takes and whose model it returns: cut points
from about 10 000 sampled rows (at most ``maxBins`` bins a slot), trees grown level by level by variance gain on the loss's pseudo-residuals,
each from its own ``subsamplingRate`` of all rows, each node from its own subset of the slots. What differs is the work on a row:

* rows are kept as chunks, one byte a slot, so the cached training set has about 40 bytes a row instead of some 300;
* a level aggregates only the smaller child of each split node; the other is its parent minus that one;
* a task's result is one histogram (nodes x slots x bins), never rows;
* where the cluster has a slot for every task at once and the shared checkpoint folder is a path of the file system, ``checkpointInterval`` rounds
  are one barrier job: a task holds its chunks and their nodes, the tasks leave the levels' histograms as files in that folder, and the first
  task adds them up and chooses the splits. Elsewhere a level is a job, and the driver does that.

Rows never leave the executors. The random draws are not MLlib's, so a model equals MLlib's in distribution, not split for split. Both ways of
running give the same trees, to the bit for the same number of tasks. Sums of squares are not gathered: a node's impurity is NaN in the stored model,
gains and counts are whole. Vectors of more than MOST_SLOTS slots are left to MLlib.
"""

from __future__ import annotations

import json
import math
import os
import pickle
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyspark
from pyspark import RDD, BarrierTaskContext, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, ensure_checkpoint_dir, shared_path, written

MOST_SLOTS = 512       # 4 MB of histograms a task and level at depth 6
CHUNK_ROWS = 32_768     # about 1 MB, below what the JVM's collector treats as a huge object
SAMPLED = 10_000       # rows that give the cut points, as in MLlib
HELD_BYTES = 256 << 20  # of binned rows in a barrier task's memory; the rest lies in a file of its own
HELD_ROWS = 16_000_000  # of a barrier task, whose labels and nodes (some 25 bytes a row) are always in memory
PATIENCE = 1800         # seconds that a barrier task waits for another one's file
ROOT = 1               # nodes are numbered like a heap: children of i are 2 i and 2 i + 1
CHUNK = "bins binary, label binary"
NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry the functions below: executors need numpy and Arrow, not this package


# ---------------------------------------------------------------------------------------------- bins

def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds of a slot: midpoints of neighbouring values, all of them or those nearest to equal shares."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(distinct) <= bins:
        return between
    out, stride, seen = [], len(values) / bins, counts[0]
    target = stride
    for i in range(1, len(distinct)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def binned(cuts: dict[int, np.ndarray], rows: int) -> Callable:
    """Arrow batches (label, features) -> chunks of about ``rows`` rows: a byte a row and slot, slot by slot, and the labels."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, labels, have = [], [], 0

        def chunk():
            return pa.RecordBatch.from_pydict({"bins": [np.concatenate(bins, axis=1).tobytes()], "label": [np.concatenate(labels).tobytes()]})

        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            if not (np.isfinite(y).all() and np.isfinite(x).all()):
                raise ValueError("labels and features must not be NaN or infinite")
            bins.append(np.stack([np.searchsorted(c, x[:, s]).astype(np.uint8) for s, c in cuts.items()]))
            labels.append(y)
            have += len(y)
            if have >= rows:
                yield chunk()
                bins, labels, have = [], [], 0
        if have:
            yield chunk()
    return chunks


# ---------------------------------------------------------------------------------------------- trees in a task

def routed(bins: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node that each row has reached. ``splits``: node -> (row of ``bins``, last bin of the left child)."""
    at = np.full(bins.shape[1], ROOT, np.uint8 if max(splits, default=0) < 128 else np.int64)
    for node, (slot, last) in sorted(splits.items()):  # parents first; whole-array steps, cheaper than following each row
        at += (at == node) * ((bins[slot] > last) + at.dtype.type(node))  # to 2 node or 2 node + 1
    return at


def residuals(loss: str, label: np.ndarray, pred: np.ndarray | None, first: bool) -> np.ndarray:
    """What a tree is fitted to: the label before the first tree, then the negative gradient of the loss. Of the squared loss a chunk keeps
    label minus prediction in the label's place and no prediction."""
    if first:
        return label
    return 2 * label if loss == "squared" else 4 * label / (1 + np.exp(np.clip(2 * label * pred, -700, 700)))


def unpacked(chunk: tuple) -> tuple[int, np.ndarray, np.ndarray, np.ndarray | None]:
    key, bins, label, pred = chunk
    y = np.frombuffer(label)
    return key, np.frombuffer(bins, np.uint8).reshape(-1, len(y)), y, np.frombuffer(pred) if pred else None


def pair_width(n_bins: int) -> int:
    """With few bins two slots are counted at once, by pairs of bins: the factor of the first one's bin, 1 without pairs. A power of two."""
    return 1 << (n_bins - 1).bit_length() if n_bins <= 32 else 1


def paired(bins: np.ndarray, width: int) -> np.ndarray:
    """The cells that are counted: pairs of bins, or the bins."""
    if width == 1:
        return bins
    cells = bins[::2].astype(np.uint16) * np.uint16(width)
    cells[:len(bins) // 2] += bins[1::2]
    return cells


def unpaired(cells: np.ndarray, width: int, n_slots: int) -> np.ndarray:
    if width == 1:
        return cells
    bins = np.empty((n_slots, cells.shape[1]), np.uint8)
    bins[::2], bins[1::2] = cells // width, cells[:n_slots // 2] % width
    return bins


def empty_counts(n_cells: int, wanted: int, n_bins: int) -> np.ndarray:
    """(counts, sums) by row of cells, node and cell."""
    return np.zeros((2, n_cells, wanted * n_bins * pair_width(n_bins)))


def count(total: np.ndarray, cells: np.ndarray, rows: np.ndarray, place: np.ndarray, r: np.ndarray, n_bins: int) -> None:
    """Adds a chunk's ``rows``, whose nodes have the given places and whose residuals are ``r``, to the counts."""
    at = place * (n_bins * pair_width(n_bins))
    for i, c in enumerate(cells):
        cell = at + c.take(rows)
        total[0, i] += np.bincount(cell, minlength=total.shape[2])
        total[1, i] += np.bincount(cell, r, minlength=total.shape[2])


def by_slot(total: np.ndarray, n_slots: int, wanted: int, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) by node, slot and bin: the pairs separated."""
    width = pair_width(n_bins)
    pairs = total.reshape(2, -1, wanted, n_bins, width)
    both = pairs[..., 0][:, :, None] if width == 1 else np.stack([pairs.sum(4), pairs.sum(3)[..., :n_bins]], 2)
    one = both.reshape(2, -1, wanted, n_bins)[:, :n_slots].swapaxes(1, 2)
    return one[0].astype(np.int64), one[1]


def drawn(n: int, rate: float, seed: tuple[int, ...]) -> np.ndarray | None:
    """The rows of a chunk that a tree is grown from; None for all."""
    return np.random.default_rng(seed).random(n, dtype=np.float32) < rate if rate < 1 else None


def level(loss: str, wanted: list[int], splits: dict, n_bins: int, rate: float, seed: tuple[int, int]) -> Callable:
    """Chunks -> one (counts, sums) of the wanted nodes by slot and bin over all sampled rows of the partition."""
    def histograms(chunks: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place = np.full(2 * max([ROOT, *splits, *wanted]) + 2, -1)
        place[wanted] = np.arange(len(wanted))
        total = None
        for chunk in chunks:
            key, bins, y, pred = unpacked(chunk)
            node = routed(bins, splits)
            use, some = place.take(node) >= 0, drawn(len(y), rate, (*seed, key))
            rows = np.flatnonzero(use if some is None else use & some)
            cells = paired(bins, pair_width(n_bins))
            if total is None:
                n_slots = len(bins)
                total = empty_counts(len(cells), len(wanted), n_bins)
            count(total, cells, rows, place[node[rows]], residuals(loss, y, pred, seed[1] == 0)[rows], n_bins)
        if total is not None:
            yield by_slot(total, n_slots, len(wanted), n_bins)
    return histograms


def moved(loss: str, y: np.ndarray, pred: np.ndarray | None, node: np.ndarray, values: dict[int, float], weight: float) -> tuple:
    """Label and prediction after the tree's weighted predictions, for all rows, sampled or not."""
    by_node = np.zeros(max(values) + 1)
    by_node[list(values)] = list(values.values())
    out = weight * by_node[node] + (0 if pred is None else pred)
    return (y - out, None) if loss == "squared" else (y, out)


def advanced(loss: str, splits: dict, values: dict[int, float], weight: float) -> Callable:
    """Chunk -> the chunk after the tree."""
    def step(chunk: tuple) -> tuple:
        key, bins, y, pred = unpacked(chunk)
        y, pred = moved(loss, y, pred, routed(bins, splits), values, weight)
        return key, chunk[1], y.tobytes(), None if pred is None else pred.tobytes()
    return step


# ---------------------------------------------------------------------------------------------- trees in a barrier job

class Held:
    """A chunk in a barrier task, with the node that each row has reached in the tree being grown."""

    def __init__(self, chunk: tuple, width: int, file):
        self.key, bins, self.y, self.pred = unpacked(chunk)
        self.width, self.n_slots, self.file = width, len(bins), file
        cells = paired(bins, width)
        self.shape, self.dtype, self.kept = cells.shape, cells.dtype, cells
        if file is not None:
            self.kept = file.seek(0, 2)
            file.write(cells.tobytes())

    def cells(self) -> np.ndarray:
        if self.file is None:
            return self.kept
        self.file.seek(self.kept)
        return np.frombuffer(self.file.read(math.prod(self.shape) * self.dtype.itemsize), self.dtype).reshape(self.shape)

    def begin(self, loss: str, depth: int, rate: float, seed: tuple[int, int]) -> None:
        self.at = np.full(len(self.y), ROOT, np.uint8 if depth < 8 else np.int64)
        self.use = drawn(len(self.y), rate, (*seed, self.key))
        self.r = residuals(loss, self.y, self.pred, seed[1] == 0)

    def descend(self, cells: np.ndarray, splits: dict[int, tuple[int, int]]) -> None:
        """As ``routed``, by the splits of one level."""
        for node, (slot, last) in splits.items():
            if self.width == 1:
                right = cells[slot] > last
            elif slot % 2:
                right = (cells[slot // 2] & np.uint16(self.width - 1)) > last
            else:
                right = cells[slot // 2] >= (last + 1) * self.width
            self.at += (self.at == node) * (right + self.at.dtype.type(node))

    def add(self, total: np.ndarray, cells: np.ndarray, place: np.ndarray, n_bins: int) -> None:
        use = place.take(self.at) >= 0
        rows = np.flatnonzero(use if self.use is None else use & self.use)
        count(total, cells, rows, place[self.at[rows]], self.r[rows], n_bins)

    def chunk(self) -> tuple:
        bins = unpaired(self.cells(), self.width, self.n_slots)
        return self.key, bins.tobytes(), self.y.tobytes(), None if self.pred is None else self.pred.tobytes()


class Exchange:
    """What the first task of a barrier job tells the others and what they answer, as files of a new folder in ``folder``. (Spark's own exchange
    between barrier tasks takes a second each time; it only agrees on the new folder's name, which a repeated attempt does not share.)"""

    def __init__(self, folder: str, context: BarrierTaskContext):
        self.rank, self.tasks, self.told, self.heard = context.partitionId(), len(context.getTaskInfos()), 0, 0
        name = uuid.uuid4().hex
        if self.rank == 0:
            os.makedirs(f"{folder}/{name}")
        self.folder = f"{folder}/{context.allGather(name)[0]}"

    def put(self, name: str, what) -> None:
        with open(f"{self.folder}/{name}.part", "wb") as file:
            pickle.dump(what, file, protocol=5)
        os.rename(f"{self.folder}/{name}.part", f"{self.folder}/{name}")  # whole or not there

    def get(self, name: str):
        path, until = f"{self.folder}/{name}", time.monotonic() + PATIENCE
        while not os.path.exists(path):
            if time.monotonic() > until:
                raise TimeoutError(f"no {name} from another task")
            time.sleep(0.001)
        with open(path, "rb") as file:
            return pickle.load(file)

    def tell(self, what) -> None:
        self.told += 1
        self.put(f"told-{self.told}", what)

    def hear(self):
        self.heard += 1
        return self.get(f"told-{self.heard}")

    def answer(self, what) -> None:
        self.put(f"answer-{self.heard}-{self.rank}", what)

    def answers(self) -> Iterator:
        """The other tasks' answers to what was told last, in order of the tasks. Who has answered has read all that was told before."""
        for rank in range(1, self.tasks):
            yield self.get(name := f"answer-{self.told}-{rank}")
            os.remove(f"{self.folder}/{name}")
        for step in range(self.heard + 1, self.told + 1):
            os.remove(f"{self.folder}/told-{step}")
        self.heard = self.told


def rounds(folder: str, loss: str, first: int, until: int, allowed: np.ndarray, n_slots: int, of: list[int], p: dict, held_bytes: int = HELD_BYTES) -> Callable:
    """Chunks of a barrier task -> the trees ``first`` to ``until`` - 1, the same from every task, then the chunks after them (none after the last round)."""
    def grown(chunks: Iterator[tuple]) -> Iterator[list | tuple]:
        n_bins = allowed.shape[1] + 1
        trees, held, have = [], [], 0
        with tempfile.TemporaryFile() as file:
            for c in chunks:
                have += len(c[1])
                held.append(Held(c, pair_width(n_bins), None if have <= held_bytes else file))
            others = Exchange(folder, BarrierTaskContext.get())
            for m in range(first, until):
                applied = set()
                for c in held:
                    c.begin(loss, p["depth"], p["rate"], (p["seed"], m))

                def mine(wanted: list[int], splits: dict) -> tuple[np.ndarray, np.ndarray] | None:
                    """(counts, sums) of the wanted nodes over this task's rows, after the splits not applied yet."""
                    new, total = {node: s for node, s in splits.items() if node not in applied}, None
                    applied.update(new)
                    place = np.full(2 * max([ROOT, *splits, *wanted]) + 2, -1)
                    place[wanted] = np.arange(len(wanted))
                    for c in held:
                        cells = c.cells()
                        c.descend(cells, new)
                        if wanted:
                            total = empty_counts(len(cells), len(wanted), n_bins) if total is None else total
                            c.add(total, cells, place, n_bins)
                    return None if total is None else by_slot(total, c.n_slots, len(wanted), n_bins)

                def run(wanted: list[int], splits: dict) -> tuple[np.ndarray, np.ndarray]:
                    others.tell((wanted, splits))
                    parts = [x for x in (mine(wanted, splits), *others.answers()) if x is not None]
                    return sum(c for c, _ in parts), sum(s for _, s in parts)

                if others.rank == 0:
                    tree = grow(run, allowed, n_slots, of, p, m)
                    others.tell((None, tree))
                else:
                    while (told := others.hear())[0] is not None:
                        others.answer(mine(*told))
                    tree = told[1]
                splits, _, stats = tree
                weight = 1.0 if m == 0 else p["step"]
                trees.append((*tree, weight))
                if m + 1 == p["trees"]:
                    break
                mine([], splits)
                values = {node: mean for node, (_, mean) in stats.items()}
                for c in held:
                    c.y, c.pred = moved(loss, c.y, c.pred, c.at, values, weight)
            yield trees
            if until < p["trees"]:
                for c in held:
                    yield c.chunk()
    return grown


# ---------------------------------------------------------------------------------------------- growing

def best_split(counts: np.ndarray, sums: np.ndarray, allowed: np.ndarray, least: int, min_gain: float) -> tuple[int, int, float] | None:
    """(row of bins, last bin of the left child, gain) of a node's histogram, or None. ``allowed`` marks slots and cut points that may split."""
    n, total = counts[0].sum(), sums[0].sum()
    left, below = counts.cumsum(axis=1)[:, :-1], sums.cumsum(axis=1)[:, :-1]
    ok = allowed & (left >= max(1, least)) & (n - left >= max(1, least))
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (below ** 2 / left + (total - below) ** 2 / (n - left) - total ** 2 / n) / n, -np.inf)
    slot, last = np.unravel_index(gain.argmax(), gain.shape)
    found = float(gain[slot, last])
    return (int(slot), int(last), found) if found > 1e-14 * (total / n) ** 2 and found >= min_gain else None


def summed(state: RDD, function: Callable) -> tuple[np.ndarray, np.ndarray]:
    parts = state.mapPartitions(function).collect()  # one histogram a task
    return sum(c for c, _ in parts), sum(s for _, s in parts)


def grow(run: Callable, allowed: np.ndarray, n_slots: int, of: list[int], p: dict, m: int) -> tuple[dict, dict, dict]:
    """One tree: (node -> (row of bins, bin), node -> gain, node -> (count, mean)). ``run``: (nodes, splits so far) -> (counts, sums) of the nodes
    over all rows; ``of``: the slot of each row of bins."""
    splits, gains, stats = {}, {}, {}
    counts, sums = run([ROOT], {})
    open_nodes = {ROOT: (counts[0], sums[0])}
    stats[ROOT] = int(counts[0][0].sum()), float(sums[0][0].sum())
    for depth in range(p["depth"]):
        parents, small = {}, []
        for node, (c, s) in sorted(open_nodes.items()):
            drawn = np.random.default_rng((p["seed"], m, node, 1)).choice(n_slots, math.ceil(p["share"] * n_slots), replace=False)
            found = best_split(c, s, allowed & np.isin(of, drawn)[:, None], p["least"], p["min_gain"])
            if found is None:
                continue
            slot, last, gains[node] = found
            splits[node] = slot, last
            n, total = stats[node]
            left = int(c[slot, :last + 1].sum()), float(s[slot, :last + 1].sum())
            stats[2 * node], stats[2 * node + 1] = left, (n - left[0], total - left[1])
            parents[node] = c, s
            small.append(2 * node if 2 * left[0] <= n else 2 * node + 1)
        if not small or depth + 1 == p["depth"]:
            break
        counts, sums = run(small, splits)
        open_nodes = {}
        for i, node in enumerate(small):
            c, s = parents[node >> 1]
            open_nodes[node], open_nodes[node ^ 1] = (counts[i], sums[i]), (c - counts[i], s - sums[i])
    return splits, gains, {node: (n, total / n) for node, (n, total) in stats.items()}


class Boosted:
    """``fit`` of an MLlib GBT estimator's configuration by histograms; the result is MLlib's model."""

    def __init__(self, est):
        self.est = est

    def slots_of_node(self, n_slots: int) -> float | None:
        """The share of slots that a node may use, None for a strategy that is left to MLlib."""
        strategy = self.est.getFeatureSubsetStrategy()
        if strategy in ("all", "auto"):
            return 1.0
        try:
            return min(1.0, int(strategy) / n_slots if strategy.isdigit() else float(strategy))
        except ValueError:
            return None

    def fit(self, df: DataFrame):
        est = self.est
        spark, label, classes = df.sparkSession, est.getLabelCol(), isinstance(est, GBTClassifier)
        cores = spark.sparkContext.defaultParallelism
        n = df.count()  # first: it fills a cache by all tasks
        if not n:
            raise ValueError("no training rows")
        n_slots = df.select("features").first()[0].size
        share = self.slots_of_node(n_slots)
        if n_slots > MOST_SLOTS or share is None or est.getMaxBins() > 256:
            return est.fit(df.repartition(cores))
        y = F.col(label).cast("double")
        rows = df.select((2 * y - 1 if classes else y).alias("label"), vector_to_array("features").alias("features"))
        seed, bins, most = est.getSeed() & 0xFFFFFFFF, min(est.getMaxBins(), n), max(est.getMaxBins() ** 2, SAMPLED)
        sample = np.array([r[0] for r in (rows if n <= most else rows.sample(False, most / n, seed)).select("features").collect()])
        cuts = {s: c for s, c in ((s, cut_points(sample[:, s], bins)) for s in range(n_slots)) if len(c)}
        if not cuts:  # nothing to split by
            return est.fit(df)
        table = written(rows.mapInArrow(binned(cuts, CHUNK_ROWS), CHUNK), "training-bins")
        parts = min(cores, math.ceil(n / (2 * CHUNK_ROWS)))
        trees = boost(table.rdd, parts, cuts, n_slots, {
            "loss": "logistic" if classes else "squared", "trees": est.getMaxIter(), "step": est.getStepSize(), "depth": est.getMaxDepth(),
            "least": est.getMinInstancesPerNode(), "min_gain": est.getMinInfoGain(), "rate": est.getSubsamplingRate(), "share": share,
            "seed": seed, "checkpoint": est.getCheckpointInterval()}, fits_together(spark, parts, n))
        return stored(spark, est, n_slots, cuts, trees)


def common_folder(spark: SparkSession) -> str | None:
    """The shared checkpoint folder as a path that tasks can open; None where only Hadoop's file systems reach it."""
    at = urlparse(ensure_checkpoint_dir(spark))
    scheme = at.scheme or urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    return unquote(at.path) if scheme == "file" else None


def fits_together(spark: SparkSession, parts: int, n: int) -> bool:
    """Whether a barrier job of ``parts`` tasks can hold ``n`` rows: its tasks start at once, in slots that are there and stay."""
    sc = spark.sparkContext
    scheduler = sc._jsc.sc()
    slots = scheduler.maxNumConcurrentTasks(scheduler.resourceProfileManager().defaultResourceProfile())
    fixed = sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() != "true"
    return fixed and parts <= slots and n <= parts * HELD_ROWS and common_folder(spark) is not None


def boost(chunks: RDD, parts: int, cuts: dict[int, np.ndarray], n_slots: int, p: dict, together: bool) -> list[tuple]:
    """The trees, each (splits, gains, stats, weight), from chunks dealt to ``parts`` tasks, which run ``together`` or a level at a time."""
    of, most = list(cuts), max(map(len, cuts.values()))
    allowed = np.array([np.arange(most) < len(c) for c in cuts.values()])
    numbered = chunks.zipWithIndex().map(lambda c: (c[1], (c[0]["bins"], c[0]["label"])))
    state = numbered.partitionBy(parts, lambda key: key % parts).map(lambda c: (c[0], *c[1], None))
    # a session may deal to more partitions than asked for, which need not fit at once
    return (boost_together if together and state.getNumPartitions() == parts else boost_by_level)(state, allowed, n_slots, of, p)


def boost_together(state: RDD, allowed: np.ndarray, n_slots: int, of: list[int], p: dict) -> list[tuple]:
    """``checkpoint`` rounds are a barrier job. It leaves the chunks after them, cached and in the shared checkpoint folder, so a lost executor replays
    one such job only."""
    spark = SparkSession.builder.getOrCreate()
    step = p["checkpoint"] if p["checkpoint"] > 0 else p["trees"]
    trees, saved, before, exchange = [], None, None, shared_path(spark, "boosting-exchange")
    folder = f"{common_folder(spark).rstrip('/')}/{'/'.join(exchange.split('/')[-2:])}"
    try:
        for first in range(0, p["trees"], step):
            until = min(first + step, p["trees"])
            after = state.barrier().mapPartitions(rounds(folder, p["loss"], first, until, allowed, n_slots, of, p)).persist(StorageLevel.MEMORY_AND_DISK)
            previous, before = before, after
            try:
                if until < p["trees"]:
                    after.checkpoint()
                trees += after.mapPartitions(lambda part: islice(part, 1)).collect()[0]
            finally:
                if previous is not None:
                    previous.unpersist()
            old, saved = saved, after.getCheckpointFile() or saved
            if old and old != saved:
                delete(state.ctx, old)
            state = after.mapPartitions(lambda part: islice(part, 1, None))
    finally:
        if before is not None:
            before.unpersist()
        for path in (saved, exchange):
            if path:
                delete(state.ctx, path)
    return trees


def boost_by_level(state: RDD, allowed: np.ndarray, n_slots: int, of: list[int], p: dict) -> list[tuple]:
    """A level is a job. The chunks with their predictions are the state: one cached RDD a round, made from the one
    before; every ``checkpoint`` rounds it goes to the shared checkpoint folder, so a lost executor replays a few rounds only."""
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    trees, saved, before = [], None, None
    n_bins = allowed.shape[1] + 1
    try:
        for m in range(p["trees"]):
            run = lambda nodes, splits: summed(state, level(p["loss"], nodes, splits, n_bins, p["rate"], (p["seed"], m)))  # noqa: B023, E731
            splits, gains, stats = grow(run, allowed, n_slots, of, p, m)
            if before is not None:
                before.unpersist()
                before = None
            weight = 1.0 if m == 0 else p["step"]
            trees.append((splits, gains, stats, weight))
            if m + 1 == p["trees"]:
                break
            before = state
            state = before.map(advanced(p["loss"], splits, {node: mean for node, (_, mean) in stats.items()}, weight)).persist(StorageLevel.MEMORY_AND_DISK)
            if p["checkpoint"] > 0 and (m + 1) % p["checkpoint"] == 0:
                state.checkpoint()
                state.count()
                old, saved = saved, state.getCheckpointFile()
                if old:
                    delete(state.ctx, old)
    finally:
        for rdd in (state, before):
            if rdd is not None:
                rdd.unpersist()
        if saved:
            delete(state.ctx, saved)
    return trees


# ---------------------------------------------------------------------------------------------- the model

def nodes(tree: int, splits: dict, gains: dict, stats: dict, cuts: dict[int, np.ndarray]) -> list[tuple]:
    """A tree's nodes in MLlib's stored form, numbered in pre-order."""
    of, out = list(cuts), []

    def add(node: int) -> int:
        at, (n, mean) = len(out), stats[node]
        out.append(None)
        sides, gain, split = (-1, -1), -1.0, (-1, [], -1)
        if node in splits:
            slot, last = splits[node]
            sides, gain, split = (add(2 * node), add(2 * node + 1)), gains[node], (of[slot], [float(cuts[of[slot]][last])], -1)
        out[at] = tree, (at, mean, math.nan, [float(n), n * mean, math.nan], n, gain, *sides, split)
        return at

    add(ROOT)
    return out


def stored(spark: SparkSession, est, n_slots: int, cuts: dict[int, np.ndarray], trees: list[tuple]):
    """The trees as MLlib's model: written in its stored form (at most 2 ** (depth + 1) nodes a tree) and loaded from there."""
    model = GBTClassificationModel if isinstance(est, GBTClassifier) else GBTRegressionModel
    kind = f"org.apache.spark.ml.{'classification' if model is GBTClassificationModel else 'regression'}.{model.__name__}"
    now = {"timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__}
    given = {q.name: v for q, v in est._paramMap.items()}
    default = {q.name: v for q, v in est._defaultParamMap.items()}
    path = shared_path(spark, "boosted-trees")
    whole = {"class": kind, **now, "uid": est.uid, "paramMap": given, "defaultParamMap": default, "numFeatures": n_slots, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    own = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **now, "paramMap": {}, "defaultParamMap": {}}
    spark.createDataFrame([(i, json.dumps({**own, "uid": f"{est.uid}_tree{i}"}), t[3]) for i, t in enumerate(trees)],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([n for i, t in enumerate(trees) for n in nodes(i, *t[:3], cuts)], NODES).coalesce(1).write.parquet(f"{path}/data")
    return model.load(path)
