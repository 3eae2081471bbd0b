"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features describe its characters, words and repetitions, and the same of the lines before and
after it. ``fit`` learns emission and transition weights by gradient ascent of the conditional likelihood;
the lines of a labelled document carry its label. It reads a bounded sample of labelled rows (TRAIN_DOCS, by
hash of the id; TRAIN_LINES lines), featurised on executors. ``score`` runs forward-backward over all lines of every
text; the document's quality is the mean of the good marginals, weighted by line length.

Defined results: null and empty texts are one empty line and are scored as such; a document may be one
line or millions; ties cannot occur (a score is a number); equal texts score equally; without labelled
rows every score is 0.5; several labels of one id count as the lowest; an empty table gives an empty
result; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, columns_of, mix64, word_bounds, word_hashes

TRAIN_DOCS, TRAIN_LINES = 3000, 300_000
DOC_LINES = 1000   # longer documents are scored, but not learned from
OWN = 15           # features of a line itself
STEPS, RATE, L2 = 200, 0.1, 1e-3
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Code point class: 0 space, 1 lower letter, 2 upper letter, 3 digit, 4 other."""
    global _CLASS
    if _CLASS is None:
        t = np.full(0x10001, 4, np.uint8)
        for c in range(0x10000):
            x = chr(c)
            t[c] = 0 if x.isspace() else 2 if x.isupper() else 1 if x.isalpha() else 3 if x.isdigit() else 4
        _CLASS = t
    return _CLASS


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of the lines with their neighbours, line lengths, first line of each text)."""
    cp, off = code_points([t + "\n" for t in texts])
    ends = np.flatnonzero(cp == 10) + 1
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.searchsorted(off, starts, side="right") - 1
    cls = _classes()[np.minimum(cp, 0x10000)]
    total = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64).astype(np.float64)
    n = (ends - starts - 1).astype(np.float64)
    upper, digit, other = total(cls == 2), total(cls == 3), total(cls == 4)
    letter = total(cls == 1) + upper
    foreign = total((cls == 4) & (cp > 127))
    ws, we, _ = word_bounds(cp, off)
    line = np.searchsorted(starts, ws, side="right") - 1
    per = lambda weights=None: np.bincount(line, weights=weights, minlength=starts.size).astype(np.float64)
    words = per()
    h = word_hashes(cp, ws, we)
    same = np.zeros(ws.size, bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    key = mix64(h ^ mix64(line.astype(np.uint64) + np.uint64(1)))
    distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=starts.size).astype(np.float64)
    tail = (cls[we - 1] == 4) & (cls[np.maximum(we - 2, ws)] == 4) & (we - ws > 1) if ws.size else np.zeros(0, bool)
    # words that are symbols alone: no letter or digit between their bounds
    inside = np.concatenate(([0], np.cumsum((cls != 4) & (cls != 0))))
    bare = inside[we] == inside[ws]
    long = (we - ws) > 20
    w1, n1 = np.maximum(words, 1), np.maximum(n, 1)
    line_key = mix64(np.bincount(line, weights=(h >> np.uint64(20)).astype(np.float64), minlength=starts.size).view(np.uint64)
                     ^ mix64(doc.astype(np.uint64) + np.uint64(7)))
    _, inv, times = np.unique(line_key, return_inverse=True, return_counts=True)
    again = (times[inv] > 1) & (words > 3)
    x = np.stack([np.log1p(n) / 5, np.log1p(words) / 3, (letter + digit + other) / w1 / 10, upper / np.maximum(letter, 1), digit / n1, other / n1,
                  foreign / n1, per(same) / w1, 1 - distinct / w1, per(bare) / w1, per(tail) / w1, again.astype(float), (words == 0).astype(float),
                  per(long) / w1, letter / n1], axis=1).astype(np.float32)
    first = np.searchsorted(starts, off[:-1])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    edge = np.append(first[1:], starts.size) - 1
    before[first], after[edge] = 0, 0
    head, foot = np.zeros((starts.size, 1), np.float32), np.zeros((starts.size, 1), np.float32)
    head[first], foot[edge] = 1, 1
    return np.concatenate([x, before, after, head, foot, np.ones((starts.size, 1), np.float32)], axis=1), n, first


def forward_backward(u: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of good for every line, expected transitions). u: good minus bad emission; trans: 2 x 2."""
    n_lines = np.diff(np.append(first, u.size))
    by = np.argsort(-n_lines, kind="stable")
    start, n = first[by], n_lines[by]
    if not u.size:
        return u, np.zeros((2, 2))
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")
    emit = np.stack([np.zeros_like(u), u], axis=1)
    alpha, beta = np.zeros((u.size, 2)), np.zeros((u.size, 2))
    alpha[start] = emit[start]
    for t in range(1, int(n[0])):
        at = start[:active[t]] + t
        a = alpha[at - 1]
        alpha[at] = np.stack([np.logaddexp(a[:, 0] + trans[0, y], a[:, 1] + trans[1, y]) for y in (0, 1)], axis=1) + emit[at]
    for t in range(int(n[0]) - 2, -1, -1):
        at = start[:active[t + 1]] + t
        b = beta[at + 1] + emit[at + 1]
        beta[at] = np.stack([np.logaddexp(b[:, 0] + trans[y, 0], b[:, 1] + trans[y, 1]) for y in (0, 1)], axis=1)
    g = alpha + beta
    good = 1 / (1 + np.exp(np.clip(g[:, 0] - g[:, 1], -500, 500)))
    inner = np.ones(u.size, bool)
    inner[np.append(first[1:], u.size) - 1] = False
    i = np.flatnonzero(inner)
    pair = alpha[i][:, :, None] + trans[None] + (emit[i + 1] + beta[i + 1])[:, None, :]
    pair = np.exp(pair - np.logaddexp(g[i, 0], g[i, 1])[:, None, None])
    return good, pair.sum(0)


class Model:
    def __init__(self, w: np.ndarray, trans: np.ndarray) -> None:
        self.w, self.trans = w, trans


def train(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> Model:
    """x: line features, y: line labels 0/1, first: first line of each document. Adam on the mean likelihood;
    a document counts once, however many lines it has."""
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not y.size:
        return model
    n_lines = np.diff(np.append(first, y.size))
    per_line = np.repeat(1 / n_lines, n_lines) / first.size
    inner = np.ones(y.size, bool)
    inner[np.append(first[1:], y.size) - 1] = False
    i = np.flatnonzero(inner)
    seen = np.bincount(y[i] * 2 + y[i + 1], minlength=4).reshape(2, 2).astype(float)
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, trans = params[:-4], params[-4:].reshape(2, 2)
        good, expected = forward_backward(x @ w, trans, first)
        g = np.concatenate([x.T @ ((y - good) * per_line) * 10, ((seen - expected) / max(i.size, 1)).ravel()]) - L2 * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(params[:-4], params[-4:].reshape(2, 2))


def fit(documents: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Learns from labelled documents for which ``learn`` holds."""
    marks = columns_of(labels, doc_id="long", quality="int").where(learn).where("quality IS NOT NULL AND doc_id IS NOT NULL") \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marks.count()
    rate = min(1.0, TRAIN_DOCS / n) if n else 1.0
    marks = marks.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_003)) < rate * 1_000_003)
    rows = columns_of(documents, doc_id="long", text="string").join(F.broadcast(marks), "doc_id")  # TRAIN_DOCS rows, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in chunks(batches, "text", 1_000_000):
            x, _, first = line_features([t or "" for t in df["text"]])
            cut = np.split(x, first[1:])
            yield pa.RecordBatch.from_arrays([pa.array(df["doc_id"], pa.int64()), pa.array(df["quality"].astype("int32")),
                                              pa.array([c.astype(np.float16).tobytes() for c in cut], pa.binary())], ["doc_id", "quality", "x"])

    got = rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary") \
        .where(F.length("x") <= DOC_LINES * 2 * (3 * OWN + 3)).collect()  # bounded: TRAIN_DOCS x DOC_LINES lines
    xs, ys, first, at = [], [], [], 0
    for r in sorted(got, key=lambda r: (zlib.crc32(f"7:{r['doc_id']}".encode()), r["doc_id"], r["x"])):  # which lines fit the bound depends on no order of ids
        x = np.frombuffer(r["x"], np.float16).reshape(-1, 3 * OWN + 3).astype(np.float32)
        if at + x.shape[0] > TRAIN_LINES:
            break
        xs.append(x)
        ys.append(np.full(x.shape[0], min(max(r["quality"], 0), 1)))
        first.append(at)
        at += x.shape[0]
    if not xs:
        return train(np.zeros((0, 3 * OWN + 3)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return train(np.concatenate(xs), np.concatenate(ys), np.asarray(first))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    x, n, first = line_features(texts)
    good, _ = forward_backward((x * model.w).sum(axis=1), model.trans, first)  # row by row: a line's sum is the same wherever it stands
    weight = np.maximum(n, 1e-3)  # an empty line weighs next to nothing, and decides only alone
    return np.round(np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0.0, 1.0), 10)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(df["doc_id"], pa.int64(), from_pandas=True), pa.array(score_texts(model, [t or "" for t in df["text"]]))],
                                             ["doc_id", "score"])

    return columns_of(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
