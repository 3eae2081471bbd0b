"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching
penalty labels the spans of mixed-language text.

``fit`` counts hashed character n-grams (1 to 3, with word marks), whole words and letters by script for
every language, on a bounded sample of labelled rows (SAMPLE_PER_LANG rows a language, by hash of the id).
Counts are summed on executors; the driver gets one bounded table (languages x buckets). A word's score is
the sum of its log probabilities; languages that hardly ever use the word's script are out. Viterbi runs over
all words of a text, many texts side by side; a change of language costs PENALTY. The document's language
is the one with most letters, its score that language's share of the letters.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no spans; ties go to the
first language by code point order; texts of any length are labelled whole; equal texts give equal
results; with no labelled row every text is ``und``; an empty table gives an empty result; extra columns
are kept by ``keep`` and dropped by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, columns_of, lower_table, mix64, over_texts, real_name, small_batches, word_bounds, word_hashes

SAMPLE_PER_LANG = 4000       # labelled rows a language that training reads, about
MAX_LANGS = 200              # more are an error: the model's size is languages x buckets
GRAM_BITS = (10, 13, 15)     # hash buckets of 1-, 2- and 3-grams
WORD_BITS = 16
CHARS = 700_000              # characters labelled side by side: fewer make more and shorter rounds, more take more memory
PENALTY = 12.0               # nats that a change of language costs
RARE_SCRIPT = 0.002          # a language with a smaller share of its letters in a script is no candidate there
SMOOTH = 0.5

#: First code points of script ranges, and the script each begins. Fixed values.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
           (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
           (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
           (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"),
           (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"))
NAMES = sorted({s for _, s in SCRIPTS})
KINDS = 5  # three n-gram orders, words, scripts

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Is the code point a letter, for all code points."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


class Words:
    """The words of a chunk of texts as arrays: bounds, hashed features, letters, script."""

    def __init__(self, texts: list[str]) -> None:
        self.cp, self.off = code_points(texts)
        low = self.cp.copy()
        basic = low < 0x10000
        low[basic] = lower_table()[low[basic]]
        self.start, self.end, self.text = word_bounds(self.cp, self.off)
        run = self.end - self.start
        self.at = np.arange(int(run.sum()), dtype=np.int64) + np.repeat(self.start - (np.cumsum(run) - run), run)
        self.seg = np.cumsum(run) - run
        c = low[self.at].astype(np.uint64)
        is_letter = letters()[self.cp[self.at]] if self.at.size else np.zeros(0, bool)
        self.n_letters = np.add.reduceat(is_letter, self.seg).astype(np.int64) if run.size else np.zeros(0, np.int64)
        prev, prev2 = np.zeros_like(c), np.zeros_like(c)
        prev[1:], prev2[2:] = c[:-1], c[:-2]
        first = self.seg
        prev[first], prev2[first] = 94, 94
        second = first[run > 1] + 1
        prev2[second] = 94
        self.grams = [self._hash(c, 1), self._hash(c | prev << np.uint64(21), 2), self._hash(c | prev << np.uint64(21) | prev2 << np.uint64(42), 3)]
        self.words = (word_hashes(low, self.start, self.end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.char_script = np.zeros(0, np.int64)
        if run.size:
            of = np.searchsorted([a for a, _ in SCRIPTS], self.cp[self.at], side="right") - 1
            self.char_script = np.asarray([NAMES.index(s) for _, s in SCRIPTS])[of]
        self.is_letter = is_letter

    @staticmethod
    def _hash(key: np.ndarray, n: int) -> np.ndarray:
        return (mix64(key + np.uint64(n << 62)) >> np.uint64(64 - GRAM_BITS[n - 1])).astype(np.int64)

    def script(self) -> np.ndarray:
        """The script of each word's first letter, -1 without letters."""
        out = np.full(self.start.size, -1, np.int64)
        pos = np.flatnonzero(self.is_letter)
        word = np.searchsorted(self.seg, pos, side="right") - 1
        out[word[::-1]] = self.char_script[pos[::-1]]
        return out


SIZES = [*(1 << b for b in GRAM_BITS), 1 << WORD_BITS, len(NAMES)]


def sample(documents: DataFrame, learn: Column) -> DataFrame:
    """lang, text of at most about SAMPLE_PER_LANG rows a language, chosen by hash of the id."""
    rows = columns_of(documents, doc_id="long", lang="string", text="string").where(learn).where("lang IS NOT NULL")
    per = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()  # one row a language
    if len(per) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not per:
        return rows.select("lang", "text")
    rate = F.create_map(*[F.lit(x) for r in per for x in (r["lang"], min(1.0, SAMPLE_PER_LANG / r["count"]))])
    return rows.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_003)) < F.element_at(rate, F.col("lang")) * 1_000_003).select("lang", "text")


class Model:
    """Log probabilities: tables[k] is (buckets x languages); allowed is (scripts x languages)."""

    def __init__(self, langs: list[str], tables: list[np.ndarray], allowed: np.ndarray) -> None:
        self.langs, self.tables, self.allowed = langs, tables, allowed


def fit(documents: DataFrame, learn: Column) -> Model:
    """Learns from the rows for which ``learn`` holds and whose lang is not null."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for df in chunks(batches, "text"):
            for lang, own in df.groupby("lang"):
                w = Words([t for t in own["text"] if t])
                have = sums.setdefault(lang, [np.zeros(n, np.int64) for n in SIZES])
                for k in range(3):
                    have[k] += np.bincount(w.grams[k], minlength=SIZES[k])
                have[3] += np.bincount(w.words, minlength=SIZES[3])
                have[4] += np.bincount(w.char_script[w.is_letter], minlength=SIZES[4])
        for lang, have in sums.items():
            for k, v in enumerate(have):
                on = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * on.size), pa.array(np.full(on.size, k, np.int32)),
                                                  pa.array(on.astype(np.int32)), pa.array(v[on])], ["lang", "kind", "bucket", "n"])

    counted = sample(documents, learn).mapInArrow(count, "lang string, kind int, bucket int, n long") \
        .groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets rows
    langs = sorted(counted["lang"].unique())
    tables = [np.zeros((n, len(langs))) for n in SIZES]
    for (lang, kind), own in counted.groupby(["lang", "kind"]):
        tables[kind][own["bucket"], langs.index(lang)] = own["n"]
    allowed = np.ones((len(NAMES), len(langs)), bool)
    if langs:
        share = tables[4] / np.maximum(tables[4].sum(0), 1)
        allowed = share >= RARE_SCRIPT
        allowed[~allowed.any(1)] = True  # a script that no language uses excludes nobody
    logs = [np.log((t + SMOOTH) / (t.sum(0) + SMOOTH * t.shape[0])).astype(np.float32) for t in tables[:4]] if langs else []
    return Model(langs, logs, allowed)


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row of ``scores`` (words x languages); text k has rows starts[k] .. + counts[k]."""
    out = np.zeros(scores.shape[0], np.int16)
    by = np.argsort(-counts, kind="stable")
    by = by[counts[by] > 0]
    if not by.size:
        return out
    first, n = starts[by], counts[by]
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts that have a word t
    value = np.zeros((by.size, scores.shape[1]), scores.dtype)
    stay = np.ones(scores.shape, bool)
    come = np.zeros(scores.shape[0], np.int16)
    value[:] = scores[first]
    for t in range(1, int(n[0])):
        a = active[t]
        at, v = first[:a] + t, value[:a]
        best = v.argmax(1)
        top = v[np.arange(a), best][:, None] - penalty
        stay[at], come[at] = v >= top, best
        value[:a] = np.maximum(v, top) + scores[at]
    now = value.argmax(1)
    for t in range(int(n[0]) - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        out[at] = now[:a]
        now[:a] = np.where(stay[at, now[:a]], now[:a], come[at])
    return out


def label(model: Model, texts: list[str]) -> tuple[Words, np.ndarray]:
    """(words, language index of each word)."""
    w = Words(texts)
    if not w.start.size or not model.langs:
        return w, np.zeros(w.start.size, np.int16)
    s = np.zeros((w.start.size, len(model.langs)), np.float32)
    for k in range(3):
        s += np.add.reduceat(model.tables[k][w.grams[k]], w.seg, axis=0)
    s += model.tables[3][w.words]
    script = w.script()
    s = np.where(model.allowed[script], s, s - 1000)
    s[script < 0] = 0  # no letter, no vote
    starts = np.searchsorted(w.text, np.arange(len(texts)))
    return w, viterbi(s, starts, np.diff(np.append(starts, w.start.size)), PENALTY)


def _documents(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
    w, lab = label(model, texts)
    n = max(len(model.langs), 1)
    mass = np.bincount(w.text * n + lab, weights=w.n_letters, minlength=len(texts) * n).reshape(len(texts), n)
    total, best = mass.sum(1), mass.argmax(1)
    known = (total > 0) & bool(model.langs)
    score = np.where(known, mass.max(1) / np.maximum(total, 1), 0.0)
    return [model.langs[b] if k else "und" for b, k in zip(best, known)], score, w, lab


def predict(documents: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with ``spans`` also spans: lang:start:end in code points, comma-joined."""
    size = max(20_000, min(1_000_000, 4_000_000 // max(len(model.langs), 1)))
    names = ["doc_id", "lang_pred", "score", *["spans"] * spans]
    send = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = send.value
        for df in chunks(batches, "text", size):
            pred, score, w, lab = _documents(m, [t or "" for t in df["text"]])
            out = [pa.array(df["doc_id"], pa.int64(), from_pandas=True), pa.array(pred), pa.array(score)]
            if spans:
                out.append(pa.array(_spans(m, w, lab, len(df))))
            yield pa.RecordBatch.from_arrays(out, names)

    return columns_of(documents, doc_id="long", text="string") \
        .mapInArrow(run, "doc_id long, lang_pred string, score double" + ", spans string" * spans)


def _spans(m: Model, w: Words, lab: np.ndarray, n: int) -> list[str]:
    out: list[list[str]] = [[] for _ in range(n)]
    has = np.flatnonzero(w.n_letters > 0)
    if has.size and m.langs:
        cut = np.flatnonzero(np.concatenate(([True], (lab[has][1:] != lab[has][:-1]) | (w.text[has][1:] != w.text[has][:-1]))))
        last = np.append(cut[1:], has.size) - 1
        for a, z in zip(has[cut], has[last]):
            k = w.text[a]
            out[k].append(f"{m.langs[lab[a]]}:{w.start[a] - w.off[k]}:{w.end[z] - w.off[k]}")
    return [",".join(s) for s in out]


def keep(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that have a letter and a candidate language, in however many languages they are; ``lang`` (if there is one) becomes the
    one that holds most letters. Same columns; without a text column nothing has a letter. Only the text goes through Python."""
    text, lang = real_name(documents, "text"), real_name(documents, "lang")
    if text is None:
        return documents.limit(0)
    small_batches(documents.sparkSession)
    send = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        return lambda texts: pa.array(_documents(send.value, [t or "" for t in texts])[0], pa.string())

    judged = documents.withColumn("__lang", over_texts("string", start, CHARS)(F.col(text))).where("__lang <> 'und'")
    if lang is not None:
        judged = judged.withColumn(lang.strip("`"), F.col("__lang").cast(documents.schema[lang.strip("`")].dataType))
    return judged.drop("__lang")
