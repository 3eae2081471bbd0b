"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A normalised text (a leading U+2581, spaces turned into U+2581) falls into words, each a run of U+2581 and
what follows it; no piece of such a vocabulary crosses a word's start, so words are encoded alone and equal
words once a chunk. All words of a chunk lie in one flat symbol array. Every round finds each word's best
pair rank (a segmented minimum), merges its leftmost occurrences in all words at once, and compacts; finished
words leave. Merging several occurrences in one round equals merging them one after the other unless a pair
made on the way ranks as well as or better than the merged one; such words merge one occurrence a round.
Characters outside the vocabulary become byte pieces.

The vocabulary is read with the sentencepiece library from a path; the library neither encodes nor decodes
here. The path must exist on every executor (the file comes with an installed package).

Defined results: null is the empty text, which is the begin and end id alone and decodes to the empty text;
texts of any length are encoded whole; equal rows give equal results; an empty table gives an empty result;
extra columns are dropped (``digests``) or kept (``tokens``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, code_points, columns_of, small_batches, word_hashes

SPACE = 0x2581
NONE = np.int32(2**31 - 1)
CHUNK = 1_000_000  # characters encoded together: a worker holds some 100 bytes for each


class Vocabulary:
    """Pieces, pair table and byte pieces of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        normal = {m.id_to_piece(i): i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
        self.byte = np.full(256, self.unk, np.int32)
        surface = [b""] * n
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            if m.is_byte(i):
                b = int(m.id_to_piece(i)[3:5], 16)
                self.byte[b], surface[i], self.is_byte[i] = i, bytes([b]), True
            elif m.is_unknown(i):
                surface[i] = " ⁇ ".encode()
        for piece, i in normal.items():
            surface[i] = piece.replace("▁", " ").encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(s) for s in surface])))
        single = [(ord(p), i) for p, i in normal.items() if len(p) == 1]
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in single:
            self.char[c] = i
        scores = {i: m.get_score(i) for i in normal.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, merged, rank = [], [], []
        self.size = n
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    merged.append(i)
                    rank.append(order[scores[i]])
        # pair table: open addressing, linear probing; empty slots hold key -1
        bits = max(10, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank, self.slot_into = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        keys, merged, rank = np.asarray(keys, np.int64), np.asarray(merged, np.int32), np.asarray(rank, np.int32)
        at = self._slot(keys)
        while left.size:  # all keys step on together until each has a slot of its own
            free = self.slot_key[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(at.size)), return_index=True)
            first = first[free[first]]
            self.slot_key[at[first]], self.slot_rank[at[first]], self.slot_into[at[first]] = keys[left[first]], rank[left[first]], merged[left[first]]
            rest = np.ones(left.size, bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & self.mask
        if any(ord(c) > 0x10FFFF or self.char[ord(c)] < 0 for p in normal for c in p):
            raise ValueError("a piece holds a character that is no piece")
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("a piece crosses the start of a word")
        self.run = max((len(p) for p in normal if set(p) == {"▁"}), default=1)  # longest piece of spaces alone

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of the pairs; rank NONE if they do not merge. Negative symbols never merge."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        got = self.slot_key[at]
        on = np.flatnonzero((got != key) & (got != -1))
        while on.size:
            at[on] = (at[on] + 1) & self.mask
            got = self.slot_key[at[on]]
            on = on[(got != key[on]) & (got != -1)]
        hit = self.slot_key[at] == key
        return np.where(hit, self.slot_rank[at], NONE), self.slot_into[at]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rounds(v: Vocabulary, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts) after all merges; word i begins at starts[i]."""
    n_words = starts.size
    word = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(np.append(starts, sym.size)))
    sym = sym.astype(np.int32)
    done_sym, done_word = [], []

    def ranks(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, i + 1); none across words or beyond the end."""
        j = np.minimum(i + 1, sym.size - 1)
        r, m = v.pair(sym[i], sym[j])
        return np.where((i + 1 < sym.size) & (word[i] == word[j]), r, NONE), m

    rank, into = ranks(np.arange(sym.size))
    while sym.size:
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        count = np.diff(np.append(first, sym.size))
        best = np.minimum.reduceat(rank, first)
        live = best != NONE
        if not live.all():
            keep = np.repeat(live, count)
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
            sym, word, rank, into, best, count = sym[keep], word[keep], rank[keep], into[keep], best[live], count[live]
            if not sym.size:
                break
        cand = rank == np.repeat(best, count)
        pos = np.flatnonzero(cand)
        # overlapping occurrences (a a a): every second one of a run, from its left end
        new_run = np.concatenate(([True], np.diff(pos) != 1))
        run_start = pos[new_run][np.cumsum(new_run) - 1]
        pos = pos[(pos - run_start) % 2 == 0]
        w = word[pos]
        lead = np.concatenate(([True], w[1:] != w[:-1]))
        several = np.zeros(pos.size, bool)
        several[1:] = ~lead[1:]
        if several.any():
            made = into[pos]
            prev = np.maximum(pos - 1, 0)
            left = sym[prev]
            joined = np.concatenate(([False], (pos[1:] - pos[:-1] == 2) & ~lead[1:]))  # the left neighbour is merged too
            left = np.where(joined, np.concatenate((made[:1], made[:-1])), left)
            lr, _ = v.pair(left, made)
            lr = np.where((pos > 0) & (word[prev] == w), lr, NONE)
            nxt = np.minimum(pos + 2, sym.size - 1)
            rr, _ = v.pair(made, sym[nxt])
            rr = np.where((pos + 2 < sym.size) & (word[nxt] == w), rr, NONE)
            clash = np.minimum(lr, rr) <= rank[pos]
            if clash.any():
                bad = np.zeros(n_words, bool)
                bad[w[clash]] = True
                pos = pos[lead | ~bad[w]]
        sym[pos] = into[pos]
        gone = np.ones(sym.size, bool)
        gone[pos + 1] = False
        touched = np.zeros(sym.size, bool)
        touched[pos] = True
        touched[np.maximum(pos - 1, 0)] = True
        # the left neighbour of a merge may itself be the swallowed half of the merge before it
        swallowed = np.flatnonzero(touched & ~gone)
        touched[np.maximum(swallowed - 1, 0)] = True
        sym, word, rank, into, touched = sym[gone], word[gone], rank[gone], into[gone], touched[gone]
        at = np.flatnonzero(touched)
        rank[at], into[at] = ranks(at)
    out, of = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32), np.concatenate(done_word) if done_word else np.zeros(0, np.int32)
    by = np.argsort(of, kind="stable")
    out, of = out[by], of[by]
    return out, np.searchsorted(of, np.arange(n_words))


def _gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start .. start + len - 1 of every run, one after the other."""
    total = int(lens.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def encode_batch(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids without begin and end, offsets by text)."""
    flat, off = code_points(["▁" + t if t else "" for t in texts])
    if flat.size == 0:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    flat = np.where(flat == 32, np.uint32(SPACE), flat)
    sp = flat == SPACE
    begin = np.zeros(flat.size, bool)
    begin[off[:-1][off[:-1] < flat.size]] = True
    begin[1:] |= sp[1:] & ~sp[:-1]
    starts = np.flatnonzero(begin)
    # runs of spaces longer than the longest space piece: whole pieces are cut off in front
    ends = np.append(starts[1:], flat.size)
    run = sp[starts] & (sp[np.minimum(starts + v.run, flat.size - 1)]) & (ends - starts > v.run)
    if run.any():
        extra = []
        for s, e in zip(starts[run], ends[run]):
            other = np.flatnonzero(~sp[s:e])
            n = int(other[0]) if other.size else int(e - s)
            extra.append(s + v.run * np.arange(1, (n - 1) // v.run + 1))
        starts = np.sort(np.concatenate([starts, *extra]))
    lens = np.diff(np.append(starts, flat.size))
    _, rep, inv = np.unique(word_hashes(flat, starts, starts + lens), return_index=True, return_inverse=True)
    same = (lens[rep][inv] == lens).all() and (flat[_gather(starts[rep][inv], lens)] == flat).all()
    if not same:  # two words of one hash: no sharing in this chunk
        rep = inv = np.arange(starts.size)
    u_len = lens[rep]
    cp = flat[_gather(starts[rep], u_len)]
    sym = v.char[cp]
    sym = np.where(sym < 0, -1 - cp.astype(np.int32), sym)
    ids, at = merge_rounds(v, sym, np.cumsum(u_len) - u_len)
    if (ids < 0).any():  # byte pieces
        cp = -1 - ids
        n = np.where(ids >= 0, 1, 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))
        raw = cp[ids < 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        at, wide = np.concatenate(([0], np.cumsum(n)))[at], np.repeat(ids, n)
        wide[wide < 0] = v.byte[np.frombuffer(raw, np.uint8)]
        ids = wide
    n_ids = np.diff(np.append(at, ids.size))
    per = n_ids[inv]
    out = ids[_gather(at[inv], per)].astype(np.int32)
    upto = np.concatenate(([0], np.cumsum(per)))
    return out, upto[np.searchsorted(starts, off)]


def decode_bytes(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The UTF-8 of the decoded text: begin and end are dropped, one leading space (the added one) too;
    byte pieces that form no character become U+FFFD each."""
    ids = ids[(ids != v.bos) & (ids != v.eos)]
    if ids.size == 0:
        return b""
    at = v.surface_at[ids]
    out = v.surface[_gather(at, v.surface_at[ids + 1] - at)].tobytes()
    if not v.is_byte[ids[0]] and ids[0] != v.unk and out[:1] == b" ":
        out = out[1:]
    try:
        out.decode("utf-8")
    except UnicodeDecodeError:
        out = _decode_slow(v, ids)
    return out


def _decode_slow(v: Vocabulary, ids: np.ndarray) -> bytes:
    parts, held = [], b""

    def flush(b: bytes) -> bytes:
        done = b""
        while b:
            for n in (1, 2, 3, 4):
                try:
                    b[:n].decode("utf-8")
                    done, b = done + b[:n], b[n:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                done, b = done + "�".encode(), b[1:]
        return done

    for k, i in enumerate(ids.tolist()):
        s = v.surface[v.surface_at[i]:v.surface_at[i + 1]].tobytes()
        if v.is_byte[i]:
            held += s
            continue
        parts += [flush(held), s[1:] if k == 0 and i != v.unk and s[:1] == b" " else s]
        held = b""
    return b"".join([*parts, flush(held)])


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded with begin and end ids, decoded from those ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for df in chunks(batches, "text", CHUNK):
            ids, off = encode_batch(v, [t or "" for t in df["text"]])
            n, a, b = [], [], []
            for x, y in zip(off[:-1], off[1:]):
                own = np.concatenate(([v.bos], ids[x:y], [v.eos])).astype(np.int32)
                n.append(own.size)
                a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(decode_bytes(v, own)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(df["doc_id"], pa.int64(), from_pandas=True), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return columns_of(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (array<int>): the token table of a corpus."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for df in chunks(batches, "text", CHUNK // 4):
            ids, off = encode_batch(v, [t or "" for t in df["text"]])
            own = [np.concatenate(([v.bos], ids[x:y], [v.eos])).astype(np.int32) for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(df["doc_id"], pa.int64(), from_pandas=True), pa.array(df["source"], pa.string(), from_pandas=True),
                                              pa.array([x.size for x in own], pa.int64()), pa.array(own, pa.list_(pa.int32()))],
                                             ["doc_id", "source", "n_tokens", "ids"])

    return columns_of(documents, doc_id="long", source="string", text="string") \
        .mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>")


def texts(token_table: DataFrame, path: str) -> DataFrame:
    """doc_id, text: decoded token lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            out = [None if x is None else decode_bytes(v, np.asarray(x, np.int32)).decode("utf-8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return token_table.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
