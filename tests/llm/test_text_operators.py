"""SentencePiece, language ID, quality, secrets, SimHash: brute force and hard cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import langid, pieces, quality, secrets, simhash
from riskframe.llm.queries import piece_model

from .helpers import DOCS, documents, hard_rows, prose


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- SentencePiece

@pytest.fixture(scope="module")
def reference():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_pieces_equal_library(reference):
    rng = random.Random(3)
    texts = ["", "  a  b ", "a\tb\nc", "▁x", "\u3000q", "😀", "<s>hi</s>", "<0x41>", "a\u0000b", " " * 17, " " * 33 + "a", " " * 100, "a" + " " * 50 + "b",
             "a" * 500, "ab" * 300, "the" * 2000, "=---" * 100, "中文字符测试", "x" * 5000, "ha" * 301]
    texts += ["".join(rng.choice("ab the in er on  \t\n▁éñ中😀01_-=<>/") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    v = pieces.vocabulary(piece_model())
    ids, off = pieces.encode_batch(v, texts)
    for k, t in enumerate(texts):
        own = np.concatenate(([v.bos], ids[off[k]:off[k + 1]], [v.eos])).astype(np.int32)
        ref = reference.encode(t, add_bos=True, add_eos=True)
        assert own.tolist() == ref
        assert pieces.decode_bytes(v, own) == reference.decode(ref).encode()


def test_decode_of_broken_bytes(reference):
    v = pieces.vocabulary(piece_model())
    for ids in ([1, 243, 2], [240, 162, 300, 194], [1, 262, 162, 194, 240, 2], [300, 259, 0]):
        assert pieces.decode_bytes(v, np.asarray(ids, np.int32)) == reference.decode(ids).encode()


def test_pieces_tables(spark, reference):
    rows = hard_rows()
    got = pieces.digests(documents(spark, rows, extra=True), piece_model()).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = reference.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(reference.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = {r["doc_id"]: r["text"] for r in pieces.texts(pieces.tokens(documents(spark, rows), piece_model()), piece_model()).collect()}
    assert back[104] == dict((r[0], r[1]) for r in rows)[104] and back[100] == ""
    assert pieces.digests(empty(spark), piece_model()).count() == 0 == pieces.tokens(empty(spark), piece_model()).count()


# ---------------------------------------------------------------- language ID

def brute_viterbi(scores, penalty):
    best, back = list(scores[0]), []
    for s in scores[1:]:
        step, new = [], []
        for y in range(len(s)):
            at = max(range(len(s)), key=lambda x: best[x] - penalty * (x != y))
            step.append(at)
            new.append(best[at] - penalty * (at != y) + s[y])
        back.append(step)
        best = new
    return max(best)


def test_viterbi_is_optimal():
    rng = np.random.default_rng(5)
    counts = np.asarray([7, 0, 1, 12, 3])
    starts = np.cumsum(counts) - counts
    scores = rng.normal(size=(counts.sum(), 3)) * 4
    lab = langid.viterbi(scores, starts, counts, 3.0)
    for a, n in zip(starts, counts):
        if n:
            own = lab[a:a + n]
            value = scores[np.arange(a, a + n), own].sum() - 3.0 * (own[1:] != own[:-1]).sum()
            assert value == pytest.approx(brute_viterbi(scores[a:a + n], 3.0))


def test_language_hard_cases_and_spans(spark):
    rng = random.Random(2)
    learn = documents(spark, [(i, prose(rng, lang, 40), lang, None) for i, lang in enumerate(["en", "de", "fr"] * 30)])
    model = langid.fit(learn, F.lit(True))
    assert model.langs == ["de", "en", "fr"]
    rows = hard_rows()
    got = langid.predict(documents(spark, rows, extra=True), model, spans=True).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 and by[i]["spans"] == "" for i in (100, 101, 102, 103))
    assert all(by[i]["lang_pred"] == ("en", "de", "fr")[i % 3] for i in range(5, 24)) and by[104]["lang_pred"] == "fr"
    mixed = prose(rng, "en", 30) + " " + prose(rng, "de", 30)
    r = langid.predict(documents(spark, [(1, mixed, None, None)]), model, spans=True).first()
    parts = [p.split(":") for p in r["spans"].split(",")]
    assert [p[0] for p in parts] == ["en", "de"] and int(parts[0][1]) == 0 and int(parts[-1][2]) == len(mixed)
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.fit(empty(spark), F.lit(True))
    assert langid.predict(learn, none).select("lang_pred").distinct().collect()[0][0] == "und"
    kept = langid.keep(documents(spark, rows, extra=True), model)
    assert kept.columns == documents(spark, rows, extra=True).columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({100, 101, 102, 103})


def test_documents_in_three_languages_stay(spark):
    rng = random.Random(3)
    model = langid.fit(documents(spark, [(i, prose(rng, lang, 40), lang, None) for i, lang in enumerate(["en", "de", "fr"] * 30)]), F.lit(True))
    rows = [(1, " ".join(prose(rng, lang, n) for lang, n in (("en", 44), ("de", 35), ("fr", 30))), None, None), (2, "123 !!", "en", None)]
    score = langid.predict(documents(spark, rows), model).where("doc_id = 1").first()
    assert score["score"] < 0.5
    assert [(r["doc_id"], r["lang"]) for r in langid.keep(documents(spark, rows), model).collect()] == [(1, score["lang_pred"])]


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en"), ("γεια σου κόσμε", "el")] * 4)]
    model = langid.fit(documents(spark, rows), F.lit(True))
    got = langid.predict(documents(spark, [(1, "мама мыла раму", None, None), (2, "unseen latin", None, None), (3, "φως", None, None)]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "ru", 2: "en", 3: "el"}


def test_language_held_out_accuracy(spark):
    from riskframe.llm.queries import op8_language_id
    sf = "/root/testdata/sf0.01"
    got = op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right / n > 0.97


# ---------------------------------------------------------------- quality

def test_forward_backward_against_enumeration():
    from itertools import product
    rng = np.random.default_rng(1)
    counts = np.asarray([4, 1, 3])
    first = np.cumsum(counts) - counts
    u, trans = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, pairs = quality.forward_backward(u, trans, first)
    want_pairs = np.zeros((2, 2))
    for a, n in zip(first, counts):
        weight = {y: np.exp(sum(u[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))) for y in product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        for i in range(n):
            assert good[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
        for y, w in weight.items():
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += w / z
    assert pairs == pytest.approx(want_pairs)


def test_quality_held_out_and_hard_cases(spark):
    from riskframe.llm.queries import op7_quality_crf
    sf = "/root/testdata/sf0.1"
    got = op7_quality_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("quality") == F.col("predicted")).cast("int"))).first()
    assert n > 500 and right / n > 0.97
    rows = hard_rows()
    docs = documents(spark, rows, extra=True)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (5, None), (104, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels, F.lit(True))).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    same = [r["score"] for r in out if r["doc_id"] == 106]
    assert same[0] == same[1]
    blank = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(empty(spark), blank).count() == 0


# ---------------------------------------------------------------- secrets

BASE = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32)}


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE.values()) for m in p.finditer(text) if ok(m))


def test_secrets_equal_plain_patterns():
    rng = random.Random(4)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "APIKEY", "akia", "AKIA", "=", ":", " ", '"', "'", "abcdef12", "ABCDEFGH1234", "0123456789abcdef",
            "é", "😀", "ſecret", "\n", "İ", "ghp_", "."]
    scan = secrets.Scanner()
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [s for s in scan.spans(text) if s[1] < 3] == brute_spans(text), text


def test_secret_checksums():
    scan = secrets.Scanner()

    def token(prefix, body):
        n, out = zlib.crc32(body.encode()), ""
        for _ in range(6):
            n, d = divmod(n, 62)
            out = secrets.BASE62[d] + out
        return prefix + body + out
    body = "Ab3" * 10
    good = token("ghp_", body)
    assert [secrets.KINDS[k] for _, k, _ in scan.spans(f"x {good} y")] == ["github"]
    assert scan.spans(good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    assert [secrets.KINDS[k] for _, k, _ in scan.spans(token("npm_", body))] == ["npm"]
    assert [secrets.KINDS[k] for _, k, _ in scan.spans("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln")] == ["jwt"]
    assert scan.spans("eyJub3BlIjoxfQ.eyJzdWIiOiIxIn0.c2ln") == []
    assert [secrets.KINDS[k] for _, k, _ in scan.spans("-----BEGIN PRIVATE KEY-----\nQUJDRA==\n-----END PRIVATE KEY-----")] == ["pem"]


def test_secrets_of_hostile_texts():
    import base64
    import time

    scan = secrets.Scanner()
    nested = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    good = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    body = base64.urlsafe_b64encode(b'{"sub":1}').decode().rstrip("=")
    assert scan.spans(f"{nested}.{body}.sig") == []
    assert [s[1] for s in scan.spans(f"x {good}.{body}.sig y")] == [secrets.KINDS.index("jwt")]
    assert [s[1] for s in scan.spans("eyJ" * 50 + f" {good}.{body}.sig")] == [secrets.KINDS.index("jwt")]
    for text in ("eyJ" * 333_334, "eyJ." * 250_000, "AKIA" * 250_000, "token " + " " * 1_000_000, "-----BEGIN " * 90_000, "secret=" * 140_000):
        t = time.perf_counter()
        scan.spans(text)
        assert time.perf_counter() - t < 5, text[:8]


def test_secret_tables(spark):
    rows = [*hard_rows(), (200, "password: hunter2hunter2 and AKIA" + "A1" * 8, "en", "s0"), (201, "x token=short y", "en", "s0")]
    docs = documents(spark, rows, extra=True)
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert got[200]["n_assign"] == 1 and got[200]["n_access"] == 1 and got[201]["n_assign"] == 0
    assert got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest() and secrets.scan(docs).count() == len(rows)
    masked = secrets.mask(docs)
    text = {r["doc_id"]: r for r in masked.collect()}
    assert masked.columns == docs.columns and text[200]["text"] == "<assign> and <access>" and text[200]["n_chars"] == 21
    assert text[100]["text"] is None and text[201]["text"] == "x token=short y"
    assert secrets.scan(empty(spark)).count() == 0


# ---------------------------------------------------------------- SimHash

def test_simhash_neighbours(spark):
    rows = [r for r in hard_rows() if r[0] is not None and r[0] != 106]
    got = {r["doc_id"]: r for r in simhash.neighbours(documents(spark, rows, extra=True)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(order):
        t, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        fa, fe, fn = simhash.fingerprints([t, edited, following])
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fa.tobytes().hex() and r["edited_fingerprint"] == fe.tobytes().hex()
        if t.strip() and edited.strip():
            assert r["near_edited"] == 1 - sum(bin(int(a ^ b)).count("1") for a, b in zip(fa, fe)) / 128
    one = simhash.neighbours(documents(spark, [(1, "only one text here", None, None)])).collect()
    assert one[0]["near_next"] == 1.0 and simhash.neighbours(empty(spark)).count() == 0
    assert simhash.neighbours(documents(spark, hard_rows())).count() == len(hard_rows())


def test_simhash_votes():
    """Fingerprints against votes counted term by term and bit by bit."""
    from riskframe.llm.common import mix64

    def one(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        if not w:
            return "0" * 32
        cp = np.frombuffer("".join(w).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(x) for x in w])
        h = simhash.word_hashes(cp, np.concatenate(([0], end[:-1])), end)
        votes = [0] * 128
        for k in range(max(1, len(w) - 2)):
            term, weight = h[k:k + 1].copy(), len(w[k])
            for j in range(1, 3):
                if k + j < len(w):
                    with np.errstate(over="ignore"):
                        term = mix64(term * np.uint64(0x9E3779B97F4A7C15) + h[k + j:k + j + 1])
                    weight += len(w[k + j])
            raw = mix64(term).tobytes() + mix64(term ^ np.uint64(0xC2B2AE3D27D4EB4F)).tobytes()
            for i in range(128):
                votes[i] += weight if raw[i // 8] >> (7 - i % 8) & 1 else -weight
        return bytes(sum((votes[8 * i + b] > 0) << (7 - b) for b in range(8)) for i in range(16)).hex()

    texts = [t or "" for _, t, *_ in hard_rows()] + ["a", "a b", "a b c", "x y z x y z", "é ü 😀 word"]
    texts = [t if len(t) < 5000 else t[:5000] for t in texts]
    assert [f.tobytes().hex() for f in simhash.fingerprints(texts)] == [one(t) for t in texts]


def test_simhash_query_documents_against_all(spark):
    rng = random.Random(3)
    base = [prose(rng, "en", 300) for _ in range(6)]
    rows = []
    for i in range(0, 1200, 10):
        words = base[i % 6].split()
        if rng.random() < 0.6:
            words[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(2000, "", "en", "s"), (2100, None, "en", "s"), (None, base[0], "en", "s"), (2200, base[1], "en", "s"), (2200, base[1], "en", "s")]
    got = simhash.searched(simhash.neighbours(documents(spark, rows, extra=True))).collect()
    assert len(got) == len(rows)
    fps = [int(r["fingerprint"], 16) for r in got]
    for k, r in enumerate(got):
        asked = r["doc_id"] is not None and r["doc_id"] % 100 == 0
        want = sum(1 for j, f in enumerate(fps) if j != k and f and fps[k] and bin(f ^ fps[k]).count("1") <= 3) if asked else None
        assert r["n_within"] == want, r["doc_id"]
    assert sum(r["n_within"] or 0 for r in got) > 20
    assert simhash.searched(simhash.neighbours(empty(spark))).count() == 0


def test_simhash_search_is_exhaustive(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(20)]
    fps = {f"{b:032x}" for b in base}
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(128), rng.randint(1, 6)):
                x ^= 1 << bit
            fps.add(f"{x:032x}")
    table = spark.createDataFrame([(f,) for f in fps] + [(None,)], "fingerprint string")
    queries = [f"{b:032x}" for b in base[:8]]
    got = {(r["query"], r["fingerprint"], r["distance"]) for r in simhash.within(table.where(F.col("fingerprint").isin(queries)), table, radius=3).collect()}
    want = {(q, f, d) for q in queries for f in fps if (d := bin(int(q, 16) ^ int(f, 16)).count("1")) <= 3}
    assert got == want
