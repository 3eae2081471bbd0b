"""Secret scan: keyword prefilter (Aho-Corasick), anchored patterns only at hits, checksum validation.

One automaton pass over the ASCII-lowered text finds every keyword; each hit is then tried with its kind's
pattern anchored at the hit. Base kinds follow the contract exactly: per kind leftmost non-overlapping
matches, also failing ones consume their text, then the length rule drops. A hex run has no keyword, so its
own maximal-run pattern is searched directly. Added kinds carry their own proof: GitHub and npm tokens end in
a base62 CRC-32 of their random part, a JSON web token's header must decode to JSON with an ``alg``, a PEM
private key block must close and decode as base64. Added spans never remove base ones.

Defined results: null and empty texts have no spans; texts of any length are read whole; equal rows give
equal results; a web token whose header is no JSON object (nested without end too) is no secret; an empty table gives an empty
result; extra columns are kept by ``mask`` and dropped by ``scan``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, over_texts, real_name, small_batches

#: Kinds in listed order; the first three are the base. Fixed values of the contract.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]+)")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]*")  # of a web token: what fails from one place of a run fails from all
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Lower-cased keyword -> kind.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
            "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
            "npm_": "npm", "eyj": "jwt", "-----begin ": "pem"}


def _crc62(body: str, check: str) -> bool:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out == check


def _jwt(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error, RecursionError):  # the last: brackets nested without end
        return False
    return isinstance(head, dict) and "alg" in head


def _pem(m: re.Match) -> bool:
    try:
        return len(base64.b64decode("".join(m[2].split()), validate=True)) > 0
    except (ValueError, binascii.Error):
        return False


#: kind -> (pattern, does a match count); a match that does not count still consumes its text.
CHECKS = {"assign": (ASSIGN, lambda m: len(m[2]) >= 8), "access": (ACCESS, lambda m: len(m[0]) >= 16),
          "github": (GITHUB, lambda m: _crc62(m[1], m[2])), "npm": (NPM, lambda m: _crc62(m[1], m[2])),
          "jwt": (JWT, _jwt), "pem": (PEM, _pem)}


class Scanner:
    """One per task: the automaton is built once."""

    def __init__(self) -> None:
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.auto.add_word(word, (len(word), kind))
        self.auto.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind index, end) in code points, end exclusive, by start, then kind."""
        if not text:
            return []
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        found: list[tuple[int, int, int]] = []
        free = dict.fromkeys(CHECKS, 0)  # where the next match of each kind may begin
        hits = sorted((end + 1 - n, kind) for end, (n, kind) in self.auto.iter(low))
        for at, kind in hits:
            if at < free[kind]:
                continue
            pattern, counts = CHECKS[kind]
            if m := pattern.match(text, at):
                free[kind] = m.end()
                if counts(m):
                    found.append((at, KINDS.index(kind), m.end()))
            elif kind == "jwt":
                free[kind] = TOKEN_RUN.match(text, at).end()
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                 ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            out = {f.name: [] for f in OUT}
            for i in range(b.num_rows):
                spans = scanner.spans(texts[i].as_py() or "")
                base = [s for s in spans if s[1] < 3]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_digest(base).encode()).hexdigest())
                out["spans"].append(_digest(spans))
            out["doc_id"] = ids
            yield pa.RecordBatch.from_arrays([out[f.name] if f.name == "doc_id" else pa.array(out[f.name], f.type) for f in OUT], schema=OUT)

    rows = columns_of(documents, doc_id="long", text="string")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, z in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
            at = z
        elif z > at:  # overlaps the span before: its tail goes too
            at = z
    return "".join([*out, text[at:]])


def mask(documents: DataFrame) -> DataFrame:
    """documents with every span replaced by ``<kind>`` and n_chars (if there) set anew; same columns and rows. Only the text goes
    through Python, and only texts with a span come back; without a text column nothing changes."""
    text, n = real_name(documents, "text"), real_name(documents, "n_chars")
    if text is None:
        return documents
    small_batches(documents.sparkSession)

    def start():
        scanner = Scanner()

        def work(texts: list) -> pa.Array:
            found = [(t, scanner.spans(t or "")) for t in texts]
            return pa.array([_mask(t, spans) if spans else None for t, spans in found], pa.string())
        return work

    masked = documents.withColumn("__masked", over_texts("string", start)(F.col(text)))
    masked = masked.withColumn(text.strip("`"), F.coalesce("__masked", F.col(text)))
    if n is not None:
        masked = masked.withColumn(n.strip("`"), F.char_length(F.col(text)).cast(documents.schema[n.strip("`")].dataType))
    return masked.drop("__masked")
