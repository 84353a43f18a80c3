"""Secret scan: Aho-Corasick keywords first, anchored expressions only near their hits, embedded checksums last.

An automaton over the ASCII-lower-cased text finds keywords in one pass. At a hit, an expression anchored there decides.
Runs of hex digits have no keyword: every sixth character is probed instead, as a run of 24 holds four such in a row,
and the run around a probe's hit is measured. Kinds with an embedded checksum (CRC-32 in base 62, Base58Check) count
only if it holds.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows give repeated results; a null
doc_id is kept; other columns are ignored; an empty table gives an empty result. Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, texts

# The expressions and least lengths that the base kinds are defined by.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Public token formats whose last six characters are a CRC-32 in base 62 of the thirty before.
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
# Fixed value: an extended private key in Base58Check, 111 characters.
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
STEP = 6
PROBE = re.compile(f"[0-9a-f]{{{LEAST['hex'] // STEP},}}")
_FOUND: list = []


def _automaton() -> ahocorasick.Automaton:
    if not _FOUND:
        made = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                made.add_word(word, (kind, len(word)))
        made.make_automaton()
        _FOUND.append(made)
    return _FOUND[0]


def base62(number: int, width: int = 6) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out


def crc_holds(match: re.Match) -> bool:
    return base62(zlib.crc32(match[1].encode())) == match[2]


def base58check_holds(match: re.Match) -> bool:
    number = 0
    for c in match[0]:
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes(82, "big") if number.bit_length() <= 656 else b""
    return raw != b"" and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: kind -> expression, and whether a match counts.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= LEAST["assign"]),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST["access"]),
    "github": (GITHUB, crc_holds),
    "npm": (NPM, crc_holds),
    "xprv": (XPRV, base58check_holds),
}


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of at least 24 hex digits."""
    over = 0
    for probe in PROBE.finditer(text[::STEP]):
        at = probe.start() * STEP
        if at < over:  # a longer run before has covered it
            at = over
        stop = (probe.end() - 1) * STEP + 1
        while at < stop:
            found = HEX.search(text, at, len(text))
            if not found or found.start() >= stop:
                break
            start = found.start()
            while start and text[start - 1] in "0123456789abcdef":
                start -= 1
            if found.end() - start >= LEAST["hex"]:
                yield start, found.end()
            at = over = found.end()


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, by start, then by the order of KINDS."""
    out, taken = [], {}
    # Only A to Z are lowered, so that positions stay.
    lowered = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((last - length + 1, kind) for last, (kind, length) in _automaton().iter(lowered))
    for start, kind in hits:
        if start < taken.get(kind, 0):
            continue
        rule, counts = RULES[kind]
        if match := rule.match(text, start):
            taken[kind] = match.end()
            if counts(match):
                out.append((kind, start, match.end()))
    out += [("hex", a, b) for a, b in hex_runs(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, all spans."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [spans(t) for t in texts(batch.column(1))]
        base = [[x for x in f if x[0] in LEAST] for f in found]
        out = {f"n_{kind}": [sum(x[0] == kind for x in f) for f in base] for kind in LEAST}
        return out | {"doc_id": batch.column(0), "base_sha256": [hashlib.sha256(joined(f).encode()).hexdigest() for f in base], "spans": [joined(f) for f in found]}

    return mapped(docs.select(id_col, text_col), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
