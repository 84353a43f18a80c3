"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

Distinct pieces of a batch become rows (piece, position, token). The recursive query joins neighbours with the merge
table, contracts each piece's leftmost pair of least rank, and repeats until no piece has a pair left. Ids go back to
text by an ordered aggregation over (document, position, id) joined with the vocabulary.

The query takes strings of about SEGMENT bytes; a longer piece goes through it in segments, two neighbours of which are
then joined by encoding some tokens on either side of the seam again. That is exact: tokens are the encoding of their
string if and only if each two neighbours are the encoding of theirs. (Steps between two token bounds that stay are those
of that part alone, so parts of an encoding are encodings. Conversely, the first step over a bound between two tokens
would be the least of these two as well, and so be in the encoding of both.) A seam is closed if the new tokens begin and
end with the ones that were there, so that all neighbours have met; else more tokens are taken in.

Defined results: a null or empty text gives no tokens; a very long one is split into pieces as a whole and encoded and
decoded in parts; rows are treated one by one, so repeats and ties stay; a null doc_id is kept; other columns are ignored;
an id that the vocabulary doesn't have raises when decoded; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, mapped_texts, only, texts
from .pieces import Memo, slices

SEGMENT = 128
#: Tokens on either side of a seam that are encoded again at first.
SEAM = 4
#: Bytes of pieces, and ids, that one query takes; DuckDB stays below MEMORY with them and never spills.
CHUNK_BYTES, CHUNK_IDS, MEMORY = 1 << 17, 1 << 17, "160MB"

ENCODE = """
WITH RECURSIVE state AS (
    SELECT piece, pos, tok, false AS done FROM seed
    UNION ALL
    (
        WITH pairs AS MATERIALIZED (
            SELECT piece, pos, tok,
                   lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS next_tok,
                   lead(pos) OVER (PARTITION BY piece ORDER BY pos) AS next_pos
            FROM state WHERE NOT done
        ), ranked AS (
            SELECT p.piece, p.next_pos, m.merged::BIGINT * 4294967296 + p.pos AS rank_pos
            FROM pairs p JOIN merges m ON m.pair = p.tok::BIGINT * 4294967296 + p.next_tok
        ), best AS (
            SELECT piece, min(rank_pos) AS rank_pos, arg_min(next_pos, rank_pos) AS gone FROM ranked GROUP BY piece
        )
        SELECT p.piece, p.pos,
               CASE WHEN p.pos = b.rank_pos % 4294967296 THEN (b.rank_pos // 4294967296)::INT ELSE p.tok END AS tok,
               b.piece IS NULL AS done
        FROM pairs p LEFT JOIN best b ON b.piece = p.piece
        WHERE b.piece IS NULL OR p.pos <> b.gone
    )
)
SELECT piece, list(tok ORDER BY pos) AS ids FROM state WHERE done GROUP BY piece ORDER BY piece
"""
DECODE = """
SELECT t.doc, string_agg(v.chars, '' ORDER BY t.pos) AS chars, count(*) - count(v.id) AS unknown
FROM tokens t LEFT JOIN vocabulary v ON v.id = t.id GROUP BY t.doc
"""
_CODERS: dict[str, "Coder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, merged) of every two tokens that make a third."""
    out = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out.append((left, right, rank))
    return out


class Coder:
    """A vocabulary with its tables in DuckDB."""

    def __init__(self, path: str, pattern: str | None = None):
        import duckdb
        import public_tokenizers

        self.ranks = read_ranks(path)
        found = np.array(merge_rows(self.ranks), np.int64).reshape(-1, 3)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes_of = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        merges = pa.table({"pair": (found[:, 0] << 32) + found[:, 1], "merged": found[:, 2]})
        # A byte is the character of its number here, so that strings can carry any bytes.
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "chars": [t.decode("latin-1") for t in self.ranks]})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.memo = Memo(pattern or public_tokenizers.PATTERN, self.pieces)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[bytes | None] = [None if (rank := self.ranks.get(x)) is None else rank.to_bytes(4, "little") for x in raw]
        todo = [i for i, ids in enumerate(out) if ids is None]
        segments = [[raw[i][a : a + SEGMENT] for a in range(0, len(raw[i]), SEGMENT)] for i in todo]
        encoded = iter(self.in_chunks([x for xs in segments for x in xs]))
        parts = [[next(encoded) for _ in xs] for xs in segments]
        while seams := [(xs, i) for xs in parts for i in range(0, len(xs) - 1, 2)]:
            joined = iter(self.joined([(xs[i], xs[i + 1]) for xs, i in seams]))
            for xs in parts:
                xs[:] = [next(joined) if i + 1 < len(xs) else xs[i] for i in range(0, len(xs), 2)]
        for i, xs in zip(todo, parts, strict=True):
            out[i] = xs[0]
        return out

    def joined(self, pairs: list[tuple[bytes, bytes]]) -> list[bytes]:
        """The encodings of two strings on end, from those of each."""
        # left is an encoding, and so is right; the tokens from `a` of left to `b` of right are encoded again.
        work = [[np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), SEAM, SEAM] for x, y in pairs]
        open_ = list(range(len(work)))
        while open_:
            windows = [(np.concatenate([left[-a:], right[:b]])) for left, right, a, b in (work[k] for k in open_)]
            found = self.in_chunks([b"".join(map(self.tokens.__getitem__, w.tolist())) for w in windows])
            still = []
            for k, window, ids in zip(open_, windows, found, strict=True):
                (left, right, a, b), new = work[k], np.frombuffer(ids, "<u4")
                if a < len(left) and new[0] != window[0]:
                    work[k][2] = 2 * a
                    still.append(k)
                    continue
                ends = b >= len(right) or new[-1] == window[-1]
                # What is on the left is the encoding of its string in any case, and grows by the window.
                work[k] = [np.concatenate([left[:-a], new]), right[b:], SEAM, 2 * b]
                if not ends:
                    still.append(k)
            open_ = still
        return [np.concatenate(w[:2]).tobytes() for w in work]

    def in_chunks(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices(pieces, CHUNK_BYTES):
            out += self.by_query(pieces[a:b])
        return out

    def by_query(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        chars = np.frombuffer(b"".join(pieces), np.uint8)
        seed = pa.table({"piece": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "pos": (np.arange(len(chars)) - np.repeat(starts, lengths)).astype(np.int32), "tok": self.bytes_of[chars]})
        self.db.register("seed", seed)
        ids = self.db.sql(ENCODE).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("seed")
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, batch: list[str]) -> list[bytes]:
        return self.memo.encode(batch)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        flat, doc = np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        out: list[list[bytes]] = [[] for _ in ids]
        for start in range(0, len(flat), CHUNK_IDS):
            end = min(start + CHUNK_IDS, len(flat))
            self.db.register("tokens", pa.table({"doc": doc[start:end], "pos": np.arange(end - start, dtype=np.int32), "id": flat[start:end]}))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for i, chars, unknown in zip(*(found[c].to_pylist() for c in ("doc", "chars", "unknown")), strict=True):
                if unknown:
                    raise ValueError(f"{unknown} ids are not in the vocabulary")
                out[i].append(chars.encode("latin-1"))
        return [b"".join(x) for x in out]


def coder(path: str | None = None) -> Coder:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    only("op2", _CODERS.clear)
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode_ids(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of the text."""

    def rows(batch: pa.RecordBatch) -> dict:
        strings, ids = texts(batch.column(1)), []
        for a, b in slices(strings):
            ids += [np.frombuffer(x, "<u4").astype(np.int32) for x in coder(ranks).encode(strings[a:b])]
        return {"doc_id": batch.column(0), "ids": ids}

    return mapped(docs.select(id_col, text_col), rows, "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and the text that (doc_id, ids) stand for; bytes that aren't UTF-8 become U+FFFD."""

    def rows(batch: pa.RecordBatch) -> dict:
        raw = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "text": [x.decode("utf-8", "replace") for x in coder(ranks).decode(raw)]}

    return mapped(ids.select("doc_id", "ids"), rows, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to."""

    def rows(batch: pa.RecordBatch) -> dict:
        strings, out = texts(batch.column(1)), {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for a, b in slices(strings):
            ids = coder(ranks).encode(strings[a:b])
            out["n_tokens"] += [len(x) // 4 for x in ids]
            out["ids_sha256"] += [hashlib.sha256(x).hexdigest() for x in ids]
            out["decoded_sha256"] += [hashlib.sha256(x).hexdigest() for x in coder(ranks).decode(ids)]
        return out | {"doc_id": batch.column(0)}

    return mapped(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, and the digest of the bytes that they decode to."""

    def rows(batch: pa.RecordBatch) -> dict:
        ids = coder(ranks).encode(texts(batch.column(1)))
        decoded = coder(ranks).decode(ids)
        return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded]}

    return mapped_texts(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
