"""Token ids in word-aligned binary files.

Texts are range-partitioned by doc_id, tokenised, and packed in ascending order into blocks of about BLOCK_IDS ids. A
file is a Parquet container with one row per block: its number, the documents in it with their lengths, the Simple-8b
words, the first word of every mini-block and the escapes. Starts need one narrow pass over block lengths only.

Defined results: a null or empty text gives the end id alone; rows with equal doc_id follow each other in the order of
their texts; null doc_ids come first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import BATCH_ROWS, arrow_schema, as_batch, new_path, texts
from .pieces import MEMO_PIECES, slices

BLOCK_IDS = 1 << 18
END_ID = 2
SCHEMA = "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, words binary, offsets binary, escapes binary"
# The byte-level split for plain Latin texts, letters and numbers up to U+024F spelt out. Nothing follows a run in its part,
# so runs needn't be given back (++).
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?(?:[{_L}]++|[{_N}]++|[^\s{_L}{_N}]++)|\s+(?!\S)|\s+").findall
ODD = re.compile(r"[^\t\n\x20-\x7e\xa1-ɏ]").search
_MEMO: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Known(dict):
    """Ids of pieces as the library's model gives them; those that were asked for since the last turn() but one are held."""

    def __init__(self, model):
        # Byte-level models see a byte as a printable character: its own where it has one, else the next from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.chars = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.tokenize, self.before = model.tokenize, {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.before.get(piece)) is None:
            # Most pieces are a space and ASCII letters, of which only the space has another character.
            plain = piece[0] == " " and piece.isascii() and piece[1:].isalnum()
            shown = self.chars[32] + piece[1:] if plain else piece.encode().decode("latin-1").translate(self.chars)
            found = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        self[piece] = found
        return found

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


def encoder(path: str | None):
    """Texts to ids as bytes.

    Plain Latin texts are split into pieces here, and the library's model gets each distinct piece once. Others, in which
    classes of letters or spaces could differ between libraries, go to the library whole, as do those that hold an added
    token's content and all with a tokenizer of another kind.
    """
    path = path or default_tokenizer()
    if path not in _MEMO:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        parts = json.loads(tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        bytewise = (parts["model"]["type"], parts["normalizer"], split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("BPE", None, "ByteLevel", True, False)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _MEMO[path] = tokenizer, Known(tokenizer.model) if bytewise else None, added
    tokenizer, known, added = _MEMO[path]

    def encode(batch: list[str]) -> list[bytes]:
        if known is not None and len(known) > MEMO_PIECES // 2:
            known.turn()
        out = []
        for text in batch:
            if known is None or ODD(text) or any(x in text for x in added):
                out.append(array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(known.__getitem__, PIECES(text))))
        return out

    return encode


def pack(part: int, block: int, doc_ids: list, ids: list[bytes]) -> dict:
    values = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
    words, offsets, escapes = simple8b.encode(values)
    return {"part": [part], "block": [block], "n_ids": [len(values)], "doc_ids": [doc_ids], "lengths": [[len(x) // 4 for x in ids]], "words": [words.astype("<u8").tobytes()], "offsets": [offsets.astype("<i8").tobytes()], "escapes": [escapes.astype("<u8").tobytes()]}


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of (doc_id, text) under path."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema, end = arrow_schema(spark, SCHEMA), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block, held, doc_ids, ids = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            keys, strings = batch.column(0).to_pylist(), texts(batch.column(1))
            for a, b in slices(strings):
                for key, found in zip(keys[a:b], encode(strings[a:b]), strict=True):
                    doc_ids.append(key)
                    ids.append(found + end)
                    held += len(found) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield as_batch(pack(part, block, doc_ids, ids), schema)
                        block, held, doc_ids, ids = block + 1, 0, [], []
        if ids:
            yield as_batch(pack(part, block, doc_ids, ids), schema)

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def unpack(row: dict) -> Iterator[tuple]:
    """doc_id, ids of a block's rows before, ids."""
    values = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["escapes"], "<u8"), row["n_ids"]).astype("<u4")
    at = 0
    for key, n in zip(row["doc_ids"], row["lengths"], strict=True):
        yield key, at, values[at : at + n]
        at += n


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under path: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)
    out = "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(spark, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One block at a time: a batch may hold as many as a split of the files has.
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                found = [(key, at, len(v), zlib.crc32(v.tobytes())) for key, at, v in unpack(row)]
                columns = dict(zip(("doc_id", "before", "n_tokens", "ids_crc32"), map(list, zip(*found, strict=True)), strict=True))
                yield as_batch(columns | {k: [row[k]] * len(found) for k in ("part", "block")}, schema)

    lengths = files.select("part", "block", "n_ids")
    # One row per partition and then per block: the sums never see a document.
    parts = lengths.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_start", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    within = lengths.withColumn("block_start", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids"))
    starts = within.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("first"))
    return files.mapInArrow(run, out).join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes the files, then reads them back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
