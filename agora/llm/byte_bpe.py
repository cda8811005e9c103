"""Byte-level BPE encoding with character offsets, and decoding through the byte table."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import map_rows, text_or_empty


class ByteTable:
    """Bytes and decimal forms of a rank file's ids."""

    def __init__(self, path: str):
        ranks = bpe.read_ranks(path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i).encode() for i in range(len(self.tokens))]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The ids' bytes; characters whose bytes lie in several ids come together again."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: np.ndarray, utf8: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """First and past-the-last character of each id, and how many ids begin inside a character.

        An id that holds only part of a character's bytes spans that whole character.
        """
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        first = (np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80
        char = np.cumsum(first, dtype=np.int64) - 1
        if not len(ids):
            return starts, ends, 0
        return char[starts], char[ends - 1] + 1, int(len(ids) - np.count_nonzero(first[starts]))


_TABLES: dict[str, ByteTable] = {}


def byte_table(path: str) -> ByteTable:
    if path not in _TABLES:
        _TABLES[path] = ByteTable(path)
    return _TABLES[path]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, text) to (doc_id, ids, starts, ends): ids with their character offsets.

    Null texts are empty and give empty arrays; rows that repeat are each encoded; an empty table
    gives no rows; other columns are ignored, whatever their names.  Nothing is shuffled.
    """

    def make():
        encoder, known = bpe.ranked(ranks), byte_table(ranks)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column("text").to_pylist():
                ids = encoder.ids(text)
                out.append((ids.astype(np.int32), *known.offsets(ids, text.encode())[:2]))
            kinds = (pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], pa.list_(kind)) for k, kind in enumerate(kinds))], ["doc_id", "ids", "starts", "ends"])

        return step

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text): the byte table in reverse; bytes that are no UTF-8 become U+FFFD."""

    def make():
        known = byte_table(ranks)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [known.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """Encodes, decodes and digests every whole text: one row per row of ``docs``.

    Null or empty texts have no ids and the digest of nothing; texts of any length are encoded
    whole; repeated rows each give a row; an empty table gives none; other columns are ignored,
    whatever their names.
    """

    def make():
        encoder, known = bpe.ranked(ranks), byte_table(ranks)

        def one(text: str) -> tuple[int, str, str, int]:
            ids = encoder.ids(text)
            listed, utf8 = ids.tolist(), text.encode()
            decimal = b" ".join(map(known.decimal.__getitem__, listed))
            inside = known.offsets(ids, utf8)[2]
            return len(listed), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(known.decode(listed)).hexdigest(), inside

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [one(text) for text in batch.column("text").to_pylist()]
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_inside": pa.int64()}
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds.values()))], ["doc_id", *kinds])

        return step

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_inside long")
