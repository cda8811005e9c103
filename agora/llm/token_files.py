"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

A shard is one byte string::

    magic "FRVB" | documents, ranks: u32 | ids: u64
    doc_id i64 and null flag u8 of each document | ids of each document u32
    id of each rank u32, the most frequent first
    control bytes, one for four ids: two bits each, the code's length less one
    codes: the rank's little-endian bytes, as many as needed

Shards are rows of a Parquet table, so that Spark commits, retries and reads them wherever the
table's file system is.  Each shard ranks the ids by their counts in it, so that one pass does.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import text_or_empty

MAGIC = b"FRVB"
_HEAD = struct.Struct("<4sIIQ")
#: Lengths of the four codes of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Ids in a shard: a bound on what a writer or reader holds at once (a longer document has a shard of its own).
SHARD_IDS = 2_000_000


def pack_shard(doc_ids: list[int | None], each: list[np.ndarray]) -> bytes:
    ids = np.concatenate(each) if each else np.empty(0, "<u4")
    counts = np.bincount(ids) if len(ids) else np.empty(0, np.int64)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank_of[ids]
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    quads = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    quads[: len(ids)] = lengths - 1
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    known = np.array([x or 0 for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    sizes = np.array([len(x) for x in each], "<u4")
    return b"".join([_HEAD.pack(MAGIC, len(each), len(ranked), len(ids)), *(x.tobytes() for x in (known, nulls, sizes, ranked, control, codes))])


def unpack_shard(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, the number of ids of each document, and all ids in order."""
    magic, n_docs, n_ranks, n_ids = _HEAD.unpack_from(shard)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(shard, kind, n, at)
        at += got.nbytes
        return got

    known, nulls, sizes, ranked = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("<u4", n_ranks)
    lengths = LENGTHS[take("u1", -(-n_ids // 4))].ravel()[:n_ids]
    codes = np.frombuffer(shard, np.uint8, -1, at)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = codes[starts].astype(np.uint32) if n_ids else np.empty(0, np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        ranks[longer] |= codes[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return [None if null else int(x) for x, null in zip(known, nulls)], sizes, ranked[ranks] if n_ids else ranks


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Writes ids of all ``docs`` (doc_id, text) to ``path``, ascending by doc_id, ``end_id`` after each.

    Texts move once, dealt by ranges of doc_id; each range is encoded in order.  Null and empty
    texts are ``end_id`` alone; a null doc_id comes first; rows with equal doc_id stand side by side
    in order of their texts' hashes, so that ranges can cut them.  Very long texts have shards of
    their own.  An empty table gives no files' rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = bpe.byte_level(tokenizer), np.uint32(end_id).tobytes()
        part, before, shard = TaskContext.get().partitionId(), 0, 0
        names, each, held = [], [], 0

        def full() -> pa.RecordBatch:
            columns = {"part": part, "shard": shard, "before": before, "n_ids": held, "payload": pack_shard(names, each)}
            return pa.RecordBatch.from_pylist([columns], schema)

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(encoder.raw(text) + end, "<u4")
                if each and held + len(ids) > shard_ids:
                    yield full()
                    names, each, before, shard, held = [], [], before + held, shard + 1, 0
                names.append(name)
                each.append(ids)
                held += len(ids)
        if each:
            yield full()

    keyed = docs.select("doc_id", text_or_empty(), F.xxhash64(text_or_empty()).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "text", "_row").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, shard int, before long, n_ids long, payload binary").write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str, kinds: dict[str, pa.DataType], schema: str, of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Rows (doc_id, start, *kinds) of the files at ``path``; ``of`` makes the last from a document's ids."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))  # one row for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, before, payload in zip(*(batch.column(c) for c in ("base", "before", "payload"))):
                names, sizes, ids = unpack_shard(payload.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                made = [of(ids[e - n : e]) for e, n in zip(ends, sizes)]
                starts = base.as_py() + before.as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts), *(pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds.values()))], ["doc_id", "start", *kinds])

    return shards.select("part", "before", "payload").join(F.broadcast(bases), "part").mapInArrow(run, f"doc_id long, start long, {schema}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files."""
    return _read(spark, path, {"ids": pa.list_(pa.int64())}, "ids array<long>", lambda ids: (ids.astype(np.int64),))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    return _read(spark, path, {"n_tokens": pa.int64(), "ids_crc32": pa.int64()}, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
