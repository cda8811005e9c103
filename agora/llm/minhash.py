"""Document fingerprints: MinHash signatures by universal hash permutations, in vectorised numpy.

A shingle is five words in lower case.  A signature holds, for each of 128 permutations
``(a * x + b) mod 2**32`` of the shingles' hashes, the low 16 bits of the least value; the share of
equal slots estimates the Jaccard similarity, and fingerprints are these slots, so that likeness is
a function of the fingerprints.  ``near_duplicates`` joins signature bands in Spark and compares
the shingle sets of those that meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty, written
from .simhash import classes_of, connected, linked, set_id

#: Words of a shingle, slots of a signature, bands, and the type of a slot.
WORDS, SLOTS, BANDS, SLOT = 5, 128, 32, np.uint16
#: How far below the similarity a signature's estimate may be for the sets to be compared: over three deviations at 0.8.
SLACK = 0.125
#: Larger buckets are dealt out as pairs of tiles of so many rows.
BUCKET_ROWS = 2048
_RANDOM = np.random.default_rng(42)
A = (_RANDOM.integers(0, 1 << 32, SLOTS, np.uint64) | 1).astype(np.uint32)
B = _RANDOM.integers(0, 1 << 32, SLOTS, np.uint64).astype(np.uint32)
_MIX = (_RANDOM.integers(0, 1 << 63, WORDS, np.uint64) << np.uint64(1)) | np.uint64(1)
#: The signature of a text without words.
EMPTY = np.full(SLOTS, 0xFFFF, SLOT)


def shingle_hashes(text: str) -> np.ndarray:
    """32-bit hashes of a text's shingles; of a text with fewer words, of all its words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = max(1, len(codes) - WORDS + 1) if len(codes) else 0
    mixed = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(codes))):
        mixed += (codes[k : k + n] + np.uint64(1)) * _MIX[k]
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def signature(text: str) -> np.ndarray:
    hashes = shingle_hashes(text)
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (A[:, None] * hashes[None, at : at + 1024] + B[:, None]).min(axis=1))
    return least.astype(SLOT)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of equal slots of two signatures."""
    return float(np.count_nonzero(one == other)) / SLOTS


def band_keys(signature: Column) -> Column:
    """A hash of each band of a signature (binary): texts are candidates where one is equal."""
    width = SLOTS // BANDS * np.dtype(SLOT).itemsize
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(signature, k * width + 1, F.lit(width))))


def edited(text: str, following: str) -> str:
    """A text whose last half (rounded down) is replaced by the first as many characters of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _row(doc_id: int | None, text: str, signed: np.ndarray, following: str, following_signed: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_signed = signature(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, signed.tobytes(), changed_signed.tobytes(), likeness(signed, changed_signed), likeness(signed, following_signed)


def _table(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    bands), fingerprints in hex, a slot's bytes lowest first; ``bands`` are the keys at which
    ``near_duplicates`` has texts meet.

    The next document is the one before in doc_id (after the least, the greatest); rows with equal
    doc_id follow in order of their texts' hashes; rows without doc_id come last.  Null texts are
    empty: no shingles, equal only to texts without words.  Texts of any length are read whole.  A
    table of one row is its own next; an empty table gives no rows; other columns are ignored,
    whatever their names.  Texts are dealt once, by ranges of doc_id and hash; the last row of each
    range meets the first of the next range afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows(kept: list[tuple], kind: int, text: str | None = None) -> pa.RecordBatch:
            n = len(kept)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([text] * n, pa.string()), *_table(kept)], ["part", "kind", "text", *_NAMES])

        last: tuple | None = None
        for batch in batches:
            done = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                signed = signature(text)
                if last is None:
                    yield rows([(doc_id, *[None] * 6)], 1, text)
                else:
                    done.append(_row(*last, text, signed))
                last = doc_id, text, signed
            if done:
                yield rows(done, 0)
        if last is not None:
            yield rows([(last[0], *[None] * 6)], 2, last[1])

    keyed = docs.select("doc_id", text_or_empty(), F.xxhash64(text_or_empty()).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    by = F.col("doc_id").desc()
    ordered = keyed.repartitionByRange(by, "_hash", "_row").sortWithinPartitions(by, "_hash", "text", "_row").select("doc_id", "text")
    made = written(ordered.mapInArrow(run, f"part int, kind int, text string, {_ROW}"), "fingerprints")
    inner = made.where("kind = 0").select(*_NAMES)
    # one first and one last row of each range: as few as there are ranges
    firsts, lasts = (made.where(F.col("kind") == k).select("part", "doc_id", "text") for k in (1, 2))
    following = F.coalesce(F.lead("text").over(Window.orderBy("part")), F.first("text").over(Window.orderBy("part")))
    firsts = firsts.select("part", following.alias("following"))
    ends = lasts.join(firsts, "part").select("doc_id", "text", "following")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_row(i, t, signature(t), f, signature(f)) for i, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))]
            yield pa.RecordBatch.from_arrays(_table(kept), _NAMES)

    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return inner.unionByName(ends.mapInArrow(meet, _ROW)).select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next", band_keys(F.col("fingerprint")).alias("bands"))


def _set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, id, signature: binary) of every row, ``id`` being its shingle set's hash; null texts are empty."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_id(_set(t)) for t in texts], pa.int64()), pa.array([signature(t).tobytes() for t in texts], pa.binary())], ["doc_id", "id", "signature"])

        return step

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, id long, signature binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles: array<long>) of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [_set(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in made], pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["id", "shingles"])

        return step

    return map_rows(docs.select(text_or_empty()), make, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of every row: the least doc_id linked by exact similarity, directly or in steps.

    Equal shingle sets are one class from the start.  Different ones meet where a band of four slots
    is equal; pairs in a bucket whose signatures are at most ``SLACK`` less alike are joined to
    their shingle sets, and those similar enough are links.  A pair at 0.8 shares a band with a
    chance of more than 0.9999999.  Null and empty texts are alike; rows without doc_id keep a null
    class unless a row with one is in it; repeated rows each give a row; an empty table gives none.
    """
    signed = written(signatures(docs), "signatures")
    distinct = written(signed.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature")), "distinct-signatures")

    banded = distinct.select("id", F.explode(band_keys(F.col("signature"))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    # signatures join those alone that share a bucket with another
    keyed = banded.join(shared, "bucket").join(distinct, "id").select("bucket", F.lit(0).alias("ones"), "id", F.col("signature").alias("bits"))

    def near(ids: np.ndarray, bits: pa.Array, split: int) -> tuple[list, list]:
        slots = np.frombuffer(b"".join(bits.to_pylist()), SLOT).reshape(len(ids), SLOTS)
        found: dict[int, list[np.ndarray]] = {}
        for at in range(split or len(ids)):
            others = split or at + 1
            close = others + np.flatnonzero(np.count_nonzero(slots[others:] == slots[at], axis=1) >= (similarity - SLACK) * SLOTS)
            if len(close):
                found.setdefault(at, []).append(close)
                for other in close.tolist():
                    found.setdefault(other, []).append(np.array([at]))
        return linked(ids, found)

    joined = connected(keyed, near, shingle_sets(docs), 0, BUCKET_ROWS, similarity)
    return signed.join(classes_of(distinct, joined), "id").select("doc_id", F.col("component_id").alias("class_id"))
