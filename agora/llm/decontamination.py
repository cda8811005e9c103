"""Benchmark decontamination: windows of benchmark words, as a broadcast hash set, looked up in training texts.

Words are runs of digits, letters and everything beyond ASCII, A-Z in lower case.  A block of the
benchmark goes to the tasks as sorted window hashes with the places and words to verify each hit.
Blocks hold a bounded number of words; a benchmark of more has several, and texts pass one after
the other.  Texts stay where they are: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, spread, written

#: Words of a window; words of a piece of an item, and how many of them a block that is sent to the tasks may hold (about 30 bytes a word, and 120 a different word).
WORDS, PIECE_WORDS, BLOCK_WORDS = 10, 1 << 14, 1 << 21
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ids of each window at ``starts``."""
    mixed = np.zeros(len(starts), np.uint64)
    for k in range(length):
        mixed = mixed * _STEP + (ids[starts + k].astype(np.uint64) + np.uint64(1)) * _MIX
    return mixed ^ (mixed >> np.uint64(31))


@dataclass(frozen=True)
class Windows:
    """All windows of one length: sorted distinct hashes' first places, and which items have each distinct window.

    Windows of one hash but other words follow each other in ``hashes``; ``places`` are into the
    block's words; ``items[starts[k]:starts[k + 1]]`` are the items of window k.
    """

    length: int
    hashes: np.ndarray
    places: np.ndarray
    starts: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Block:
    """Some of a benchmark's items: the ids of their words, all of their words in a row, and their windows by length."""

    ids: dict[bytes, int]
    words: np.ndarray
    windows: list[Windows]
    names: list


def _windows(words: np.ndarray, length: int, places: np.ndarray, owners: np.ndarray) -> Windows:
    """Of windows of ``length`` at ``places``, each of an owner: equal ones become one with all its owners."""
    grams = words[places[:, None] + np.arange(length)]
    order = np.lexsort(grams.T[::-1])
    grams, places, owners = grams[order], places[order], owners[order]
    fresh = np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)])
    window = np.cumsum(fresh) - 1
    firsts = places[fresh]
    hashes = window_hashes(words, firsts, length)
    by_hash = np.argsort(hashes, kind="stable")
    rank = np.empty(len(by_hash), np.int64)
    rank[by_hash] = np.arange(len(by_hash))
    pairs = np.unique(np.stack([rank[window], owners]), axis=1)
    starts = np.searchsorted(pairs[0], np.arange(len(by_hash) + 1))
    return Windows(length, hashes[by_hash], firsts[by_hash], starts, pairs[1].astype(np.int32))


def block_of(rows: pa.Table, length: int = WORDS) -> Block:
    """Of ``pieces`` (name, words, whole); a whole item of fewer words than ``length``, but not none, is one window."""
    coded = pa.compute.dictionary_encode(rows.column("words").combine_chunks().flatten())
    ids = dict(zip(coded.dictionary.to_pylist(), range(len(coded.dictionary)))) if len(coded) else {}
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    counts = pa.compute.list_value_length(rows.column("words")).to_numpy().astype(np.int64)
    owners = pa.compute.dictionary_encode(rows.column("name"), null_encoding="encode").combine_chunks()
    owner, names = owners.indices.to_numpy(zero_copy_only=False), owners.dictionary.to_pylist()
    whole = rows.column("whole").to_numpy()
    sizes, begins = np.where(whole, np.minimum(length, counts), length), np.cumsum(counts) - counts
    found = []
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero((sizes == size) & (counts >= size) & (size > 0))
        each = counts[mine] - size + 1
        if len(mine):
            places = np.repeat(begins[mine] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            found.append(_windows(words, size, places, np.repeat(owner[mine], each)))
    return Block(ids, words, found, names)


def hits(words: list[bytes], block: Block) -> tuple[np.ndarray, list]:
    """(spans, items): which words, as rows (start, end) in order and apart, lie in windows of the block, and whose."""
    ids = np.fromiter(map(block.ids.get, words, [-1] * len(words)) if words else (), np.int32, len(words))
    spans, items = [], []
    for windows in block.windows:
        k = windows.length
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        starts = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.empty(0, np.int64)
        if not len(starts):
            continue
        hashes = window_hashes(ids, starts, k)
        low, high = np.searchsorted(windows.hashes, hashes), np.searchsorted(windows.hashes, hashes, "right")
        for more in range(int((high - low).max(initial=0))):  # over one where windows share a hash
            met = np.flatnonzero(low + more < high)
            at = low[met] + more
            same = (block.words[windows.places[at][:, None] + np.arange(k)] == ids[starts[met][:, None] + np.arange(k)]).all(axis=1)
            spans.append(np.stack([starts[met[same]], starts[met[same]] + k], axis=1))
            for window in np.unique(at[same]).tolist():
                items.append(windows.items[windows.starts[window] : windows.starts[window + 1]])
    who = [block.names[i] for i in np.unique(np.concatenate(items)).tolist()] if items else []
    return united(np.concatenate(spans) if spans else np.empty((0, 2), np.int64)), who


def united(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) that meet or overlap as one, in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    return np.stack([spans[first, 0], ends[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(spans) - 1]])]], axis=1)


def without(text: bytes, spans: np.ndarray) -> bytes:
    """A text without its words in ``spans`` and what stands between them."""
    ends = [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*kept, text[at:]])


def pieces(benchmark: DataFrame, length: int = WORDS, size: int = PIECE_WORDS) -> DataFrame:
    """(name, words, whole) of the items: longer ones in pieces that share all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text or b"")
                cuts = range(0, max(1, len(words) - length + 1), size)
                rows += [(name, words[a : a + size + length - 1], len(cuts) == 1) for a in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary())), pa.array([r[2] for r in rows], pa.bool_())], ["name", "words", "whole"])

    return benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "name string, words array<binary>, whole boolean")


_SPANS = "array<struct<start: long, end: long>>"


def scanned(docs: DataFrame, benchmark: DataFrame, length: int = WORDS, block_words: int = BLOCK_WORDS, texts: bool = True) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every row of ``docs``: the contaminated spans of words, and by which items.

    ``text`` is binary, and null unless ``texts``.
    """
    cut = written(pieces(benchmark, length).where(F.size("words") > 0).distinct(), "benchmark-words")
    n_blocks = max(1, -(-int(cut.agg(F.sum(F.size("words"))).first()[0] or 0) * 3 // (2 * block_words)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = spread(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).withColumns({"spans": F.lit(None).cast(_SPANS), "items": F.lit(None).cast("array<string>")})
    before: DataFrame | None = None
    for k in range(n_blocks):
        mine = cut.where(F.pmod(F.xxhash64("name", "words"), F.lit(n_blocks)) == k)
        sent = docs.sparkSession.sparkContext.broadcast(block_of(mine.select("name", "words", "whole").toArrow(), length))
        passed_on = texts or k + 1 < n_blocks

        def run(batches: Iterator[pa.RecordBatch], sent=sent, passed_on=passed_on) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    yield _scanned_rows(batch.slice(at, 512), block, passed_on)

        found = found.mapInArrow(run, f"doc_id {kind}, text binary, n_words long, spans {_SPANS}, items array<string>")
        if k + 1 < n_blocks:
            made = written(found, "scanned")
            if before is not None:
                forget(before)
            before, found = made, made.drop("n_words")
    return found


def _scanned_rows(rows: pa.RecordBatch, block: Block, texts: bool) -> pa.RecordBatch:
    counts, spans, items = [], [], []
    for text, before, who in zip(*(rows.column(c).to_pylist() for c in ("text", "spans", "items"))):
        words = words_of(text or b"")
        mine, names = hits(words, block)
        if before:
            mine, names = united(np.concatenate([np.array([(s["start"], s["end"]) for s in before]), mine])), [*{*who, *names}]
        counts.append(len(words))
        spans.append([{"start": a, "end": b} for a, b in mine.tolist()])
        items.append(names)
    kept = rows.column("text") if texts else pa.nulls(rows.num_rows, pa.binary())
    spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), kept, pa.array(counts, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", length: int = WORDS) -> DataFrame:
    """(doc_id, text) of ``docs`` without what the benchmark has: its ``spans`` of words, or whole ``documents``.

    Texts without a hit stay as they are, null ones too; cases are those of ``contamination``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove spans or documents")
    found = scanned(docs, benchmark, length)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [without(t, np.array([(s["start"], s["end"]) for s in spans])) if spans else t for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], ["doc_id", "text"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, text binary").select("doc_id", F.col("text").cast("string").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A window is ``length`` words in a row of an item of ``benchmark`` (item_id, text), or all words
    of an item of fewer; null and empty items have none.  Rows that share an item_id are one item;
    items without an id count for hits but cannot be listed, and so are not in n_items.  Null and
    empty texts have no words; repeated rows each give a row; texts and items of any length are read
    whole; an empty table gives no rows, and an empty benchmark no hits; other columns are not read.
    """
    found = scanned(docs, benchmark, length, texts=False)
    known = F.array_sort(F.array_distinct(F.filter("items", lambda i: i.isNotNull())))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), known.alias("_items")).select("doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
