"""Order-preserving packing of token streams into sequences, by dynamic programming.

The documents of a partition are one stream, in order.  It may be cut after a document (free),
after a sentence (a small penalty) or, where a sentence is long, within it (a larger one).  The
cost of a plan is its padding plus its penalties.  With positions ``p`` the best plan up to cut
``j`` costs ``pen(j) + size - p(j) + min(best(i) + p(i))`` over cuts ``i`` at most ``size`` before:
a sliding minimum, kept in a monotone queue.  Sequences whose length is a power of two, 1
included, need no padding, so cuts at those distances are tried as well.  A stream is planned a
block at a time: what lies near a block's end, where the next ids still matter, is planned again
with the next block.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import text_or_empty

#: Penalties in tokens of padding: a document cut after a sentence, a sentence cut, any sequence.
AFTER_SENTENCE, IN_SENTENCE, SEQUENCE = 8, 48, 4
#: A stream is planned in blocks of so many ids; the last ``AHEAD`` sequences' worth of each goes to the next.
BLOCK_IDS, AHEAD = 1 << 18, 8
#: Within sentences, a cut is offered every so many ids (in short sequences, every quarter).
STRIDE = 128


def plan(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> list[int]:
    """Cuts of a stream that ends at ``doc_ends[-1]``: ascending, without 0, with the end."""
    total = int(doc_ends[-1])
    kind = np.full(total + 1, -1, np.int8)  # 0 within a sentence, 1 after one, 2 after a document
    kind[sentence_ends] = 1
    kind[doc_ends] = 2
    kind[0] = 2
    found, stride = np.flatnonzero(kind >= 0), min(STRIDE, max(1, size // 4))
    gaps = np.flatnonzero(np.diff(found) > stride)
    extra = [np.arange(found[g] + stride, found[g + 1], stride) for g in gaps.tolist()]
    if extra:
        kind[np.concatenate(extra)] = 0
        found = np.flatnonzero(kind >= 0)
    penalty = (SEQUENCE + np.array([IN_SENTENCE, AFTER_SENTENCE, 0])[kind[found]]).tolist()
    exact: dict[int, list[int]] = {}
    power = 1
    while power < size:
        at = np.searchsorted(found, found - power)
        for j in np.flatnonzero((found >= power) & (found[at] == found - power)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    cuts = found.tolist()
    best, came = [0] * len(cuts), [0] * len(cuts)
    values, queue, head = [], [], 0
    for j in range(1, len(cuts)):
        value = best[j - 1] + cuts[j - 1]
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(j - 1)
        values.append(value)
        end = cuts[j]
        while cuts[queue[head]] < end - size:
            head += 1
        cost, origin = values[head] + size - end, queue[head]
        for i in exact.get(j, ()):
            if best[i] < cost:
                cost, origin = best[i], i
        best[j], came[j] = cost + penalty[j], origin
    out, j = [], len(cuts) - 1
    while j:
        out.append(cuts[j])
        j = came[j]
    return out[::-1]


def sentence_marks(tokenizer: str) -> np.ndarray:
    """Of each id of the vocabulary: whether it ends a sentence."""
    vocabulary = bpe.word_level(tokenizer).tokenizer.get_vocab()
    marks = np.zeros(max(vocabulary.values()) + 1, bool)
    marks[[i for token, i in vocabulary.items() if re.search(r"[.!?]\W*(</w>)$", token)]] = True
    return marks


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all ``docs`` (doc_id, text).

    Each partition is packed in its own order, so nothing is shuffled and each document's pieces
    follow each other; a partition's end ends a sequence, so that how files are split decides where
    sequences end, and costs at most one padding a partition.  Null and empty texts are ``end_id``
    alone.  Very long texts are cut like others and planned in blocks.  Repeated rows are packed
    each; of equally cheap plans the one with the earliest last cut is taken; an empty table gives
    no pieces; other columns are ignored, whatever their names.
    """
    block_ids = max(block_ids, 4 * size)
    ahead = min(AHEAD * size, block_ids // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, marks, end = bpe.word_level(tokenizer), sentence_marks(tokenizer), np.uint32(end_id).tobytes()
        made = TaskContext.get().partitionId() << 40
        waiting: deque[tuple[int | None, bytes]] = deque()  # documents whose ids are not all in a sequence yet
        used, held = 0, 0  # how many ids of the first one are, and how many in all wait

        def block(last: bool) -> pa.RecordBatch:
            """Plans what waits, up to a block, and takes out the sequences that are settled."""
            nonlocal made, used, held
            names, wholes, parts, left = [], [], [], held if last else block_ids
            for k, (name, raw) in enumerate(waiting):
                names.append(name)
                wholes.append(len(raw) // 4)
                parts.append(memoryview(raw)[0 if k else 4 * used :][: 4 * left])
                left -= len(parts[-1]) // 4
                if not left:
                    break
            raw = b"".join(parts)
            ids, doc_ends, doc_tokens = np.frombuffer(raw, "<u4"), np.cumsum([len(x) // 4 for x in parts]), np.array(wholes)
            cuts = np.array(plan(doc_ends, np.flatnonzero(marks[ids]) + 1, size))
            if not last:
                cuts = cuts[cuts <= len(ids) - ahead]
            ends = np.union1d(doc_ends[doc_ends <= cuts[-1]], cuts)
            begins = np.concatenate([[0], ends[:-1]])
            doc, sequence = np.searchsorted(doc_ends, begins, "right"), np.searchsorted(cuts, begins, "right")
            doc_begins, cut_begins = np.concatenate([[-used], doc_ends[:-1]]), np.concatenate([[0], cuts[:-1]])
            columns = {
                "doc_id": pa.array([names[d] for d in doc.tolist()], pa.int64()),
                "start": pa.array(begins - doc_begins[doc]),
                "length": pa.array(ends - begins),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64()),
                "doc_tokens": pa.array(doc_tokens[doc]),
                "sequence_id": pa.array(made + sequence),
                "offset": pa.array(begins - cut_begins[sequence]),
            }
            made += len(cuts)
            gone = int(np.searchsorted(doc_ends, cuts[-1], "right"))
            for _ in range(gone):
                waiting.popleft()
            used = int(cuts[-1]) - int(doc_begins[gone]) if gone < len(doc_begins) else 0
            held -= int(cuts[-1])
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                waiting.append((name, encoder.raw(text) + end))
                held += len(waiting[-1][1]) // 4
                while held >= block_ids:
                    yield block(False)
        if held:
            yield block(True)

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
