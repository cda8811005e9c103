"""Edit-aware token counts: a segment tree over a document's pre-tokens, updated where edits touch it.

Leaves are the pieces that the tokenizer's split pattern makes, each encoded on its own, so that a
document's count is the sum of its leaves'.  Leaves stand in blocks of at most ``BLOCK``; a heap
over the blocks holds sums of characters and tokens.  A piece depends on itself and on at most two
characters after it.  An edit therefore finds the leaf that holds the second character before it,
splits anew from there until a boundary behind the edit is one that stood before, encodes the
pieces in between and updates the sums above them.  A block that grows too large is cut, so that
large inserts are leaves like any other text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import map_rows, text_or_empty

#: (start, end, new text) of an edit in code points of the text as it stands.
Edit = tuple[int, int, str]
#: Leaves of a block at most; new blocks are filled to half of it.
BLOCK = 256
#: How many characters before an edit, and behind a boundary, a split can depend on.
REACH = 2


class TokenTree:
    """A document's pre-tokens with sums of characters and tokens in a heap over blocks of them."""

    def __init__(self, text: str, split: Callable[[str], list[str]], count: Callable[[str], int]):
        self.split, self.count = split, count
        self.encoded = 0
        self._build(self._blocks(split(text)))

    def _blocks(self, pieces: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Blocks of pieces, their numbers of characters and their numbers of tokens."""
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(self.count, pieces), np.int64, len(pieces))
        return [(pieces[k : k + BLOCK // 2], chars[k : k + BLOCK // 2], tokens[k : k + BLOCK // 2]) for k in range(0, len(pieces), BLOCK // 2)]

    def _build(self, blocks: list[tuple[list[str], np.ndarray, np.ndarray]]) -> None:
        self.blocks = blocks or [([], np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(self.blocks)] = [(int(c.sum()), int(t.sum())) for _, c, t in self.blocks]
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join("".join(pieces) for pieces, _, _ in self.blocks)

    def _leaf(self, at: int) -> tuple[int, int, int]:
        """Block and place of the leaf that holds character ``at`` (the last, if none does), and where it begins."""
        node, begin = 1, 0
        at = max(0, min(at, self.n_chars - 1))
        while node < self.size:
            node *= 2
            if at >= begin + self.sums[node, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        block = min(node - self.size, len(self.blocks) - 1)
        ends = np.cumsum(self.blocks[block][1])
        place = int(np.searchsorted(ends, at - begin, "right"))
        return block, place, begin + int(ends[place - 1] if place else 0)

    def _set(self, block: int) -> None:
        """Puts a block's sums into the nodes above it."""
        _, chars, tokens = self.blocks[block]
        node = self.size + block
        change = np.array([chars.sum(), tokens.sum()]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def _following(self, block: int, place: int):
        """The leaves from a place on."""
        while block < len(self.blocks):
            yield from ((block, k, piece) for k, piece in enumerate(self.blocks[block][0][place:], place))
            block, place = block + 1, 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in the place of the characters from ``start`` up to ``end``; offsets beyond the text end at it."""
        start, end = max(0, min(start, self.n_chars)), max(0, min(end, self.n_chars))
        end = max(start, end)
        block, place, begin = self._leaf(start - REACH)
        old, at, more = [], begin, self._following(block, place)
        last, wanted = (block, place), end + 32
        while True:
            for b, k, piece in more:  # old leaves, until they reach far enough behind the edit
                old.append(piece)
                at, last = at + len(piece), (b, k + 1)
                if at >= wanted:
                    break
            held = "".join(old)
            fresh = held[: start - begin] + new + held[end - begin :]
            grown = len(fresh) - len(held)
            stood, place_of = {begin}, begin
            for piece in old:
                place_of += len(piece)
                stood.add(place_of)
            pieces, here, met = [], begin, at >= self.n_chars
            for piece in self.split(fresh):
                if here - grown >= end and here - grown in stood and here >= start + len(new) and here + REACH <= begin + len(fresh):
                    met = True
                    break
                pieces.append(piece)
                here += len(piece)
            if met:
                break
            wanted += 2 * (wanted - begin)
        gone, met_at = 0, begin
        while gone < len(old) and met_at < here - grown:
            met_at += len(old[gone])
            gone += 1
        self.encoded += sum(map(len, pieces))
        self._replace(block, place, gone, pieces)

    def _replace(self, block: int, place: int, gone: int, pieces: list[str]) -> None:
        """Puts ``pieces`` in the place of ``gone`` leaves from a place on."""
        last, left = block, gone + place
        while left > len(self.blocks[last][0]) and last + 1 < len(self.blocks):
            left -= len(self.blocks[last][0])
            last += 1
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(self.count, pieces), np.int64, len(pieces))
        head, tail = self.blocks[block], self.blocks[last]
        joined = (head[0][:place] + pieces + tail[0][left:], np.concatenate([head[1][:place], chars, tail[1][left:]]), np.concatenate([head[2][:place], tokens, tail[2][left:]]))
        if len(joined[0]) <= BLOCK:
            self.blocks[block] = joined
            self._set(block)
            for k in range(block + 1, last + 1):
                self.blocks[k] = ([], chars[:0], tokens[:0])
                self._set(k)
            return
        cut = [tuple(x[k : k + BLOCK // 2] for x in joined) for k in range(0, len(joined[0]), BLOCK // 2)]
        self._build([*self.blocks[:block], *cut, *(x for x in self.blocks[last + 1 :] if x[0])])


def standard_edits(n_chars: int) -> list[Edit]:
    """A replacement at a third of a text, an insertion at two thirds and a deletion at its start."""
    return [(n_chars // 3, n_chars // 3 + 20, "Edited: 12 née words,\n"), (2 * n_chars // 3, 2 * n_chars // 3, " put in"), (0, 7, "")]


def count_edits(docs: DataFrame, tokenizer: str, edits: Callable[[int], list[Edit]] = standard_edits) -> DataFrame:
    """Token counts of every whole text before and after ``edits`` (of its number of characters).

    (doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars): the last is how many
    characters the edits had encoded anew.  Null texts are empty and count no tokens before the
    edits; very long texts are trees like any other; repeated rows each give a row; an empty table
    gives none; other columns are ignored, whatever their names.  Nothing is shuffled.
    """

    def make():
        encoder = bpe.byte_level(tokenizer)
        count = encoder.counts.__getitem__

        def one(text: str) -> tuple[int, ...]:
            tree = TokenTree(text, encoder.split, count)
            before = tree.n_chars, tree.n_tokens
            for edit in edits(tree.n_chars):
                tree.edit(*edit)
            return *before, tree.n_chars, tree.n_tokens, tree.encoded

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [one(text) for text in batch.column("text").to_pylist()]
            names = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars"]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], pa.int64()) for k in range(len(names)))], ["doc_id", *names])

        return step

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long")
