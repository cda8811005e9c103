"""Exact encoding with public BPE vocabularies, by the tokenizers library, for whole corpora.

A blank before a character that is no white space always begins a new piece under the split
patterns used here, whatever stands before it.  So a text is cut there into chunks, each chunk's
ids depend on that chunk alone, and frequent chunks are answered from a bounded dictionary.
Chunks that hold a character beyond Latin letters go to the library whole; for the others the
split pattern is applied here and the library's BPE model encodes each piece.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

CHUNK = re.compile(r" (?=\S)")
#: Characters of which every version of Unicode's tables says the same, and which have one form.
BEYOND_LATIN = re.compile("[^\x00-ȳ]|İ|<\\|")
#: Entries of each worker's dictionary of chunks; a bound on memory, not on results.
CACHE = 800_000
#: Marks that, after a letter, are always a piece of their own at a chunk's end.
ENDS = frozenset(".,;:!?")

#: The printable stand-ins of the 256 bytes in byte-level vocabularies.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_TO_CHAR = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}
_STAND_IN = str.maketrans({chr(b): c for b, c in BYTE_TO_CHAR.items()})


def stand_ins(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_STAND_IN)


class _Memo(dict):
    """A dictionary that fills itself up to a number of entries."""

    def __init__(self, of: Callable, entries: int):
        super().__init__()
        self.of, self.entries = of, entries

    def __missing__(self, key: str):
        value = self.of(key)
        if len(self) < self.entries:
            self[key] = value
        return value


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids, as ``tokenizer.encode`` would."""

    def __init__(self, tokenizer: Tokenizer, pattern: str, lower: bool = False, entries: int = CACHE):
        self.tokenizer, self.lower = tokenizer, lower
        self.model, self.find = tokenizer.model, regex.compile(pattern).findall
        self.blank = "" if lower else BYTE_TO_CHAR[32]
        self.pieces = _Memo(lambda x: self._merged(stand_ins(x.encode())), entries // 8)
        self.chunks = _Memo(self._after_blank, entries)
        self.counts = _Memo(lambda x: len(self.model.tokenize(stand_ins(x.encode()))), entries)

    def _merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _after_blank(self, chunk: str) -> bytes:
        """The ids of a blank and a chunk; one word, or a word and a mark, needs no pattern."""
        if chunk.isalpha() and (chunk.isascii() or not BEYOND_LATIN.search(chunk)):
            word = chunk.lower() if self.lower else chunk
            return self._merged(self.blank + (word if word.isascii() else stand_ins(word.encode())))
        if chunk[-1:] in ENDS and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str) -> bytes:
        if BEYOND_LATIN.search(chunk):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, self.find(chunk.lower() if self.lower else chunk)))

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, which together are the text (for vocabularies that neither lower-case nor drop)."""
        if not BEYOND_LATIN.search(text):
            return self.find(text)
        head, *rest = CHUNK.split(text)
        out, plain = [], ""
        for chunk in [head, *(" " + x for x in rest)]:
            if not BEYOND_LATIN.search(chunk):
                plain += chunk
                continue
            out += self.find(plain)
            plain = ""
            out += [chunk[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]
        return out + self.find(plain)

    def raw(self, text: str) -> bytes:
        head, *rest = CHUNK.split(text)
        return self._chunk(head) + b"".join(map(self.chunks.__getitem__, rest))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")


#: Encoders by what they were made from; a worker keeps them between tasks.
_HELD: dict[tuple, Encoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def ranked(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """An encoder from a rank file: of two neighbouring parts, those whose joint has the lowest rank merge first.

    Every cut of a token into two tokens becomes a merge, in order of the token's rank, so that the
    library merges exactly what the ranks allow.
    """
    if (key := ("ranks", path, pattern)) not in _HELD:
        ranks = read_ranks(path)
        name = {token: stand_ins(token) for token in ranks}
        merges = [(name[token[:k]], name[token[k:]]) for token, _ in sorted(ranks.items(), key=lambda x: x[1]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        made = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        made.decoder = decoders.ByteLevel()
        _HELD[key] = Encoder(made, pattern)
    return _HELD[key]


def byte_level(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """An encoder from a byte-level tokenizer file; special tokens' strings in a text are ordinary text."""
    if (key := ("bytes", path, pattern)) not in _HELD:
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _HELD[key] = Encoder(made, pattern)
    return _HELD[key]


#: Fixed value: the split pattern of the lower-cased vocabulary with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_level(path: str) -> Encoder:
    """An encoder from the tokenizer file with word ends, which lower-cases and drops white space."""
    if (key := ("words", path)) not in _HELD:
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _HELD[key] = Encoder(made, WORD_PATTERN, lower=True)
    return _HELD[key]
