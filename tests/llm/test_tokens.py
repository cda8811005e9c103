"""Encoders and what is built on them, against the libraries' own results."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from agora.llm import bpe, byte_bpe, packing, token_counts, token_files

RANKS, BYTES, WORDS = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "", " ", "  ", " a", "a ", "\n\nfoo  bar \n baz", "İstanbul ΣΑΣ ς É é 日本語 😀😀 слово, и!", "x\x1c y \x85 z　w", "don't I'LL we've  's", "a" * 500, "<|endoftext|> foo<|endoftext|>", "́ a ̀b", "1234567 ½ ² Ⅷ",
    "tab\tsep\r\nnew  \t x", "Ünï, cödé. ß! ñ?", "word" * 3000 + " end", " ".join(f"w{k}é," for k in range(3000)),
]
SCHEMA = "doc_id long, text string, ids string, starts int, part int, bits int"  # columns that clash with the operators' own


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1, 2, 3) for k, t in enumerate(TEXTS)] + [(100, None, None, None, None, None), (None, "no id", "", 0, 0, 0), (3, TEXTS[3], "", 0, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def library(path):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


def mixed(rng):
    return "".join(rng.choice(["a", "b ", " ", "\n", "  x", ".", "é", "日", " don't", "\u0301", "A", "1", "\x1f", "<|endoftext|>"]) for _ in range(rng.randint(0, 30)))


def test_encoders_agree_with_libraries():
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary
    rng = random.Random(5)
    texts = TEXTS + [mixed(rng) for _ in range(300)]
    for encoder, plain in ((bpe.ranked(RANKS), tik), (bpe.byte_level(BYTES), library(BYTES)), (bpe.word_level(WORDS), library(WORDS))):
        for text in texts:
            assert encoder.ids(text).tolist() == plain(text), repr(text)


def test_full_memo_changes_nothing():
    made = bpe.Encoder(Tokenizer.from_file(BYTES), P.PATTERN, entries=0)
    plain = library(BYTES)
    assert all(made.ids(t).tolist() == plain(t) for t in TEXTS if "<|" not in t)


def test_offsets_of_split_characters():
    table, text = byte_bpe.byte_table(RANKS), "a😀é日"
    ids = bpe.ranked(RANKS).ids(text)
    starts, ends, inside = table.offsets(ids, text.encode())
    assert starts[0] == 0 and ends[-1] == len(text) and inside > 0
    assert all(text.encode().decode()[a:b] for a, b in zip(starts, ends))


def test_round_trip(docs, nothing):
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary
    got = byte_bpe.round_trip(docs, RANKS).collect()
    assert len(got) == docs.count()
    text = dict(enumerate(TEXTS)) | {100: "", None: "no id"}
    for r in got:
        ids = tik(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    back = {r.doc_id: r.text for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()}
    assert back == text
    assert byte_bpe.round_trip(nothing, RANKS).count() == 0


def test_token_files(docs, nothing, tmp_path, spark):
    plain = library(BYTES)
    token_files.write(docs, BYTES, str(tmp_path / "t"), end_id=0, shard_ids=2000)
    got = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    text = dict(enumerate(TEXTS)) | {100: "", None: "no id"}
    order = [None, *sorted([*range(len(TEXTS)), 3, 100])]
    assert [r.doc_id for r in got] == order
    at = 0
    for r in got:
        assert r.start == at and list(r.ids) == [*plain(text[r.doc_id]), 0]
        at += len(r.ids)
    one = {(r.doc_id, r.start): r for r in token_files.read_digests(spark, str(tmp_path / "t")).collect()}
    for r in got:
        assert one[r.doc_id, r.start].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    token_files.write(nothing, BYTES, str(tmp_path / "n"))
    assert token_files.read_digests(spark, str(tmp_path / "n")).count() == 0


def test_token_files_of_one_doc_id(spark, tmp_path):
    """Rows that share a doc_id may lie in several ranges; starts are still gapless."""
    docs = spark.createDataFrame([(5, f"text {k % 9}") for k in range(200)], "doc_id long, text string").repartition(4)
    token_files.write(docs, BYTES, str(tmp_path / "same"), shard_ids=50)
    got = sorted(token_files.read_digests(spark, str(tmp_path / "same")).collect(), key=lambda r: r.start)
    assert len(got) == 200 and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_shard_coding():
    rng = np.random.default_rng(1)
    each = [rng.integers(0, 300_000, n).astype("<u4") for n in (0, 1, 5, 70_001)]
    names, sizes, ids = token_files.unpack_shard(token_files.pack_shard([None, -5, 7, 7], each))
    assert names == [None, -5, 7, 7] and sizes.tolist() == [0, 1, 5, 70_001] and (ids == np.concatenate(each)).all()
    with pytest.raises(ValueError):
        token_files.unpack_shard(b"x" * 40)


def test_packing(docs, nothing):
    plain = library(WORDS)
    text = dict(enumerate(TEXTS)) | {100: "", None: "no id"}
    got = packing.pack(docs, WORDS, end_id=1, size=64, block_ids=300).toPandas()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= 64 and (seq.offset.to_numpy() == np.cumsum([0, *seq.length])[:-1]).all()
    for doc, pieces in got[got.doc_id.notna()].groupby("doc_id"):
        ids, at = np.array([*plain(text[int(doc)]), 1], "<u4"), 0
        pieces = pieces.sort_values("start", kind="stable")
        if doc == 3:  # a repeated row: each piece twice, as the text is shorter than a sequence
            assert sorted(pieces.doc_tokens) == [len(ids)] * len(pieces) and pieces.length.sum() == 2 * len(ids)
            continue
        for r in pieces.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert packing.pack(nothing, WORDS).count() == 0


def cost(cuts, docs, sentences, size):
    total, before = 0, 0
    for c in cuts:
        n = c - before
        total += packing.SEQUENCE + (0 if c in docs else packing.AFTER_SENTENCE if c in sentences else packing.IN_SENTENCE) + (0 if n & (n - 1) == 0 else size - n)
        before = c
    return total


def test_plan_is_the_cheapest():
    """Against all plans of short streams."""
    rng = random.Random(1)
    for _ in range(200):
        size, total = rng.choice([5, 8, 16]), rng.randint(1, 14)
        docs = sorted({total, *rng.sample(range(1, total + 1), rng.randint(0, min(3, total)))})
        sentences = sorted(rng.sample(range(1, total + 1), rng.randint(0, min(4, total))))
        got = packing.plan(np.array(docs), np.array(sentences, int), size)
        known, stride = sorted({0, *docs, *sentences}), max(1, size // 4)
        places = {*known[1:], *(x for a, b in zip(known, known[1:]) if b - a > stride for x in range(a + stride, b, stride))} - {total}
        every = [[*some, total] for n in range(len(places) + 1) for some in itertools.combinations(sorted(places), n) if max(np.diff([0, *some, total])) <= size]
        assert got[-1] == total and max(np.diff([0, *got])) <= size
        assert cost(got, docs, sentences, size) == min(cost(x, docs, sentences, size) for x in every)


def test_small_powers_of_two_need_no_padding():
    cuts = packing.plan(np.array([2064]), np.arange(16, 2064, 40), 2048)
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in np.diff([0, *cuts]).tolist()) == 0


@pytest.mark.parametrize("block_ids", [256, 1000, 1 << 18])
def test_blocks_lose_nothing_and_pad_little(spark, block_ids):
    """A document over many blocks, and many documents in one: the same pieces, whatever the block."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["stone.", "river", "light", "over"]) for _ in range(n)) for n in (0, 1, 5000, 3, 0, 40, 700, 2, 900)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, length int").coalesce(1)
    got = packing.pack(docs, WORDS, end_id=1, size=64, block_ids=block_ids).toPandas()
    plain = library(WORDS)
    for k, pieces in got.groupby("doc_id"):
        assert pieces.length.sum() == len(plain(texts[k])) + 1 == pieces.doc_tokens.max() and (pieces.start.to_numpy() == np.cumsum([0, *pieces.length])[:-1]).all()
    held = got.groupby("sequence_id").length.sum()
    assert held.max() <= 64 and sum(0 if n & (n - 1) == 0 else 64 - n for n in held.tolist()) < 0.04 * held.sum()


def tree_of(text):
    encoder = bpe.byte_level(BYTES)
    return token_counts.TokenTree(text, encoder.split, encoder.counts.__getitem__)


@pytest.mark.parametrize("block", [4, 256])
def test_segment_tree_against_full_encoding(monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    plain, rng = library(BYTES), random.Random(2)
    for _ in range(150):
        text = mixed(rng)
        tree = tree_of(text)
        for _ in range(6):
            a = rng.randint(0, len(text) + 2)
            b, new = rng.randint(0, len(text) + 2) if rng.random() < 0.3 else a + rng.randint(0, 3), mixed(rng)[: rng.choice([4, 60])]
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(a, min(b, len(text))) :]
            assert tree.text == text and tree.n_chars == len(text) and tree.n_tokens == len(plain(text)), repr(text)


def test_edits_encode_little_of_long_texts():
    """One character of text without blanks, of lines of one word, and after a large insert."""
    for text in ("日本語の文、です。" * 2000, "word\n" * 3000, "a,b;" * 4000):
        tree = tree_of(text)
        tree.edit(9000, 9001, "x")
        assert tree.encoded <= 40 and tree.n_tokens == len(library(BYTES)(text[:9000] + "x" + text[9001:]))
    tree = tree_of("some text here")
    tree.edit(5, 5, "put in. " * 10_000)
    inserted = tree.encoded
    for k in range(5):
        tree.edit(20_000 + 9000 * k, 20_001 + 9000 * k, "z")
    assert inserted <= 80_100 and tree.encoded - inserted <= 5 * 40
    assert max(len(pieces) for pieces, _, _ in tree.blocks) <= token_counts.BLOCK
    assert tree.n_tokens == len(library(BYTES)(tree.text))


def test_count_edits(docs, nothing):
    plain = library(BYTES)
    text = dict(enumerate(TEXTS)) | {100: "", None: "no id"}
    for r in token_counts.count_edits(docs, BYTES).collect():
        held = text[r.doc_id]
        assert r.n_tokens == len(plain(held))
        for a, b, new in token_counts.standard_edits(len(held)):
            held = held[:a] + new + held[max(a, b) :]
        assert (r.edited_chars, r.edited_tokens) == (len(held), len(plain(held)))
    assert token_counts.count_edits(nothing, BYTES).count() == 0
