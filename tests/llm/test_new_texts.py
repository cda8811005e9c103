"""Decontamination and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import decontamination, queries, runs
from agora.llm.common import table

DOCS = "doc_id long, text string, item_id long, raw string, spans int, words int, n_words int, runs int, collapsed int"


def docs_of(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 1, 1, 1, 1, 1) for i, t in rows], DOCS)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, length=10):
    windows = {}
    for name, text in items:
        words = plain_words(text)
        size = min(length, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(name)
    rows = []
    for doc_id, text in docs:
        words, hit, who = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if found := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    who |= found
        who = sorted(str(w) for w in who if w is not None)
        rows.append((doc_id, len(words), len(hit), len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=repr)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then sleeps until noon"),
    (2, "quick brown fox jumps over the lazy dog and then SLEEPS until morning comes"),
    (2, "another part of item two with exactly ten words here"),
    (3, "short one"),
    (4, ""),
    (5, None),
    (None, "an item without any id that still has more than ten words in it"),
    (10, "short one"),
    (7, "ñandú élan 42 ½ Straße " * 4),
]
TEXTS = [
    (1, "Say: the quick, brown fox -- jumps over the lazy dog AND then sleeps until noon!"),
    (1, "Say: the quick, brown fox -- jumps over the lazy dog AND then sleeps until noon!"),
    (2, "the quick brown fox jumps over the lazy cat and then sleeps until noon"),
    (3, "a short one, and a SHORT\none"),
    (4, None),
    (5, ""),
    (6, "... !!!"),
    (None, "an item without any id that still has more than ten words"),
    (8, "42 ½ Straße ñandú élan 42 ½ Straße ñandú élan 42 ½"),
    (9, "word " * 5000 + "another part of item two with exactly ten words here " * 3 + "word " * 70000),
]


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 20])
def test_contamination(spark, block_words, monkeypatch):
    monkeypatch.setattr(decontamination.scanned, "__defaults__", (decontamination.WORDS, block_words, True))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("name", F.lit(1))
    found = decontamination.contamination(docs_of(spark, TEXTS), items)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_contamination(TEXTS, ITEMS)


def test_contamination_of_random_texts(spark):
    draw = random.Random(5)
    some = lambda n: " ".join(draw.choice("ab") for _ in range(n))
    items, docs = [(k, some(draw.choice([0, 1, 5, 9, 10, 11, 14]))) for k in range(12)], [(k, some(draw.randrange(60))) for k in range(80)]
    found = decontamination.contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_contamination(docs, items)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontamination, "window_hashes", lambda ids, starts, length: np.zeros(len(starts), np.uint64))
    rows = pa.table({"name": ["a", "b"], "words": pa.array([[b"x", b"y"], [b"y", b"z"]], pa.list_(pa.binary())), "whole": [True, True]})
    block = decontamination.block_of(rows, 2)
    spans, who = decontamination.hits([b"x", b"y", b"x", b"z", b"y", b"z"], block)
    assert spans.tolist() == [[0, 2], [4, 6]] and sorted(who) == ["a", "b"]


def test_long_items_are_cut_without_losing_windows(spark):
    text = " ".join(f"w{k}" for k in range(1000))
    cut = decontamination.pieces(spark.createDataFrame([(1, text)], "item_id long, text string"), 10, 64).collect()
    assert all(len(r.words) <= 73 and not r.whole for r in cut)
    windows = {tuple(bytes(w) for w in r.words[k : k + 10]) for r in cut for k in range(len(r.words) - 9)}
    assert len(windows) == 991


def test_decontaminate(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, TEXTS)
    spans = {(r.doc_id, r.text) for r in decontamination.decontaminate(docs, items).collect()}
    assert (1, "Say: !") in spans and (3, "a , and a ") in spans and (4, None) in spans and TEXTS[2] in spans
    left = decontamination.decontaminate(docs, items, "documents")
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6] and left.columns == ["doc_id", "text"]
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "nothing")


def test_contamination_of_nothing(spark):
    docs, items = docs_of(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert not decontamination.contamination(docs, items.limit(0)).where("contaminated OR n_items > 0").count()


def test_contamination_query(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    found = queries.op12_decontamination(spark, sf_dir)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_contamination(docs, items)


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text, loop=True):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if loop and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def random_word(draw):
    n = draw.randrange(90)
    word = [draw.randrange(draw.choice([1, 2, 3, 10])) for _ in range(n)]
    for _ in range(draw.randrange(5) if n > 4 else 0):
        a, p = draw.randrange(n), draw.randint(1, 12)
        for i in range(a + p, draw.randint(a, n)):
            word[i] = word[i - p]
    return word


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    draw = random.Random(seed)
    for _ in range(250):
        word = random_word(draw)
        assert runs.runs(word, 2) == plain_runs(word, 2)
        assert runs.runs(word) == plain_runs(word) == runs.runs_of([str(w).encode() for w in word])


def test_runs_of_words_with_many():
    word, longer = [0], [0, 1]
    while len(longer) < 1500:
        word, longer = longer, longer + word
    assert runs.runs(longer) == plain_runs(longer)
    assert runs.runs([0] * 5000) == [(0, 5000, 1)]


def test_factors():
    assert runs.factors([0, 1, 0, 1, 0, 2]) == [(0, 1, -1), (1, 2, -1), (2, 5, 0), (5, 6, -1)]
    assert runs.factors([]) == []


def test_stretches_hold_all_runs():
    draw = random.Random(3)
    for _ in range(300):
        word = random_word(draw)
        spans = runs.stretches(np.array(word, np.uint64))
        assert all(any(a <= s and s + m <= b for a, b in spans) for s, m, _ in plain_runs(word))


TEXTS13 = [(k, " ".join(f"w{(k * j) % 31}" for j in range(90))) for k in range(60)] + [
    (1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r"), (None, "x " * 40), (6, "ñ é ñ é " * 8), (7, "a b c d e f " * 2), (8, "a b c d e " * 2), (9, "q\x1cr " * 20000), (5, "one\ntwo\tthree four five six seven " * 3 + "tail"),
]


@pytest.mark.parametrize("loop", [True, False])
def test_runs(spark, loop):
    docs = docs_of(spark, TEXTS13)
    given = docs.withColumn("text", runs.looped(F.col("doc_id"), F.col("text"))) if loop else docs
    found = runs.digests(runs.find(given))
    plain = [(i, t) for i, t in TEXTS13 if len(t or "") < 20000]
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert sorted((plain_row(*x, loop) for x in plain), key=repr) == [r for r in rows if r[0] != 9 or r[3] not in (20000, 39999)]
    assert [r[1:6] for r in rows if r[0] == 9 and r[3] == 20000] == [(1, 0, 20000, 1, 20000000)]


def test_runs_of_nothing(spark):
    assert runs.find(docs_of(spark, TEXTS13).limit(0)).count() == 0
    assert {r.collapsed for r in runs.find(docs_of(spark, [(1, "a b " * 9), (2, None)])).collect()} == {"a b", ""}


def test_runs_query(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    short = {i: t for i, t in docs if len(t or "") < 9000}
    found = sorted((tuple(r) for r in queries.op13_runs(spark, sf_dir).collect() if r.doc_id in short), key=repr)
    assert found == sorted((plain_row(*x) for x in short.items()), key=repr) and any(r[1] for r in found)
