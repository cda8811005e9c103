"""Runs of periodic words by Kolpakov and Kucherov: every maximal stretch that repeats with a period.

A text's words become numbers.  A suffix automaton gives the Lempel-Ziv factors, each with an
earlier occurrence; Main's extensions to either side of each border of two factors find the runs
that cross or touch it; runs inside a factor are copies of those in its earlier occurrence.  All of
it takes time in proportion to the words.

Every word of a run of at least ``2 SEED`` words lies in ``SEED`` words in a row that stand elsewhere
in the run as well.  So words that are in no such repeat part the text into stretches which runs do
not leave, and stretches again, until nothing more parts; texts without repeats have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Least words of a run, and words in a row that stand twice in each.
LEAST = 12
SEED = LEAST // 2
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that can hold runs; equal words have equal codes."""
    found, todo = [], [(0, len(codes))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        n = b - a - SEED + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(SEED):
            mixed = (mixed ^ codes[a + k : a + k + n]) * _STEP
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed, kind="stable")
        same = mixed[order[1:]] == mixed[order[:-1]]
        if not same.any():
            continue
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        marks = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + SEED, -1)
        inside = np.cumsum(marks[:-1]) > 0
        if inside.all():
            found.append((a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        todo += [(a + s, a + e) for s, e in edges.reshape(-1, 2).tolist()]
    return sorted(found)


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors (start, end, start of an earlier occurrence or -1) by a suffix automaton.

    An occurrence may overlap its factor.  A state keeps its first way on in lists and others, which
    few states have, in a dictionary.
    """
    length, link, first_end, letter, to = [0], [-1], [-1], [-1], [-1]
    more: dict[int, dict[int, int]] = {}

    def step(state: int, c: int) -> int:
        if letter[state] == c:
            return to[state]
        return more[state].get(c, -1) if state in more else -1

    def lead(state: int, c: int, target: int) -> None:
        if letter[state] in (-1, c):
            letter[state], to[state] = c, target
        else:
            more.setdefault(state, {})[c] = target

    last = 0
    for i, c in enumerate(word):
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        first_end.append(i)
        letter.append(-1)
        to.append(-1)
        p = last
        while p >= 0 and step(p, c) < 0:
            lead(p, c, now)
            p = link[p]
        if p >= 0:
            q = step(p, c)
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first_end.append(first_end[q])
                letter.append(letter[q])
                to.append(to[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0 and step(p, c) == q:
                    lead(p, c, twin)
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    found, at = [], 0
    while at < len(word):
        state, end, before = 0, at, -1
        while end < len(word):
            state = step(state, word[end])
            if first_end[state] == end:  # nowhere earlier
                break
            before = first_end[state]
            end += 1
        found.append((at, max(end, at + 1), before - (end - at) + 1 if end > at else -1))
        at = found[-1][1]
    return found


def prefix_lengths(word: list[int]) -> list[int]:
    """How much of the word's beginning stands at each place (Z-function)."""
    n = len(word)
    z = [0] * n
    if n:
        z[0] = n
    a = b = 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def runs(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and two periods, by start and period."""
    n = len(word)
    at_start: dict[int, dict[int, int]] = {}  # start -> end -> period

    def keep(start: int, end: int, period: int) -> None:
        if end - start >= max(least, 2 * period) and (end == n or word[end] != word[end - period]) and (start == 0 or word[start - 1] != word[start - 1 + period]):
            ends = at_start.setdefault(start, {})
            ends[end] = min(period, ends.get(end, period))

    parts = factors(word)
    before = 0
    for b, c, earlier in [*parts, (n, n, -1)]:
        left, right = word[max(0, b - 2 * before - (c - b)) : b], word[b:c]
        size, width = len(left), len(right)
        if size + width >= least:
            back = left[::-1]
            onward = prefix_lengths(right)
            to_left = prefix_lengths([*back, -1, *right[::-1], *back])
            for period in range(1, width + 1):  # the stretch equal to the one a period on touches the border
                lead = min(to_left[size + 1 + width - period], size)
                follow = onward[period] if period < width else 0
                if lead + follow >= period:
                    keep(b - lead, b + follow + period, period)
            across = prefix_lengths([*right, -1, *left, *right])
            lasting = prefix_lengths(back)
            for period in range(1, size + 1):  # or the one equal to a period before
                lead = lasting[period] if period < size else 0
                follow = min(across[width + 1 + size - period], width)
                if lead + follow >= period:
                    keep(b - period - lead, b + follow, period)
        if earlier >= 0:
            shift = b - earlier
            for start in range(earlier + 1, c - shift):
                for end, period in list(at_start.get(start, {}).items()):
                    if end < c - shift:
                        at_start.setdefault(start + shift, {})[end + shift] = period
        before = c - b
    return sorted((s, e - s, p) for s, ends in at_start.items() for e, p in ends.items())


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start and period."""
    found = []
    if len(words) >= LEAST:
        codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        for a, b in stretches(codes):
            ids: dict[bytes, int] = {}
            found += [(a + s, k, p) for s, k, p in runs([ids.setdefault(w, len(ids)) for w in words[a:b]])]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run has beyond its first period."""
    if found:
        marks = [0] * (len(words) + 1)
        for start, length, period in found:
            marks[start + period] += 1
            marks[start + length] -= 1
        kept, depth = [], 0
        for word, mark in zip(words, marks):
            depth += mark
            if not depth:
                kept.append(word)
        words = kept
    return b" ".join(words)


_RUNS = "array<struct<start: long, length: long, period: long>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs`` (doc_id, text): runs (start, length, period) of words, and the text without repeats.

    Words stand between blanks and control characters 9 to 13; a run has at least 12 words and two
    periods, its smallest, and goes on to neither side.  Of equal starts the smaller period comes
    first.  Null and empty texts have no words, no runs and an empty collapsed text; rows with equal
    or null doc_id each give a row; texts of any length are read whole, in time and memory in
    proportion to the words; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                lists, texts = [], []
                for text in some.column("text").to_pylist():
                    words = (text or b"").split()
                    found = runs_of(words)
                    lists.append([{"start": s, "length": k, "period": p} for s, k, p in found])
                    texts.append(collapsed(words, found))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(lists, shape), pa.array(texts, pa.binary())], ["doc_id", "runs", "collapsed"])

    found = spread(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(run, f"doc_id {kind}, runs {_RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``find``'s rows.

    The four in the middle are of the longest run (of equally long ones, that of the least start,
    then period), and null without any.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.length"), F.col("best.period")
    milli = F.floor((length * 1000 - (length * 1000) % period) / period).cast("long")
    return named.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def looped(doc_id: Column, text: Column) -> Column:
    """A text made periodic, for one in ten of the doc_ids; others, and those without doc_id or words, stay.

    With h the crc32 of the decimal doc_id and g a tenth of it, where h ends in 0: each word from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def changed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        places = F.array(F.struct(a.alias("a"), p.alias("p")))
        looped = F.transform(places, lambda at: F.array_join(F.transform(words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, (at["a"] + (i - at["a"]) % at["p"]).cast("int")))), " "))
        return F.when(n > 0, F.get(looped, F.lit(0))).otherwise(F.lit(""))

    split = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(F.transform(split, changed), F.lit(0))).otherwise(text)
