"""Quality rules: counts over words and lines, then n-gram perplexity within bands of each language.

The model is a modified Kneser-Ney model of character 4-grams.  Spark counts the grams of every
document that passes the plain rules, with no least count; a gram is four 16-bit code units in one
64-bit key.  Contexts, discounts and interpolation are joins of the counted tables, so the model
grows with the corpus and stays in the shared folder.  Every gram that any document holds gets its
log probability there.  Grams of at least ``LEAST_SHARE`` of all occurrences, at most ``2 ** 22``
by construction, are sent to the tasks as sorted arrays of keys; each task looks its texts up in
them and hands the few rarer grams to a join with the whole table, so that every character counts.
A document is rejected if its mean log perplexity lies outside its language's band: the median of
the language's documents plus and minus a number of median absolute deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, text_or_empty, written

ORDER = 4
#: Grams of this share of all occurrences are sent to the tasks (2 ** 22 at most); the others are joined.
LEAST_SHARE = 2.0**-22
#: A task hands on its counts when it holds so many different grams (a bound on memory, not on results).
HELD_GRAMS = 1 << 22
#: How far a band reaches below and above the median, in median absolute deviations, and the least deviation (nats).
#: Labelled clean rows lie within 14.5 below and, but for two of 20544, 15 above; loops of common words lie below, noise above.
LOWER, UPPER, LEAST_MAD = 15.0, 15.0, 0.01
#: Bands of so many languages are sent to every task; more are joined.
BROADCAST_BANDS = 100_000

BLANKS, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
WINDOW = 8


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, 0, 0, 0
    word_chars = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > WINDOW:
        codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        n = len(words) - WINDOW + 1
        windows = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + n] ^ (codes[k : k + n] >> np.uint64(29)))
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(covered)[:-1]))
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def teaches(text: str, counts: tuple[int, int, int, int, int]) -> bool:
    """Whether the model learns from a text: it passes the plain rules, with few symbols and capitals."""
    n_words, word_chars, symbols, _, repeated = counts
    if fails(n_words, repeated) or 50 * symbols > n_words:
        return False
    raw = text.encode("utf-8", "surrogatepass")
    return 5 * (len(raw) - len(raw.translate(None, CAPITALS))) <= word_chars


def grams(text: str) -> np.ndarray:
    """The 64-bit key of each character with the three before it; a line break stands before the text.

    A character counts by the low 16 bits of its code point, so that those beyond U+FFFF share keys with others.
    """
    units = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    keys = units[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        keys |= units[ORDER - 1 - back : len(units) - back] << np.uint64(16 * back)
    return keys


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n, seen): occurrences in documents that teach, and in all; each task sums up before rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def merge(kind: bool) -> None:
            """Counts what waits; adds up the counts when there are many of them."""
            if waiting[kind]:
                counted[kind].append(np.unique(np.concatenate(waiting[kind]), return_counts=True))
                waiting[kind], size[kind] = [], 0
            if len(counted[kind]) > 16:
                shrink(kind)

        def shrink(kind: bool) -> None:
            if len(counted[kind]) > 1:
                keys, at = np.unique(np.concatenate([k for k, _ in counted[kind]]), return_inverse=True)
                counted[kind] = [(keys, np.bincount(at, np.concatenate([n for _, n in counted[kind]])).astype(np.int64))]

        def flushed(kind: bool) -> Iterator[pa.RecordBatch]:
            shrink(kind)
            for keys, n in counted[kind]:
                for at in range(0, len(keys), 1 << 16):
                    some = pa.array(n[at : at + (1 << 16)].astype(np.int64))
                    taught = some if kind else pa.array(np.zeros(len(some), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].view(np.int64)), taught, some], ["gram", "n", "seen"])
            counted[kind] = []

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                kind = teaches(text, base(text))
                waiting[kind].append(grams(text))
                size[kind] += len(waiting[kind][-1])
                if size[kind] > 1 << 21:
                    merge(kind)
                    if sum(len(k) for k, _ in counted[kind]) > HELD_GRAMS:
                        yield from flushed(kind)  # Spark adds up what a task counts in several goes
        for kind in (True, False):
            merge(kind)
            yield from flushed(kind)

    return docs.select(text_or_empty()).mapInArrow(run, "gram long, n long, seen long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _last(units: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * units) - 1)) if units else F.lit(0).cast("long")


def _discount(level: DataFrame) -> Column:
    """The discount of a gram by its count, from how many grams were counted once, twice, three and four times."""
    seen = level.agg(*(F.count_if(F.col("n") == c) for c in (1, 2, 3, 4))).first()
    y = seen[0] / max(1, seen[0] + 2 * seen[1])
    of = [min(max(c - (c + 1) * y * seen[c] / max(1, seen[c - 1]), 0.05), 0.95 * c) for c in (1, 2, 3)]
    return F.when(F.col("n") == 1, of[0]).when(F.col("n") == 2, of[1]).otherwise(of[2])


def _few(df: DataFrame, units: int) -> DataFrame:
    """Tables by one character have at most 65536 rows and are sent; others are joined."""
    return F.broadcast(df) if units <= 1 else df


def fit(docs: DataFrame) -> DataFrame:
    """(gram, seen, log): every gram of ``docs``, its occurrences and its log probability in the model."""
    counted = written(count_grams(docs), "grams")
    level, levels = counted.where("n > 0").select("gram", "n"), {}
    for k in range(ORDER, 0, -1):  # lower orders count the different grams that end so
        levels[k] = level = level if k == ORDER else written(level.groupBy(_last(k).alias("gram")).agg(F.count("*").alias("n")), "level")
    probs: dict[int, DataFrame] = {}
    contexts: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        taken = levels[k].withColumn("taken", _discount(levels[k])).withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts[k] = written(taken.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("back")), "contexts")
        both = taken.join(_few(contexts[k], k - 1), "context")
        if k == 1:
            both = both.withColumn("lower", F.lit(1 / 65536))
        else:
            both = both.withColumn("suffix", _last(k - 1)).join(_few(probs[k - 1].toDF("suffix", "lower"), k - 1), "suffix")
        probs[k] = written(both.select("gram", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("back") * F.col("lower")).alias("p")), "probabilities")
    # Grams that no teaching document has back off to the longest ending that one has.
    rest, log = counted.where("n = 0").select("gram", "seen"), F.lit(-16 * float(np.log(2)))
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            rest = rest.withColumn("_key", _last(k)).join(_few(probs[k].toDF("_key", f"p{k}"), k), "_key", "left").drop("_key")
        key = F.shiftrightunsigned(_last(k) if k < ORDER else F.col("gram"), 16)
        rest = rest.withColumn("_key", key).join(_few(contexts[k].select(F.col("context").alias("_key"), F.col("back").alias(f"back{k}")), k - 1), "_key", "left").drop("_key")
    for k in range(1, ORDER + 1):
        log = log + F.coalesce(F.log(f"back{k}"), F.lit(0.0))
        if k < ORDER:
            log = F.coalesce(F.log(f"p{k}"), log)
    known = counted.where("n > 0").select("gram", "seen").join(probs[ORDER], "gram").select("gram", "seen", F.log("p").alias("log"))
    model = written(known.unionByName(rest.select("gram", "seen", log.alias("log"))), "model")
    for gone in (counted, *levels.values(), *contexts.values(), *probs.values()):
        if gone is not levels[ORDER]:  # the highest level is a part of ``counted``
            forget(gone)
    return model


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def look_up(keys: np.ndarray, logs: np.ndarray, text: str) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum of the log probabilities of a text's grams that sorted ``keys`` have; the others and their counts."""
    held = grams(text)
    at = np.minimum(np.searchsorted(keys, held), max(0, len(keys) - 1))
    found = keys[at] == held if len(keys) else np.zeros(len(held), bool)
    return float(logs[at[found]].sum()), *np.unique(held[~found], return_counts=True)


def score(docs: DataFrame, model: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, lang, ``carried``, the counts, base_failed, log_perplexity) of every row; ``model`` has every gram of ``docs``."""
    types = dict(docs.dtypes)
    least = (model.agg(F.sum("seen")).first()[0] or 0) * LEAST_SHARE
    often = model.where(F.col("seen") >= least).select("gram", "log").toArrow()
    keys = often.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast((keys[order], often.column("log").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("text").to_pylist()
                counts = [base(t) for t in texts]
                found = [look_up(keys, logs, t) for t in texts]
                columns = [*map(batch.column, ("doc_id", "lang", *carried)), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(_COUNTS)))]
                columns += [pa.array([fails(c[0], c[4]) for c in counts]), pa.array([f[0] for f in found], pa.float64()), pa.array(map(len, texts), pa.int64())]
                columns += [pa.array([f[1].view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in made.fields])

    made = T.StructType.fromDDL(f"doc_id long, lang string, {''.join(f'`{c}` {types[c]}, ' for c in carried)}{', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, log_sum double, length long, rare array<long>, times array<long>")
    held = docs.select("doc_id", text_or_empty(), F.col("lang").cast("string"), *carried).mapInArrow(run, made)
    held = written(held.withColumn("_row", F.monotonically_increasing_id()), "looked-up")
    rare = held.select("_row", F.inline(F.arrays_zip(F.col("rare").alias("gram"), F.col("times").alias("times"))))
    rare = rare.toDF("_row", "gram", "times").join(model.where(F.col("seen") < least), "gram").groupBy("_row").agg(F.sum(F.col("log") * F.col("times")).alias("rest"))
    mean = F.when(F.col("length") > 0, -(F.col("log_sum") + F.coalesce("rest", F.lit(0.0))) / F.col("length")).otherwise(0.0)
    return held.join(rare, "_row", "left").select("doc_id", "lang", *carried, *_COUNTS, "base_failed", mean.alias("log_perplexity"))


def judge(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, ``carried``, the counts, base_failed, kept, log_perplexity) of every row of ``docs`` (doc_id, text, lang).

    Null and empty texts have no words and fail.  A null language is a language of its own.  Texts of
    any length are counted and scored whole.  Repeated rows each count and each give a row; other
    columns are ignored, whatever their names; an empty table gives no rows.  Medians are exact up
    to 10,000 documents of a language; of more, their rank may be off by a 10,000th, and so shift a
    little with the table's partitions.  A document on a bound is kept.
    """
    scored = written(score(docs, fit(docs), *carried).withColumn("lang", F.coalesce("lang", F.lit(""))), "scored")
    passed = scored.where("NOT base_failed")
    middle = written(passed.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")), "middles")
    few = middle.count() <= BROADCAST_BANDS
    side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    spread = passed.join(side(middle), "lang").groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000).alias("mad"))
    spread = written(spread.withColumn("mad", F.greatest("mad", F.lit(LEAST_MAD))), "bands")
    inside = F.col("log_perplexity").between(F.col("middle") - LOWER * F.col("mad"), F.col("middle") + UPPER * F.col("mad"))
    return scored.join(side(spread), "lang", "left").select("doc_id", *carried, *_COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity")
