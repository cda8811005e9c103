"""Toxicity: a linear model of character n-grams, regularised with counterfactual identity swaps.

The model is a logistic regression over the presence of n-grams within words, with weights of at
least zero: a text is as toxic as what it holds, however much else it says.  Identity terms are
always among the features.  In every sentence of the labelled documents every identity term is
swapped for each other one of its language and for nothing (or, where a sentence names none, put
in), and the squared change of the score is part of the loss, so that naming a group moves no score.  It learns
from a bounded sample of labelled rows, whose whole texts are taken apart in tasks; every whole
text is scored with one automaton over all its n-grams.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import map_rows, text_or_empty

#: At most so many labelled rows of either class are learnt from.
SAMPLE = 1200
#: Rows of a class of at least this shingle similarity are copies, and share the weight of one row.
COPY = 0.5
#: N-grams: lengths, the least number and share of toxic sample documents, the least log odds, and how many.
LENGTHS, LEAST_DOCS, LEAST_PART, LEAST_ODDS, FEATURES = (4, 6), 3, 0.015, 1.6, 4096
#: What a toxic row counts, as classes are sampled evenly but clean rows prevail.
TOXIC_WEIGHT = 0.7
#: Weights of the loss's parts, and steps.
L2, COUNTERFACTUAL, STEPS = 1e-4, 1.0, 300
THRESHOLD = 0.3

#: Identity terms that are swapped for one another, by language; a parameter of ``fit``.
IDENTITY_TERMS = {
    "en": ["women", "men", "muslim", "christian", "jewish", "black", "white", "asian", "gay", "straight", "transgender", "immigrant", "disabled", "elderly"],
    "de": ["frauen", "männer", "muslimisch", "christlich", "jüdisch", "schwarz", "weiß", "schwul", "hetero", "einwanderer", "behindert"],
    "fr": ["femmes", "hommes", "musulman", "chrétien", "juif", "noir", "blanc", "gay", "hétéro", "immigré", "handicapé"],
    "es": ["mujeres", "hombres", "musulmán", "cristiano", "judío", "negro", "blanco", "gay", "hetero", "inmigrante", "discapacitado"],
}
_NO_LETTERS = re.compile(r"[\W\d_]+")


def marked(text: str) -> str:
    """The text's words in lower case, each between marks."""
    return "<" + _NO_LETTERS.sub("><", text.lower()) + ">"


def word_grams(word: str) -> set[str]:
    """N-grams of a word between marks, and the word."""
    return {word[k : k + n] for n in LENGTHS for k in range(len(word) - n + 1)} | {word}


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learnt; false for a row without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Taken(NamedTuple):
    """A labelled text taken apart: its words, its MinHash signature, and its kinds of sentences with their numbers.

    A sentence's kind is the identity terms that it names and its other words that share an n-gram with one.
    """

    toxic: int
    words: frozenset[str]
    signature: bytes
    sentences: dict[tuple[tuple[str, ...], tuple[str, ...]], int]


def named_grams(terms: dict[str, list[str]]) -> set[str]:
    """The n-grams of all identity terms."""
    return {g for listed in terms.values() for term in listed for g in word_grams(f"<{term}>")}


def take_apart(text: str, toxic: int, terms: dict[str, list[str]] = IDENTITY_TERMS) -> Taken:
    known = {t for listed in terms.values() for t in listed}
    named = named_grams(terms)
    touching: dict[str, bool] = {}
    sentences: Counter[tuple[tuple[str, ...], tuple[str, ...]]] = Counter()
    every: set[str] = set()
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = set(marked(sentence)[1:-1].split("><")) - {""}
        if not words:
            continue
        every |= words
        for word in words:
            if word not in touching:
                touching[word] = not named.isdisjoint(word_grams(f"<{word}>"))
        near = [w for w in words if touching[w]]
        sentences[tuple(sorted(w for w in near if w in known)), tuple(sorted(w for w in near if w not in known))] += 1
    return Taken(toxic, frozenset(every), minhash.signature(text).tobytes(), dict(sentences))


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, terms: dict[str, list[str]] = IDENTITY_TERMS) -> list[Taken]:
    """At most ``each`` labelled texts of either class, those of least hash, taken apart; a doc_id counts once.

    Whole texts stay in the tasks: the driver gets their distinct words and kinds of sentences.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in (0, 1)]
    picked = some[0].unionByName(some[1]).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))  # at most twice ``each`` rows
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty()).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [take_apart(t, k, terms) for t, k in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
            kinds = [[{"named": list(a), "others": list(b), "n": n} for (a, b), n in sorted(x.sentences.items())] for x in made]
            names = pa.list_(pa.string())
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array([sorted(x.words) for x in made], names), pa.array([x.signature for x in made], pa.binary()), pa.array(kinds, pa.list_(pa.struct([("named", names), ("others", names), ("n", pa.int64())])))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "words", "signature", "sentences"])

        return step

    taken = map_rows(rows, make, "doc_id long, toxic int, words array<string>, signature binary, sentences array<struct<named:array<string>,others:array<string>,n:long>>", 16)
    found = taken.toArrow().sort_by("doc_id")
    out = []
    for batch in found.to_batches(max_chunksize=64):  # as Python values a few rows at a time, words that rows share once
        for r in batch.to_pylist():
            out.append(Taken(r["toxic"], frozenset(map(sys.intern, r["words"])), r["signature"], {(tuple(x["named"]), tuple(x["others"])): x["n"] for x in r["sentences"]}))
    return out


class Toxicity:
    """N-grams with weights and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.automaton = self._automaton()

    def _automaton(self):
        made = ahocorasick.Automaton()
        for gram, weight in self.weights.items():
            made.add_word(gram, (gram, weight))
        if self.weights:
            made.make_automaton()
        return made

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str) -> float:
        found = dict(x for _, x in self.automaton.iter(marked(text))) if self.weights else {}
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(found.values()), -30, 30))))


def copy_weights(rows: list[Taken]) -> np.ndarray:
    """A weight for each row: near copies of one class share the weight of one row, so that their chance words do not count more."""
    group, sizes = [], Counter()
    kept = {k: (np.empty((len(rows), minhash.SLOTS), minhash.SLOT), []) for k in {r.toxic for r in rows}}
    for at, row in enumerate(rows):
        signed, (signatures, firsts) = np.frombuffer(row.signature, minhash.SLOT), kept[row.toxic]
        alike = np.flatnonzero(np.count_nonzero(signatures[: len(firsts)] == signed, axis=1) >= COPY * minhash.SLOTS)
        if not len(alike):
            signatures[len(firsts)] = signed
            firsts.append(at)
        group.append(firsts[alike[0]] if len(alike) else at)
        sizes[group[-1]] += 1
    return np.array([1 / sizes[g] for g in group])


def swap_matrix(rows: list[Taken], weights: np.ndarray, terms: dict[str, list[str]], place: dict[str, int]) -> np.ndarray:
    """The matrix Q over features such that ``w @ Q @ w`` is the mean squared change of the score by swaps.

    Each sentence counts once (by its row's weight); its swaps have equal shares: each of its terms
    for each other one of the term's languages and for nothing or, where it names none, any term
    put in and any two terms of one language in the place of one another.
    """
    own = {t: {place[g] for g in word_grams(f"<{t}>") if g in place} for t in {t for listed in terms.values() for t in listed}}
    touched: dict[str, set[int]] = {}
    kinds: defaultdict[tuple[tuple[str, ...], frozenset[int]], float] = defaultdict(float)
    for row, weight in zip(rows, weights.tolist()):
        for (named, others), n in row.sentences.items():
            for word in others:
                if word not in touched:
                    touched[word] = {place[g] for g in word_grams(f"<{word}>") if g in place}
            kinds[named, frozenset().union(*(touched[w] for w in others))] += n * weight
    whole = sum(kinds.values()) or 1
    put_in = [(None, a) for a in own] + [(a, b) for listed in terms.values() for k, a in enumerate(listed) for b in listed[:k]]
    changes: defaultdict[tuple[frozenset[int], frozenset[int]], float] = defaultdict(float)
    for (named, still), n in kinds.items():
        swaps = [(a, b) for a in named for b in [None, *(b for listed in terms.values() if a in listed for b in listed if b != a)]] or put_in
        for a, b in swaps:
            rest = still.union(*(own[w] for w in named if w != a))
            before, after = (own[w] if w else set() for w in (a, b))
            changes[frozenset(before - after - rest), frozenset(after - before - rest)] += n / len(swaps) / whole
    q = np.zeros((len(place), len(place)))
    for (less, more), share in changes.items():
        at, sign = np.array([*less, *more], np.int64), np.array([-1.0] * len(less) + [1.0] * len(more))
        q[np.ix_(at, at)] += np.outer(sign, sign) * share
    return q


def loss_and_gradient(weights: np.ndarray, bias: float, x: np.ndarray, labels: np.ndarray, each: np.ndarray, q: np.ndarray, counterfactual: float) -> tuple[float, np.ndarray, float]:
    """The loss, and its slopes by the weights and by the bias: cross-entropy, squared weights, squared changes by swaps."""
    z = np.clip(x @ weights + bias, -30, 30)
    error = each * (1 / (1 + np.exp(-z)) - labels)
    loss = each @ (np.logaddexp(0, z) - labels * z) + L2 * weights @ weights + counterfactual * weights @ q @ weights
    return float(loss), x.T @ error + 2 * L2 * weights + 2 * counterfactual * (q @ weights), float(error.sum())


def fit(rows: list[Taken], terms: dict[str, list[str]] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Toxicity:
    """The model of labelled texts; without rows of both classes it scores every text alike."""
    labels = np.array([r.toxic for r in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        return Toxicity({}, 3.0 if len(rows) and labels[0] else -3.0)
    shares = copy_weights(rows)
    n = [float(shares[labels == k].sum()) for k in (0, 1)]
    toxic = np.flatnonzero(labels == 1)
    number: defaultdict[str, int] = defaultdict(lambda: len(number))

    def numbered(known: dict[str, int], several: Iterable[Taken]) -> list[np.ndarray]:
        """The numbers of the n-grams of each row's words, as far as they are known."""
        memo: dict[str, np.ndarray] = {}
        out = []
        for row in several:
            for word in row.words:
                if word in memo:
                    continue
                grams = word_grams(f"<{word}>")
                memo[word] = np.array([known[g] for g in grams if known is number or g in known], np.int64)
            out.append(np.unique(np.concatenate([memo[w] for w in row.words])) if row.words else np.empty(0, np.int64))
        return out

    def counted(held: list[np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
        """By n-gram, the weight of the rows ``at`` that hold it."""
        return np.bincount(np.concatenate([*held, np.empty(0, np.int64)]), np.repeat(shares[at], [len(x) for x in held]), size)

    held = numbered(number, (rows[k] for k in toxic.tolist()))
    seen = counted(held, toxic, len(number))
    always = sorted(f"<{t}>" for t in {t for listed in terms.values() for t in listed})
    often = seen >= max(LEAST_DOCS, LEAST_PART * n[1])
    known = {g: k for k, g in enumerate(dict.fromkeys([*(g for g, k in number.items() if often[k]), *always]))}
    number.clear()
    held = numbered(known, rows)
    seen = [counted([held[k] for k in at.tolist()], at, len(known)) for at in (np.flatnonzero(labels == 0), toxic)]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    chosen = sorted((g for g, k in known.items() if odds[k] >= LEAST_ODDS), key=lambda g: (-seen[1][known[g]] * odds[known[g]], g))[:FEATURES]
    place = {g: k for k, g in enumerate(dict.fromkeys([*chosen, *always]))}
    of = np.array([place.get(g, -1) for g in known], np.int64)
    x = np.zeros((len(rows), len(place)))
    for row, grams in enumerate(held):
        x[row, of[grams][of[grams] >= 0]] = 1
    q = swap_matrix(rows, shares, terms, place)
    weights, bias = np.zeros(len(place)), -2.0
    each = np.where(labels == 1, TOXIC_WEIGHT, 1.0) * shares / shares.sum()
    m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        _, slope, slope_bias = loss_and_gradient(weights, bias, x, labels, each, q, counterfactual)
        both = np.append(slope, slope_bias)
        m, v = 0.9 * m + 0.1 * both, 0.999 * v + 0.001 * both**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = np.maximum(weights - move[:-1], 0), bias - move[-1]
    return Toxicity({g: float(weights[k]) for g, k in place.items() if abs(weights[k]) > 1e-3}, float(bias))


def score(docs: DataFrame, model: Toxicity, *carried: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text), with the columns ``carried``.

    Null texts score as the empty text; texts of any length are scored whole.  Repeated rows each
    give a row; an empty table gives none; other columns are ignored, whatever their names.
    """
    sent, types = docs.sparkSession.sparkContext.broadcast(model), dict(docs.dtypes)

    def make():
        known = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [known.score(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(batch.column, carried), pa.array(scores, pa.float64())], ["doc_id", *carried, "score"])

        return step

    scored = map_rows(docs.select("doc_id", *carried, text_or_empty()), make, ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in carried), "score double"]))
    return scored.select("doc_id", *carried, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def judge(docs: DataFrame, labels: DataFrame, *carried: str) -> DataFrame:
    """``score`` of all ``docs`` by the model of a sample of the labelled ones.

    Labels without doc_id or class teach nothing; of contradicting labels of a doc_id, toxic wins.
    """
    return score(docs, fit(sample(docs, labels)), *carried)
