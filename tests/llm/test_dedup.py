"""Fingerprints and near-duplicates against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from agora.llm import minhash, simhash
from agora.llm.common import components

SCHEMA = "doc_id long, text string, bits string, id int, component_id int, class_id int"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "b", 1, 2, 3) for i, t in pairs], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    out = []
    for k in range(40):
        text = prose(rng, rng.randint(1, 120))
        out.append((10 * k, text))
        if k % 4 == 0:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            out += [(10 * k + 1, " ".join(words)), (10 * k + 2, text.upper()), (10 * k + 3, text + "  \n")]
    out += [(900, ""), (901, None), (902, " \t\n"), (903, "É é"), (904, "É É"), (900, ""), (None, out[0][1]), (None, "alone and without an id at all here")]
    out.append((905, "x " * 60_000))
    rng.shuffle(out)
    return out


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_simhash_components(spark, pairs):
    prints = [plain_fingerprint(t) for _, t in pairs]
    roots = joined(len(pairs), [(a, b) for a in range(len(pairs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for root, (i, _) in zip(roots, pairs):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(pairs, prints, roots)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame(spark, pairs)).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("tile", [2048, 8])
def test_links_lose_nothing(spark, tile):
    rng = random.Random(3)
    found = {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(40):
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            found.add(x)
    found = [f - (1 << 64) if f >> 63 else f for f in found]
    got = {r.id: r.component for r in components(simhash.links(spark.createDataFrame([(f, f) for f in found], "id long, bits long"), 4, tile)).collect()}
    roots = joined(len(found), [(a, b) for a in range(len(found)) for b in range(a) if ((found[a] ^ found[b]) & ((1 << 64) - 1)).bit_count() <= 4])
    groups = {}
    for root, f in zip(roots, found):
        groups.setdefault(root, []).append(f)
    assert got == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}


def test_similar_finds_edited_copies(spark):
    rng = random.Random(6)
    pairs = []
    for k in range(60):
        words = prose(rng, 150).split()
        near = list(words)
        near[rng.randrange(150)] = "other"
        far = words[:60] + prose(rng, 90).split()
        pairs += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    pairs += [(500, None), (501, ""), (500, None), (None, "x")]
    got = [(r.doc_id, r.component_id) for r in simhash.similar(frame(spark, pairs)).collect()]
    assert len(got) == len(pairs)
    by = dict(got)
    assert all(by[3 * k + 1] == 3 * k for k in range(60)) and all(by[3 * k + 2] == 3 * k + 2 for k in range(60))
    assert by[500] == by[501] == 500


def shingle_set(text, n=5):
    words = text.split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def spread_pairs(rng, n=160):
    """Pairs of texts of similarity 0.6 to 0.98: the second has another end."""
    out = []
    for k in range(n):
        words = prose(rng, 100 + 2 * k).split()
        keep = int(len(words) * (0.76 + 0.22 * k / n))
        out.append((" ".join(words), " ".join(words[:keep] + prose(rng, len(words) - keep).split())))
    return out


def test_similar_links_no_pair_below_the_similarity(spark):
    made = spread_pairs(random.Random(11))
    by = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, [(2 * k + side, t) for k, both in enumerate(made) for side, t in enumerate(both)])).collect()}
    below = [k for k, both in enumerate(made) if jaccard(*both) < 0.8]
    near = [k for k in below if jaccard(*made[k]) > 0.7]
    assert len(near) > 20 and all(by[2 * k + 1] == 2 * k + 1 for k in below)
    assert all(by[2 * k + 1] == 2 * k for k, both in enumerate(made) if jaccard(*both) > 0.9)


def test_similar_ignores_repeats_and_finds_pairs_at_the_similarity(spark):
    rng = random.Random(12)
    pairs = []
    for k in range(20):
        words = prose(rng, 200).split()
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[50:64] * (20, 60)[k % 2]))]
    for k in range(20, 220):
        words = prose(rng, 84).split()  # 80 shingles, and 100
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + prose(rng, 20).split()))]
    assert all(jaccard(pairs[2 * k][1], pairs[2 * k + 1][1]) >= 0.8 for k in range(220))
    by = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, pairs)).collect()}
    assert all(by[2 * k + 1] == 2 * k for k in range(20))
    assert sum(by[2 * k + 1] == 2 * k for k in range(20, 220)) >= 199


@pytest.mark.parametrize("bits", [16, 20])
def test_similar_with_smaller_buckets(spark, bits):
    """More bits a bucket, as for more rows: more buckets, and pairs at 0.8 to 0.85 are still found."""
    rng, pairs = random.Random(14), []
    for k in range(220):
        words = prose(rng, 84).split()
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + prose(rng, 14 + k % 7).split()))]
    assert all(0.8 <= jaccard(pairs[2 * k][1], pairs[2 * k + 1][1]) <= 0.86 for k in range(220))
    by = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, pairs), bits=bits).collect()}
    assert sum(by[2 * k + 1] == 2 * k for k in range(220)) >= 216
    assert simhash.bits_for(1000) == 12 < simhash.bits_for(10**8) <= 24


def test_a_chain_of_similar_texts_is_one_component(spark):
    """Each text is similar to the next alone, so first meetings do not join them all."""
    words = prose(random.Random(15), 400).split()
    pairs = [(k, " ".join(words[9 * k : 9 * k + 100])) for k in range(30)]
    assert all(jaccard(pairs[k][1], pairs[k + 1][1]) >= 0.8 > jaccard(pairs[k][1], pairs[k + 2][1]) for k in range(28))
    got = simhash.similar(frame(spark, pairs)).collect()
    assert {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.first] == [0]
    assert {r.class_id for r in minhash.near_duplicates(frame(spark, pairs)).collect()} == {0}


def test_links_of_a_group_are_few():
    """A unit of near copies gives one link a row, not all pairs, and the exact comparison is that of plain sets."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 62, 5000))
    sets = [np.sort(rng.choice(base, rng.integers(1, 300) if k % 3 else 4900, replace=False)) for k in range(90)]
    for split in (0, 40):
        a, b = simhash.exact_links(np.arange(90), sets, split, 0.8)
        jac = lambda x, y: len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y]))
        pairs = [(x, y) for x in range(split or 90) for y in range(split or x + 1, 90) if jac(x, y) >= 0.8]
        want = joined(90, pairs)
        assert len({frozenset((want[x], want[y])) for x, y in zip(a, b)} - {frozenset((r,)) for r in want}) == 0
        assert len(a) == 90 - len(set(want)) and [g == h for g, h in zip(want, want)] and len(pairs) > len(a)
        assert len(set(joined(90, list(zip(a, b))))) == len(set(want))


def test_empty_tables(spark):
    nothing = frame(spark, [])
    assert simhash.near_duplicates(nothing).count() == simhash.similar(nothing).count() == minhash.compare_with_next(nothing).count() == minhash.near_duplicates(nothing).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}


def plain_signature(text):
    """The slots one by one, with Python's whole numbers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    least = [0xFFFFFFFF] * minhash.SLOTS
    for k in range(max(1, len(words) - 4) if words else 0):
        mixed = 0
        for word, by in zip(words[k : k + 5], minhash._MIX.tolist()):
            mixed = (mixed + (zlib.crc32(word.encode()) + 1) * by) % 2**64
        mixed ^= mixed >> 29
        x = (mixed * 0xBF58476D1CE4E5B9) % 2**64 >> 32
        least = [min(v, (a * x + b) % 2**32) for v, a, b in zip(least, minhash.A.tolist(), minhash.B.tolist())]
    return [v % 2**16 for v in least]


def hexed(slots):
    return b"".join(v.to_bytes(2, "little") for v in slots).hex()


def test_minhash_estimates():
    a = " ".join(f"w{k}" for k in range(300))
    b = " ".join(f"w{k}" for k in range(100, 400))
    assert abs(minhash.likeness(minhash.signature(a), minhash.signature(b)) - 196 / 396) < 0.15
    assert (minhash.signature("") == minhash.EMPTY).all() and (minhash.signature("A b") == minhash.signature("a  B")).all()


def test_compare_with_next(spark, pairs):
    got = minhash.compare_with_next(frame(spark, pairs).repartition(5)).collect()
    assert len(got) == len(pairs)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    order = sorted(((i, t or "") for i, t in pairs), key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        slots = [plain_signature(x) for x in (t, edited, following)]
        near = [sum(x == y for x, y in zip(slots[0], other)) / minhash.SLOTS for other in slots[1:]]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(slots[0]), hexed(slots[1]), *near))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in got}
    assert by[901].fingerprint == by[902].fingerprint and set(by[901].bands) == set(by[902].bands)
    assert len(by[903].bands) == minhash.BANDS and not set(by[903].bands) & set(by[902].bands)
    alone = minhash.compare_with_next(frame(spark, [(1, "one two three four five six")])).collect()
    assert alone[0].near_next == 1.0


def test_one_doc_id_for_all_rows_can_be_cut(spark):
    """Rows that share a doc_id, or have none, do not all meet in one range."""
    docs = frame(spark, [(7, prose(random.Random(k), 8)) for k in range(400)]).repartition(4)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(4, "doc_id", "h")
    assert keyed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300
    got = minhash.compare_with_next(docs).collect()
    assert len(got) == 400 and len({r.edited_sha256 for r in got}) == 400


def test_minhash_near_duplicates(spark):
    rng = random.Random(8)
    pairs = []
    for k in range(30):
        words = prose(rng, 200).split()
        near = list(words)
        near[5] = "other"
        pairs += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, prose(rng, 200))]
    by = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, pairs)).collect()}
    assert all(by[3 * k + 1] == 3 * k for k in range(30)) and all(by[3 * k + 2] == 3 * k + 2 for k in range(30))


def test_minhash_pairs_near_the_similarity_like_brute_force(spark):
    rng = random.Random(13)
    made = []
    for k in range(120):
        words = prose(rng, 204).split()  # 200 shingles, of which 156 to 164 of 200 are left in the other
        made.append((" ".join(words), " ".join(words[: 160 + k % 9] if k % 3 else words + prose(rng, 46 + k % 9).split())))
    assert {jaccard(*both) >= 0.8 for both in made} == {True, False} and all(0.78 <= jaccard(*both) <= 0.84 for both in made)
    by = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, [(2 * k + side, t) for k, both in enumerate(made) for side, t in enumerate(both)])).collect()}
    assert [by[2 * k + 1] == 2 * k for k in range(120)] == [jaccard(*both) >= 0.8 for both in made]


def test_stars_across_tiles():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 1 << 63, (40, 1), np.uint64)
    bits[20:] = bits[:20] ^ np.uint64(1)
    a, b = simhash.stars(np.arange(40), bits, 20, 4)
    assert {frozenset(x) for x in zip(a, b)} == {frozenset((k, k + 20)) for k in range(20)}
