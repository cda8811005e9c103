"""SimHash near-dedup: linking of fingerprints within a Hamming radius, tile by tile.

``near_duplicates`` is exact for fingerprints of 64 bits and a small radius.  Distinct fingerprints alone are compared, so copies cost nothing.  A fingerprint is cut into
blocks; two fingerprints within the radius agree on at least ``blocks - radius`` of them, so they
meet in a bucket of some choice of that many blocks.  Within a bucket fingerprints lie in tiles by
population count.  Tile pairs whose counts differ by more than the radius are skipped; the others
are compared bit by bit with numpy.  Buckets too large for one task are dealt out as tile pairs.

A Jaccard similarity of 0.8 leaves 64-bit fingerprints about ten bits apart, which no small radius
reaches and where chance pairs begin.  ``similar`` takes fingerprints of 320 bits instead, from the
hashes of its distinct shingles, and looks for candidates within 88 bits in buckets of some equal
bits.  How many bits a bucket has follows the number of rows, so that buckets stay small; how many
buckets there are follows that, so that a pair at exactly 0.8 shares one with a chance of 0.99 or
more (simulated: 0.9987 of 12 bits, 0.9913 of 24; nearer pairs more).  What candidates join
is a group, whose sets of shingles come together; those of a Jaccard similarity of 0.8 or more are links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forget, groups, map_rows, row_hash, sent_if_small, text_or_empty, written

SEED = 42
#: Rows of a tile: at most two of them meet in a task at once.
TILE = 2048
#: Fingerprints that a bucket should hold about, from which the number of blocks follows.
BUCKET = 512


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of a text's shingles; of a text with fewer words, of all its words; none without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    line = b" ".join(found)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in found)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[words:])]


def _majority(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits: a bit is 1 if over half the shingles' XXH64 have it.  A text without words has 0."""
    hashes = shingle_hashes(text, words)
    return _majority(np.array(hashes, np.uint64)) if hashes else 0


def distinct_hashes(text: str, words: int) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once however often it occurs."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def wide_fingerprint(hashes: np.ndarray, parts: int) -> list[int]:
    """``parts`` fingerprints of 64 bits from the same hashes, each with them mixed in another way."""
    out = []
    for part in range(parts):
        mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * part) & 0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(mixed ^ (mixed >> np.uint64(31))) if len(hashes) else 0)
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, bits: long) of every whole text; null texts are empty."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "bits"])

        return step

    return map_rows(docs.select("doc_id", text_or_empty()), make, "doc_id long, bits long")


def choices(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` blocks of the 64 bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in itertools.combinations(block, blocks - radius)]


def blocks_for(rows: int, radius: int) -> int:
    """So many blocks that evenly spread fingerprints make buckets of about ``BUCKET`` rows.

    Any number finds the same links; a larger one makes more, smaller buckets.
    """
    for blocks in range(radius + 1, radius + 5):
        if rows / 2 ** (64 * (blocks - radius) / blocks) <= BUCKET:
            break
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked(ids: np.ndarray, near: dict[int, list[np.ndarray]]) -> tuple[list, list]:
    """Links that join what rows near each other join: each row with the least id of its kind; ``near`` goes both ways."""
    seen = np.zeros(len(ids), bool)
    out_a, out_b = [], []
    for start in near:
        if seen[start]:
            continue
        seen[start] = True
        members, at = [start], 0
        while at < len(members):
            for some in near.get(members[at], ()):
                fresh = some[~seen[some]]
                seen[fresh] = True
                members.extend(fresh.tolist())
            at += 1
        mine = ids[members]
        least = int(mine.min())
        mine = mine[mine != least]
        out_a.extend(mine.tolist())
        out_b.extend([least] * len(mine))
    return out_a, out_b


def stars(ids: np.ndarray, bits: np.ndarray, split: int, radius: int) -> tuple[list, list]:
    """Links that connect what lies within the radius: each row with the least of its kind.

    ``bits`` has a row of 64-bit parts for each id.  Rows before ``split`` and from it on are two
    tiles whose pairs across are compared; where ``split`` is 0 all pairs are.  Steps over pairs of
    smaller tiles, sorted by population count.
    """
    n, step = len(bits), 512
    counts = np.bitwise_count(bits).sum(axis=1, dtype=np.int16)
    order = np.argsort(counts, kind="stable") if not split else np.concatenate([np.argsort(counts[:split], kind="stable"), split + np.argsort(counts[split:], kind="stable")])
    bits, ids, counts = bits[order], ids[order], counts[order]
    near: dict[int, list[np.ndarray]] = {}
    left, right = (range(0, n, step), range(0, n, step)) if not split else (range(0, split, step), range(split, n, step))
    for a in left:
        a_end = min(a + step, split or n)
        for b in right:
            b_end = min(b + step, n)
            if not split and b < a:
                continue
            if counts[b] > counts[a_end - 1] + radius or counts[b_end - 1] < counts[a] - radius:
                continue
            apart = np.zeros((a_end - a, b_end - b), np.int16)
            for part in range(bits.shape[1]):
                apart += np.bitwise_count(bits[a:a_end, None, part] ^ bits[None, b:b_end, part])
            close = apart <= radius
            if not split and a == b:
                np.fill_diagonal(close, False)
            for row in np.flatnonzero(close.any(axis=1)).tolist():
                near.setdefault(a + row, []).append(b + np.flatnonzero(close[row]))
            if split or a != b:
                for row in np.flatnonzero(close.any(axis=0)).tolist():
                    near.setdefault(b + row, []).append(a + np.flatnonzero(close[:, row]))
    return linked(ids, near)


def links(found: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b) over the ids of distinct ``found`` (id, bits: long) that connect all within the radius.

    Exact: no link between different components' fingerprints is made, none within is lost.
    """
    masks = choices(blocks_for(found.count(), radius), radius)
    parts = F.array(*(F.col("bits").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks))
    keyed = found.select("id", F.array("bits").alias("bits"), F.bit_count("bits").alias("ones"), F.posexplode(parts).alias("choice", "part"))
    return _linked(keyed.select(F.xxhash64("choice", "part").alias("bucket"), "ones", "id", "bits"), radius, tile)


def dealt(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows (bucket, ones, id, bits, ...) dealt into units of work: (unit, side, id, bits, ...), sorted by unit and side.

    A bucket is one unit, its rows of side 0.  One of over ``tile`` rows is cut into tiles by ``ones``
    and a hash; each pair of tiles whose ``ones`` differ by at most ``radius`` is a unit, with sides
    1 and 2, and so is each tile, with side 0.
    """
    sizes = keyed.groupBy("bucket", "ones").agg(F.count("*").alias("n"))
    large = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("by_ones")).where(F.col("all") > tile)
    large = written(large, "large-buckets")
    joined = keyed.join(large, "bucket", "left")

    def parts(ones: Column) -> Column:
        """How many tiles the rows with this population count have in their bucket."""
        return F.ceil(F.element_at("by_ones", ones) / tile).cast("int")

    own = F.struct(F.col("ones"), F.pmod(F.xxhash64("id"), parts(F.col("ones"))).cast("int").alias("part"))
    others = F.flatten(F.transform(F.filter(F.map_keys("by_ones"), lambda o: F.abs(o - F.col("ones")) <= radius), lambda o: F.transform(F.sequence(F.lit(0), parts(o) - 1), lambda p: F.struct(o.alias("ones"), p.cast("int").alias("part")))))
    units = joined.withColumn("own", F.when(F.col("all").isNotNull(), own)).withColumn("other", F.explode(F.when(F.col("all").isNotNull(), others).otherwise(F.array(F.lit(None).cast("struct<ones:int,part:int>")))))
    unit = F.when(F.col("own").isNull(), F.xxhash64("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    units = units.select(unit.alias("unit"), F.when(F.col("own").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), *(c for c in keyed.columns if c not in ("bucket", "ones")))
    return units.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit", "side")


def _linked(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """Links among the rows (bucket, ones, id, bits: array) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "unit"):
            if rows.num_rows < 2:
                continue
            side = rows.column("side").to_numpy()
            ids = rows.column("id").to_numpy()
            bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            a, b = stars(ids, bits, int(np.count_nonzero(side == 1)) if side[0] else 0, radius)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt(keyed, radius, tile).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows each give a
    row.  A row without doc_id keeps its fingerprint and joins its component, but names none: a
    component of such rows alone has a null id.  Texts of any length are read whole; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    prints = written(fingerprints(docs, words), "simhash")
    distinct = written(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    # components are found over fingerprints themselves: a bijection of the 64 bits serves as id
    joined = components(written(links(distinct.select(F.col("bits").alias("id"), "bits"), radius), "links")).withColumnsRenamed({"id": "bits"})
    classes = distinct.join(joined, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    named = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), "components")  # a plain join on a hot component can be split
    classes = classes.join(named, "component").select("bits", "component_id")
    return prints.join(written(classes, "classes"), "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


#: Parts of a wide fingerprint, and how many bits candidates may differ in.
PARTS, WIDE_RADIUS = 5, 88
#: Of pairs at exactly 0.8: the share of equal bits that most have at least, and the chance of no shared bucket that is left.
EQUAL_BITS, MISSED = 0.84, 0.002
#: The least Jaccard similarity of the shingle sets of a link.
SIMILARITY = 0.8


def bits_for(rows: int) -> int:
    """The bits of a bucket, from 12 to 24, at which evenly spread fingerprints fill it with about ``BUCKET`` rows."""
    return min(24, max(12, (rows // BUCKET).bit_length()))


def places_for(bits: int) -> np.ndarray:
    """The bits of each bucket: all of a fingerprint's but a remainder, dealt out as often as the chance needs."""
    deals = np.random.default_rng(42)
    each = 64 * PARTS // bits
    times = math.ceil(math.log(MISSED) / math.log(1 - EQUAL_BITS**bits) / each)
    return np.concatenate([deals.permutation(64 * PARTS)[: each * bits].reshape(-1, bits) for _ in range(times)])


def bucket_keys(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(rows, buckets): the bits of each bucket of fingerprints of ``PARTS`` parts, as a number."""
    single = np.unpackbits(np.ascontiguousarray(bits).astype(">u8").view(np.uint8).reshape(-1, 8 * PARTS), axis=1)
    out = np.zeros((len(single), len(places)), np.int64)
    for k in range(places.shape[1]):
        out = out * 2 + single[:, places[:, k]]
    return out


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles: array<long>) of every row: its distinct shingles' hashes, sorted, and their hash."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [distinct_hashes(t, words) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in made], pa.int64()), pa.array([x.view(np.int64) for x in made], pa.list_(pa.int64()))], ["id", "shingles"])

        return step

    return map_rows(docs.select(text_or_empty()), make, "id long, shingles array<long>")


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of hashes."""
    found = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return found - (1 << 64) if found >> 63 else found


def shared_counts(sets: list[np.ndarray], split: int, step: int = 4096) -> np.ndarray:
    """How many elements each two of some sorted sets share: of all, or of those before ``split`` with those from it on.

    Elements of one set alone are left out; the others are columns of 0 and 1, multiplied ``step`` at a time.
    """
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[often] = np.arange(len(often))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = split or len(sets)
    out = np.zeros((n, len(sets) - split), np.int64)
    for at in range(0, len(often), step):
        a, b = np.searchsorted(column, [at, at + step])
        held = np.zeros((len(sets), min(step, len(often) - at)), np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += (held[:n] @ held[split:].T).astype(np.int64)
    return out


def exact_links(ids: np.ndarray, sets: list[np.ndarray], split: int, similarity: float) -> tuple[list, list]:
    """Links that join all rows whose sets have at least this Jaccard similarity; ``split`` is as in ``stars``."""
    sizes = np.array([len(x) for x in sets])
    shared = shared_counts(sets, split)
    n = split or len(sets)
    whole = sizes[:n, None] + sizes[None, split:] - shared
    close = (shared >= similarity * whole) & (whole > 0)
    if not split:
        np.fill_diagonal(close, False)
    near: dict[int, list[np.ndarray]] = {}
    for k in np.flatnonzero(close.any(axis=1)).tolist():
        near.setdefault(k, []).append(split + np.flatnonzero(close[k]))
    if split:
        for k in np.flatnonzero(close.any(axis=0)).tolist():
            near.setdefault(split + k, []).append(np.flatnonzero(close[:, k]))
    return linked(ids, near)


#: Rows of a tile of shingle sets.
SETS_TILE = 512


def connected(keyed: DataFrame, near: Callable[[np.ndarray, pa.Array, int], tuple[list, list]], sets: DataFrame, radius: int, tile: int, similarity: float) -> DataFrame:
    """(id, component) of rows that links of at least this similarity join; rows without a link are not returned.

    ``near`` links the rows of a unit of ``keyed`` (bucket, ones, id, bits) that may be similar.
    What these links join is a group of candidates; its ``sets`` (id, shingles) come together, in
    pairs of tiles if they are many, where each two are compared exactly.  A unit returns a link a
    row at most, so that neither step's output grows with the pairs of a group.
    """

    def over(link: Callable[[pa.Table, int], tuple[list, list]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit in groups(batches, "unit"):
                if unit.num_rows < 2:
                    continue
                side = unit.column("side").to_numpy()
                a, b = link(unit, int(np.count_nonzero(side == 1)) if side[0] else 0)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        return run

    def maybe(unit: pa.Table, split: int) -> tuple[list, list]:
        return near(unit.column("id").to_numpy(), unit.column("bits").combine_chunks(), split)

    def surely(unit: pa.Table, split: int) -> tuple[list, list]:
        held = unit.column("bits").combine_chunks()
        return exact_links(unit.column("id").to_numpy(), np.split(held.flatten().to_numpy(), held.offsets.to_numpy()[1:-1] - held.offsets[0].as_py()), split, similarity)

    candidates = written(dealt(keyed, radius, tile).mapInArrow(over(maybe), "a long, b long").distinct(), "candidates")
    together = written(components(candidates), "candidate-groups")
    held = sets.join(sent_if_small(together, 32), "id").dropDuplicates(["id"])
    held = written(held.select(F.col("component").alias("bucket"), F.lit(0).alias("ones"), "id", F.col("shingles").alias("bits")), "candidate-sets")
    links = written(dealt(held, 0, SETS_TILE).mapInArrow(over(surely), "a long, b long").distinct(), "links")
    for gone in (candidates, together, held):
        forget(gone)
    joined = written(components(links), "components")
    forget(links)
    return joined


def classes_of(distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, component_id) of ``distinct`` (id, least, ...): the least of its component in ``joined`` (id, component), or its own."""
    classes = distinct.select("id", "least").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), "components")  # a plain join on a hot component can be split
    return written(classes.join(named, "component").select("id", "component_id"), "classes")


def similar(docs: DataFrame, words: int = 5, radius: int = WIDE_RADIUS, similarity: float = SIMILARITY, bits: int | None = None) -> DataFrame:
    """(doc_id, row, component_id, first) of every row of ``docs`` (doc_id, text): the least doc_id that similar texts lead to.

    Texts are linked whose sets of shingles have a Jaccard similarity of ``similarity`` or more, if
    the search finds them: wide fingerprints are candidates where they share a bucket of ``bits``
    bits (by the number of rows, if not given) and lie within ``radius``, which of pairs at exactly
    0.8 at least 0.99 do, of closer ones more; the sets of all rows that
    candidates join are then compared.  Equal sets are
    compared once, however often they occur.  Null and empty texts are alike; a row without doc_id
    joins its component but does not name it, so that one of such rows alone has a null id.
    ``row`` is a hash of the row's doc_id and text, and ``first`` says whether it is the row of its
    component to keep: one with the least doc_id, then of least hash; repeated rows are alike in
    all of this.  Texts of any length are read whole; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [distinct_hashes(t, words) for t in batch.column("text").to_pylist()]
            made = np.array([wide_fingerprint(x, PARTS) for x in sets], np.uint64).reshape(-1, PARTS)
            ids = [set_id(x) for x in sets]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.int64()), pa.array(list(made.view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "row", "id", "bits"])

        return step

    prints = written(map_rows(docs.select("doc_id", row_hash().alias("row"), text_or_empty()), make, "doc_id long, row long, id long, bits array<long>"), "wide")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    distinct = written(prints.groupBy("id").agg(F.min(key).alias("least"), F.first("bits").alias("bits")), "distinct-wide")
    places = places_for(bits or bits_for(distinct.count()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                held = some.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, PARTS)
                found = bucket_keys(held, places) + (np.arange(len(places)) << places.shape[1])
                row = np.repeat(np.arange(len(held)), len(places))
                ones = np.bitwise_count(held).sum(axis=1, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * PARTS), pa.array(held[row].view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(ones[row]), pa.array(some.column("id").to_numpy()[row]), lists], ["bucket", "ones", "id", "bits"])

    def near(ids: np.ndarray, held: pa.Array, split: int) -> tuple[list, list]:
        return stars(ids, held.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1), split, radius)

    keyed = distinct.select("id", "bits").mapInArrow(keys, "bucket long, ones int, id long, bits array<long>")
    joined = connected(keyed, near, shingle_sets(docs, words), radius, TILE, similarity)
    named = prints.join(classes_of(distinct, joined), "id")
    return named.select("doc_id", "row", F.col("component_id.doc_id").alias("component_id"), (key == F.col("component_id")).alias("first"))
