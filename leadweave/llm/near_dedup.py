"""Near-duplicate documents by MinHash.

1. Each text becomes the set of its five-word shingles (64-bit hashes). Many universal hash
   functions give one minimum each; runs of minima form bands.
2. Documents with equal sets are one class, represented by its smallest id. Only representatives go on.
3. Representatives that share a band are candidates. Every member of a band is compared with one
   member of it first, by signature and then on full sets. Each band picks its own (the smallest by a
   hash of id and band), so a document of a large group meets many others. Links give components.
4. Bands that still hold several components are searched exhaustively: each member outside the
   band's largest component is compared with all members of other components, block against block,
   in the first band that the two share: by signature first, which leaves the members that have a
   likely partner, and then on the full sets of those. Only members and links leave the tasks, one
   link for each member and component it reaches. So no link inside a band is lost, and a band's
   pairs are never written out.
5. Components come from alternating large-star and small-star over the confirmed links.

Words are the runs between x20 and x09 to x0D with A-Z lowered; a text with fewer words than a
shingle is one shingle; a text without words has an empty set and is linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import Hidden, lower_words, stage

SHINGLE_WORDS = 5
#: A pair just similar enough shares no band at most so often, and its signatures agree in too few minima at most so often.
BAND_MISS, SIGNATURE_MISS = 1 / 80_000, 2e-6
#: Minima of a signature: at most so many, as long as bands of one row do.
MOST_MINIMA = 150
BLOCK = 768
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_WORD_CACHE = 300_000


@lru_cache(maxsize=None)
def candidate_settings(percent: int) -> tuple[int, int, int]:
    """Bands, rows of a band and least number of equal minima for pairs of at least ``percent``.

    The longest bands that keep both bounds at exactly this similarity: 24 bands of 6 and 101 of 144
    equal minima at 85, 29 bands of 5 and 92 of 145 at 80.
    """
    p = min(max(percent / 100, 0.01), 0.99)
    fits = [(math.ceil(math.log(BAND_MISS) / math.log1p(-(p**rows))), rows) for rows in range(1, MOST_MINIMA + 1)]
    bands, rows = [f for f in fits if f[1] == 1 or f[0] * f[1] <= MOST_MINIMA][-1]
    minima, below, least = bands * rows, 0.0, 0
    while (below := below + math.comb(minima, least) * p**least * (1 - p) ** (minima - least)) <= SIGNATURE_MISS:
        least += 1
    return bands, rows, least


class WordHashes(dict):
    """Word to 64-bit hash, kept for words seen before; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, words: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    found = lower_words(text)
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    count = max(1, len(ids) - width + 1)
    value = np.zeros(count, np.uint64)
    for k in range(min(width, len(ids))):
        value = (value ^ ids[k : k + count]) * _MIX
        value ^= value >> np.uint64(29)
    if len(ids) < width:  # a short text never equals a shingle of a longer one
        value += np.uint64(len(ids))
    value *= _MIX2
    value ^= value >> np.uint64(32)
    return np.unique(value)


def hash_functions(count: int, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add functions with odd factors modulo 2^32: universal on the leading bits, which minima compare first."""
    random = np.random.default_rng(seed)
    return random.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, count, np.uint32)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash function over a non-empty set."""
    factor, shift = functions
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), 512):
        part = low[begin : begin + 512]
        np.minimum(best, (factor[:, None] * part[None, :] + shift[:, None]).min(axis=1), out=best)
    return best


def signatures(docs: DataFrame, id_col: str, text_col: str, percent: int = 85) -> DataFrame:
    """``_id, n_shingles, _set`` (hash of the set; null if empty), ``_sig`` and ``_bands``."""
    count, rows, _ = candidate_settings(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, functions = WordHashes(), hash_functions(count * rows)
        for batch in batches:
            sizes, sets, sigs, bands = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                if not len(shingles):
                    sets.append(None), sigs.append(None), bands.append(None)
                    continue
                own = signature(shingles, functions)
                sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sigs.append(own.tobytes())
                bands.append([xxhash.xxh64_intdigest(own[k * rows : (k + 1) * rows].tobytes(), k) - (1 << 63) for k in range(count)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["_id", "n_shingles", "_set", "_sig", "_bands"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(
        run, "_id long, n_shingles long, _set binary, _sig binary, _bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs ``a, b`` for which 100 * intersection >= percent * union holds on full shingle sets.

    Texts come to their pairs through two joins; where one document is in very many pairs, adaptive
    execution splits its partition. Pairs arrive sorted by ``a``, so its set is built once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, known_text, known_set = WordHashes(), None, None, None
        for batch in batches:
            keep = []
            for row, (a, text_a, text_b) in enumerate(zip(batch.column(0), batch.column(2), batch.column(3), strict=True)):
                a, text_a = a.as_py(), text_a.as_py()
                if a != known or text_a != known_text:
                    known, known_text, known_set = a, text_a, shingle_set(text_a, words)
                other = shingle_set(text_b.as_py(), words)
                if not len(known_set) or not len(other):
                    continue
                both = len(known_set) + len(other) - len(np.union1d(known_set, other))
                if 100 * both >= percent * (len(known_set) + len(other) - both):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), batch.column(1).take(pa.array(keep, pa.int32()))], ["a", "b"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    left, right = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_text_a")), texts.select(F.col("_id").alias("b"), F.col("_text").alias("_text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "_text_a", "_text_b").sortWithinPartitions("a")
    return joined.mapInArrow(run, "a long, b long").distinct()


def similar_signatures(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in at least ``_least`` minima, a column of ``sigs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
                keep = pa.array(np.flatnonzero((a == b).sum(axis=1) >= batch.column(4).to_numpy()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    one, two = sigs.select(F.col("_id").alias("a"), F.col("_sig").alias("_sig_a"), "_least"), sigs.select(F.col("_id").alias("b"), F.col("_sig").alias("_sig_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "_sig_a", "_sig_b", "_least").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges``.

    Large-star links each larger neighbour of a node to the smallest node around it; small-star
    links the smaller neighbours and the node itself to it. Alternating them leaves stars around the
    smallest nodes. Minima are aggregated before they are shuffled and joined back, so a node with
    very many neighbours is never gathered.
    """
    def star(links: DataFrame, large: bool) -> DataFrame:
        """``links``: u > v once each."""
        if large:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            least = links.groupBy("u").agg(F.min("v").alias("m"))
            joined = links.join(least, "u")
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    links = stage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    while True:
        links = stage(star(star(links, True), False), "links")
        # Stars are reached when a round changes nothing; counts, sums and a hash of all links tell.
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now


class _Side:
    """One side of a block comparison: ids, components, sizes and signatures, and full sets where they are given."""

    def __init__(self, rows: list[tuple]):
        self.node = [r[0] for r in rows]
        self.component = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([r[2] for r in rows], np.int64)
        self.sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), -1)
        self.sets = [np.frombuffer(r[4], np.uint64) for r in rows] if len(rows[0]) > 4 else []


def _likely(left: _Side, k: int, right: _Side, band: int, percent: int) -> np.ndarray:
    """Members of ``right`` in other components than left member ``k`` whose first shared band is ``band`` and whose signature agrees."""
    own, (count, rows, least) = left.size[k], candidate_settings(percent)
    other = np.flatnonzero((100 * np.minimum(right.size, own) >= percent * np.maximum(right.size, own)) & (right.component != left.component[k]))
    if len(other):
        equal = right.sig[other] == left.sig[k]
        bands = equal.reshape(len(other), count, rows).all(axis=2)
        other = other[(equal.sum(axis=1) >= least) & (bands.argmax(axis=1) == band)]
    return other


def _members(left: _Side, right: _Side, band: int, percent: int) -> list[tuple[bool, int, int]]:
    """(side, node, component) of the members that have a likely partner."""
    mine, theirs = [], np.zeros(len(right.node), bool)
    for k in range(len(left.node)):
        other = _likely(left, k, right, band, percent)
        if len(other):
            mine.append(k)
            theirs[other] = True
    return [(True, left.node[k], int(left.component[k])) for k in mine] + [(False, right.node[k], int(right.component[k])) for k in np.flatnonzero(theirs)]


def _links(left: _Side, right: _Side, band: int, percent: int) -> list[tuple[int, int]]:
    """Links on full sets, one for each left member and component."""
    out = []
    for k, own in enumerate(left.sets):
        other = _likely(left, k, right, band, percent)
        if not len(other):
            continue
        sizes = right.size[other]
        flat = np.concatenate([right.sets[j] for j in other])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        linked = other[100 * both >= percent * (len(own) + sizes - both)]
        out += [(left.node[k], right.node[j]) for j in linked[np.unique(right.component[linked], return_index=True)[1]]]
    return out


_KEYS = ["_k", "_band", "_i", "_j"]


def _by_blocks(rows: DataFrame, columns: list[str], compare, schema: str, percent: int) -> DataFrame:
    """Apply ``compare`` to the two sides of each (band, block, block) group; a group's rows come one after the other and are at most two blocks."""
    names = [part.split()[0] for part in schema.split(", ")]
    with_key = names[0] == _KEYS[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()] if with_key else [pa.int64(), pa.int64()]
        group, held, out = None, [], []

        def close() -> None:
            sides = [[r[1:] for r in held if r[0] is side] for side in (True, False)]
            if all(sides):
                found = compare(_Side(sides[0]), _Side(sides[1]), group[0], percent)
                out.extend((*group, *row) if with_key else (min(row), max(row)) for row in found)

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                for values in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if values[:4] != group:
                        if held:
                            close()
                        group, held = values[:4], []
                    held.append(values[4:])
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)
            out.clear()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)

    dealt = rows.select(*_KEYS, "_left", "node", "component", *columns).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return dealt.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, _shingles``: the full set of each row as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), words).tobytes() for t in part.column(1)], pa.binary())], ["node", "_shingles"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, "node long, _shingles binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """For each row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept`` (id = component_id).

    * Links need 100 * intersection >= ``percent`` * union of the full shingle sets.
    * Null and empty texts, and texts of separators only, have no shingles and are their own component.
    * Rows that share an id are one document: they share the component, each with its own ``n_shingles``.
    * Rows with a null id are never linked: their component is null and they are kept.
    * An empty table gives an empty result.
    """
    sigs = stage(signatures(docs, id_col, text_col, percent), "signatures")
    usable = sigs.where("_id IS NOT NULL AND _set IS NOT NULL")
    classes = usable.groupBy("_set").agg(F.min("_id").alias("rep"), F.count("*").alias("_n"))
    members = stage(usable.select("_id", "_set").join(classes, "_set").select("_id", "rep", "_n"), "members")
    many = members.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_x")).where("a < _x").drop("_x")
    same_id = members.join(many, "_id").where("a != rep").select("a", F.col("rep").alias("b")).distinct()
    reps = usable.join(members.where("_id = rep").select(F.col("rep").alias("_id")).distinct(), "_id", "left_semi")
    banded = reps.select("_id", F.posexplode("_bands").alias("_k", "_band"))
    shared = banded.groupBy("_k", "_band").agg(F.min(F.struct(F.xxhash64("_id", "_band").alias("_order"), "_id"))["_id"].alias("_pivot"), F.count("*").alias("_size")).where("_size > 1")
    full = stage(banded.join(shared, ["_k", "_band"]), "bands")

    first = full.where("_id != _pivot").select(F.least("_pivot", "_id").alias("a"), F.greatest("_pivot", "_id").alias("b")).distinct()
    small = reps.select("_id", "_sig", F.lit(candidate_settings(percent)[2]).alias("_least"))
    links = stage(confirmed(similar_signatures(first, small), docs, id_col, text_col, percent).unionByName(same_id), "links")
    found = connected_components(links)

    # Bands that still hold more than one component: everything outside the largest is compared with the rest.
    placed = stage(full.join(found.withColumnRenamed("node", "_id"), "_id", "left").select(
        "_k", "_band", F.col("_id").alias("node"), F.coalesce("component", "_id").alias("component")), "placed")
    by_component = placed.groupBy("_k", "_band", "component").agg(F.count("*").alias("_n"))
    open_bands = by_component.groupBy("_k", "_band").agg(
        F.max(F.struct("_n", "component"))["component"].alias("_main"), F.sum("_n").alias("_size"), F.count("*").alias("_parts"), F.max("_n").alias("_most")).where("_parts > 1")
    open_rows = stage(placed.join(open_bands, ["_k", "_band"]), "open")
    blocks = lambda count: F.ceil(count / F.lit(BLOCK)).cast("int")
    lefts, rights = blocks(F.col("_size") - F.col("_most")), blocks(F.col("_size"))
    mine = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), count).cast("int")
    outside = open_rows.where("component != _main")
    left = outside.withColumn("_i", mine(lefts, 1)).withColumn("_j", F.explode(F.sequence(F.lit(0), rights - 1))).withColumn("_left", F.lit(True))
    right = open_rows.withColumn("_j", mine(rights, 2)).withColumn("_i", F.explode(F.sequence(F.lit(0), lefts - 1))).withColumn("_left", F.lit(False))
    known = reps.select(F.col("_id").alias("node"), F.col("n_shingles").alias("_shingle_count"), "_sig").dropDuplicates(["node"])
    sides = left.unionByName(right.select(left.columns)).join(known, "node")
    likely = stage(_by_blocks(sides, ["_shingle_count", "_sig"], _members, "_k int, _band long, _i int, _j int, _left boolean, node long, component long", percent), "likely")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("_text")).join(likely.select("node").distinct(), "node", "left_semi")
    sets = shingle_sets(texts, "node", "_text").join(known, "node").where(F.length("_shingles") == 8 * F.col("_shingle_count")).dropDuplicates(["node"])
    full_sides = likely.join(sets, "node")
    more = stage(_by_blocks(full_sides, ["_shingle_count", "_sig", "_shingles"], _links, "a long, b long", percent).distinct(), "links")
    if more.limit(1).count():
        found = connected_components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    per_id = members.groupBy("_id").agg(F.min("rep").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "_id", F.coalesce("component", "rep").alias("component_id"))
    return sigs.select("_id", "n_shingles").join(per_id, "_id", "left").withColumn("component_id", F.coalesce("component_id", "_id")).select(
        F.col("_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    hidden = Hidden(docs)
    return hidden.docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti").select(*hidden.columns())
