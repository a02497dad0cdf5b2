"""Substring dedup by seed and extend: passages of many words that other documents have too.

1. Seeds. Every run of ``SEED`` words has a hash; of the seeds inside each window of ``window`` words the
   one with the smallest hash is the window's anchor (winnowing, the rightmost of equal ones). Equal
   windows have equal anchors at equal places, so two documents that share a window share its anchor.
2. Join. Anchors of two or more documents are kept; a bit for each (8 MB at most) spares tasks most of
   the others, and a join on the anchor takes out the rest.
3. Extend. A seed is extended to the left and right over all windows that it anchors. Where an anchor
   has one extent, the join has settled it: the smallest document id has all its windows first. Other
   extents are compared window by window (8 MB of bits tell tasks whose windows to send), and a window's
   smallest id is that of all extents that have it. The document with the smallest id keeps the passage.
   Windows that overlap grow together to maximal repeats.

Groups are aggregated before and after the shuffle and joined as plain tables, so a passage that a third of
all documents share is split by adaptive execution; no pair of documents is ever formed. Texts
are shuffled only for documents that lose words. An extent is told by 128 bits, a window by 96: its own
hash and its anchor's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import has_bit, presence_bits, stage

SEED, BITS = 5, 26
PART_WORDS = 1 << 17
_LAST = (1 << 63) - 1
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words are found and hashed in pieces of about so many bytes; longer words than these are hashed one by one.
PART_BYTES, _LONG_WORD = 1 << 19, 64
SLICE_ROWS = 512


def _in_words(data: np.ndarray) -> np.ndarray:
    return (data != 32) & (data - np.uint8(9) > 4)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words in ``data``, the bytes of a piece of text."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _in_words(data)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words that have as many."""
    size = end - first
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    value = size.astype(np.uint64) * _MIX2
    on = np.flatnonzero(size <= _LONG_WORD)
    for k in range(0, _LONG_WORD, 8):
        on = on[size[on] > k]
        if not len(on):
            break
        rest = np.maximum(0, 8 - (size[on] - k)).astype(np.uint64) * np.uint64(8)
        part = value[on] ^ eights[first[on] + k] << rest >> rest
        part *= _MIX
        part ^= part >> np.uint64(32)
        part *= _MIX2
        value[on] = part ^ part >> np.uint64(29)
    for at in np.flatnonzero(size > _LONG_WORD):
        value[at] = xxhash.xxh3_64_intdigest(data[first[at] : end[at]])
    return value


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_ROWS``, so that what is made of a batch stays small; the batch is let go before the next."""
    for batch in batches:
        left, batch = [batch.slice(begin, SLICE_ROWS) for begin in range(batch.num_rows - 1 - (batch.num_rows - 1) % SLICE_ROWS, -1, -SLICE_ROWS)], None
        while left:
            yield left.pop()


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The bytes of about ``PART_BYTES`` of texts with the starts of each in them, and the first one's row.

    Texts follow each other with a space between. A longer text is one piece.
    """
    held, starts, total, begin = [], [], 0, 0
    for row, text in enumerate(texts):
        held.append(text.as_py())
        starts.append(total)
        total += len(held[-1]) + 1
        if total >= PART_BYTES:
            yield np.frombuffer(b" ".join(held), np.uint8), np.array(starts), begin
            held, starts, total, begin = [], [], 0, row + 1
    if held:
        yield np.frombuffer(b" ".join(held), np.uint8), np.array(starts), begin


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes of each text."""
    for data, starts, begin in _pieces(texts):
        parts, own = [], []
        cut = 0
        while cut < len(data):  # a long text is read in parts that end where no word does not
            stop = min(len(data), cut + 2 * PART_BYTES)
            while stop < len(data) and _in_words(data[stop : stop + 4096]).all():
                stop += 4096
            stop = min(len(data), stop + int(_in_words(data[stop : stop + 4096]).argmin())) if stop < len(data) else len(data)
            first, end = word_places(data[cut:stop])
            parts.append(word_hashes(data[cut:stop], first, end))
            own.append(first + cut)
            cut = stop
        if not parts:
            continue
        words = np.concatenate(parts)
        edges = np.append(np.searchsorted(np.concatenate(own), starts), len(words))
        for row, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), begin):
            yield row, words[a:b]


@lru_cache(maxsize=None)
def _factors(length: int) -> np.ndarray:
    return np.random.default_rng(length).integers(0, 1 << 63, length, np.uint64) * np.uint64(2) + np.uint64(1)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    count = max(0, len(words) - length + 1)
    value = np.zeros(count, np.uint64)
    for k, factor in enumerate(_factors(length)):
        value += words[k : k + count] * factor
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    value *= _MIX2
    return value ^ (value >> np.uint64(29))


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's hash and place. Places never decrease, so the windows of one anchor follow each other."""
    seeds = run_hashes(words, SEED)
    count = max(0, len(words) - window + 1)
    # Smallest of 2, 4, 8 ... seeds in a row, then of two such runs that overlap to the width wanted.
    best, at, width, wanted = seeds, np.arange(len(seeds)), 1, window - SEED + 1
    while width < wanted:
        step = min(width, wanted - width)
        better = best[step:] <= best[:-step]
        best, at = np.where(better, best[step:], best[:-step]), np.where(better, at[step:], at[:-step])
        width += step
    return best[:count], at[:count]


@dataclass(frozen=True)
class Passages:
    """The anchors of some documents, one entry for each: its hash, its row in the batch, its first window's word in the document, its windows."""

    anchor: np.ndarray
    row: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray  # the first window's place among all words
    words: np.ndarray


def passages(texts: pa.Array, window: int) -> Iterator[Passages]:
    """Documents with at least a window, about ``PART_WORDS`` words at once; their words lie one after another."""
    rows, held, total = [], [], 0

    def found() -> Passages:
        words, sizes = np.concatenate(held), np.array([len(h) for h in held])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        best, at = anchors(words, window)
        whole = np.flatnonzero(doc[: len(at)] == doc[window - 1 :])  # windows inside one document
        new = np.flatnonzero(np.r_[True, np.diff(at[whole]) != 0])
        first = whole[new]
        return Passages(best[first], np.array(rows)[doc[first]], first - (np.cumsum(sizes) - sizes)[doc[first]], np.diff(np.r_[new, len(whole)]), first, words)

    for row, words in hashed_words(texts):
        if len(words) < window:
            continue
        rows.append(row)
        held.append(words)
        total += len(words)
        if total >= PART_WORDS:
            yield found()
            rows, held, total = [], [], 0
    if rows:
        yield found()


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _extents(found: Passages, hashes: np.ndarray) -> np.ndarray:
    """The hash of all words that each anchor's windows cover (the first and the last window do); ``hashes`` are the windows'."""
    last = hashes[found.first + found.size - 1]
    return (hashes[found.first] ^ (last >> np.uint64(17) | last << np.uint64(47))) * _MIX + found.size.astype(np.uint64)


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """``anchor, extent, _id``: the anchors of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for found in passages(batch.column(2), window):
                extent = _extents(found, run_hashes(found.words, window))
                yield pa.RecordBatch.from_arrays([_long(found.anchor), _long(extent), batch.column(0).take(pa.array(found.row))], ["anchor", "extent", "_id"])

    return texts.mapInArrow(run, "anchor long, extent long, _id long")


def _seeds(texts: DataFrame, window: int, bits: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """``anchor, extent, _id, _hash, start, size, windows``: places of anchors with a bit set in ``bits``.

    A seed's windows are the ``size`` that it anchors, from word ``start`` on. Where the anchor's bit in
    ``mixed`` is clear ``windows`` is null; else it has them as short hashes that count only with the anchor's.
    """
    shared = texts.sparkSession.sparkContext.broadcast((bits, mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mixed = shared.value
        for batch in _slices(batches):
            for found in passages(batch.column(2), window):
                place = found.anchor >> np.uint64(64 - BITS)
                on = np.flatnonzero(has_bit(bits, place))
                if not len(on):
                    continue
                hashes, first, size = run_hashes(found.words, window), found.first[on], found.size[on]
                listed = has_bit(mixed, place[on])
                ends = np.cumsum(np.where(listed, size, 0))
                each = np.repeat(first[listed] - (ends - size)[listed], size[listed]) + np.arange(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array((hashes[each] >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()),
                                                 mask=pa.array(~listed))
                at = pa.array(found.row[on])
                yield pa.RecordBatch.from_arrays(
                    [_long(found.anchor[on]), _long(_extents(found, hashes)[on]), batch.column(0).take(at), batch.column(1).take(at), pa.array(found.start[on], pa.int32()), pa.array(size, pa.int32()), lists],
                    ["anchor", "extent", "_id", "_hash", "start", "size", "windows"])

    return texts.mapInArrow(run, "anchor long, extent long, _id long, _hash int, start int, size int, windows array<int>")


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """``_id, _hash, starts``: for each document the windows that a document with a smaller id has too."""
    shared = _anchor_rows(texts, window).groupBy("anchor").agg(
        F.min("_id").alias("least"), F.max("_id").alias("most"), (F.min("extent") < F.max("extent")).alias("mixed")).where("least < most").drop("most")
    shared = stage(shared, "anchors")
    place = F.shiftrightunsigned("anchor", 64 - BITS)
    bits, mixed = (presence_bits(some.select(place), BITS) for some in (shared, shared.where("mixed")))
    # Where an anchor has one extent, its smallest id has all its windows first.
    joined = _seeds(texts, window, bits, mixed).join(shared, "anchor").where("mixed OR _id > least")
    joined = stage(joined.withColumn("windows", F.when(F.col("mixed"), F.col("windows"))).drop("least"), "seeds")
    plain = joined.where("NOT mixed").select("_id", "_hash", F.sequence("start", F.col("start") + F.col("size") - 1).alias("starts"))
    seeds = joined.where("mixed").drop("mixed", "size")
    # Seeds that extend equally are one extent; only its windows are compared with those of other extents.
    extents = stage(seeds.groupBy("anchor", "extent").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.any_value("windows").alias("windows")), "extents")
    windows = extents.select("anchor", "extent", "hi", "lo", F.posexplode("windows").alias("at", "window"))
    firsts = stage(windows.groupBy("anchor", "window").agg(F.min("lo").alias("first"), F.max("hi").alias("_last")).where("first < _last").drop("_last"), "firsts")
    taken = windows.join(firsts, ["anchor", "window"]).where(F.col("hi") > F.col("first")).groupBy("anchor", "extent").agg(
        F.collect_list(F.struct("at", "first")).alias("_windows"))
    again = seeds.drop("windows").join(stage(taken, "taken"), ["anchor", "extent"])
    mine = F.filter("_windows", lambda w: w["first"] < F.col("_id"))
    starts = again.select("_id", "_hash", F.transform(mine, lambda w: F.col("start") + w["at"]).alias("starts")).where(F.size("starts") > 0)
    return plain.unionByName(starts).groupBy("_id", "_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def maximal_spans(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the maximal repeats that windows at ``starts`` cover; overlapping and touching windows are one."""
    starts = np.unique(starts)
    breaks = np.flatnonzero(np.diff(starts) > window) + 1
    return starts[np.r_[0, breaks].astype(np.int64)], starts[np.r_[breaks - 1, len(starts) - 1].astype(np.int64)] + window


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` for each row; with ``with_text`` also ``kept_text``.

    ``spans`` are the removed maximal repeats as [first word, end). Words are the runs between x20 and
    x09 to x0D; kept words are joined by one space.

    * Null and empty texts have no words; texts with fewer words than a window lose none.
    * The row with the smallest id keeps a passage. Rows with one id never take from each other. A null
      id comes after every other, so such rows take from none and lose what any row with an id has.
    * Rows that repeat id and text share their decision. An empty table gives an empty result. Other
      columns are not read.
    """
    if window < SEED:
        raise ValueError(f"a window has at least {SEED} words")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"), F.col(id_col).alias("_own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    texts = texts.select("_id", F.hash("_text").alias("_hash"), F.col("_text").cast("binary").alias("_text"), "_own")
    again = stage(repeated_windows(texts, window), "repeats")
    # A bit for each document that loses words: the others are finished where they lie, and their texts aren't shuffled.
    place = F.shiftrightunsigned(F.xxhash64("_id", "_hash"), 64 - BITS)
    bits = docs.sparkSession.sparkContext.broadcast(presence_bits(again.select(place), BITS))
    kind = docs.schema[id_col].dataType.simpleString()

    def touched(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            on = has_bit(bits.value, batch.column(4).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(on == want))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.nulls(batch.num_rows, pa.list_(pa.int32()))], ["_own", "_text", "starts"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            counts, removed, shas, spans, kept_texts = [], [], [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().split()
                counts.append(len(words))
                own = []
                if starts.is_valid and len(starts):
                    first, end = maximal_spans(starts.values.to_numpy(), window)
                    own = [{"first": int(f), "end": int(e)} for f, e in zip(first, end, strict=True)]
                    for span in reversed(own):
                        del words[span["first"] : span["end"]]
                kept = b" ".join(words)
                removed.append(counts[-1] - len(words))
                spans.append(own)
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept_texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    numbered = texts.withColumn("_place", place)
    schema = numbered.schema
    cut = numbered.mapInArrow(lambda b: touched(b, True), schema).join(again, ["_id", "_hash"], "left").select("_own", "_text", "starts")
    out = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, end: long>>, kept_text string"
    result = numbered.mapInArrow(lambda b: finish(whole(touched(b, False))), out).unionByName(cut.mapInArrow(finish, out))
    return result if with_text else result.drop("kept_text")
