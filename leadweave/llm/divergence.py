"""Which sources of a language differ, and in which terms.

The terms of a language that enough of its documents hold are found by iceberg prefix refinement.
A term is its bytes and an end byte; level by level its prefix grows (``LEVELS``). A level counts, for
every prefix that extends a surviving one, the documents that hold it. A document lies in one task,
so its prefixes count once there and the tasks' counts add up. Prefixes below the threshold are
discarded with all terms that begin with them; a surviving prefix that reaches its end byte is a
kept term. Tasks learn the survivors as one bit for each hash, 8 MB for any number of them; prefixes
that share a bit are counted in vain, exactly, and fall at the threshold.

Sources are compared tile by tile: a group holds a block of kept terms and two tiles of sources, so
its size doesn't depend on the corpus, and no term ever pairs the sources that use it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.common import has_bit, presence_bits, stage

#: Bytes of the prefixes of each level; after the last one each level is four times as long as the one before.
LEVELS = (4, 12, 32)
BITS = 26
#: Kept terms of a block and sources of a tile when sources are compared.
BLOCK_TERMS, TILE = 2048, 256
END = b" "
#: Text that a task takes apart at once, and counts that it adds up before it hands them on.
PART_BYTES, MOST_SUMS = 8 << 20, 4_000_000
#: Letters A-Z lowered, other ASCII to a space; bytes of other characters stay.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SCALE = 1_000_000_000


def _places(langs: list[bytes], prefixes: list[bytes]) -> np.ndarray:
    """The bit of each prefix: the first bits of the 64-bit hash that the table side computes by column function."""
    found = (xxhash.xxh64_intdigest(lang + b"\0" + p, 42) for lang, p in zip(langs, prefixes, strict=True))
    return np.fromiter(found, np.uint64, len(prefixes)) >> np.uint64(64 - BITS)


def _place(prefix: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), prefix)), 64 - BITS)


class Terms:
    """All terms of some texts as positions in one buffer, and codes for their prefixes without a Python object a term."""

    def __init__(self, texts: list[bytes]):
        self.buffer = END.join(texts).translate(LETTERS) + END * 9
        letters = np.frombuffer(self.buffer, np.uint8)
        bounds = np.flatnonzero(np.diff(np.r_[False, letters != 32].view(np.int8)))
        self.start, self.length = bounds[::2], bounds[1::2] - bounds[::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        # Eight bytes from every position on, as one number.
        self.eight = np.lib.stride_tricks.as_strided(np.frombuffer(self.buffer, "<u8", 1), (len(letters) - 8,), (1,))

    def codes(self, own: np.ndarray, groups: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """A number for each of the terms ``own``, the same exactly for the same group and prefix of at most ``limit`` bytes, end byte included; and one term for each number."""
        sizes = self.length[own] + 1 if limit is None else np.minimum(self.length[own] + 1, limit)
        code, used = groups.astype(np.int64), int(groups.max(initial=-1)) + 1
        going, at = np.arange(len(own)), 0
        while len(going):
            part = self.eight[self.start[own[going]] + at]
            left = np.minimum(sizes[going] - at, 8).astype(np.uint64)
            part = part << (np.uint64(64) - left * np.uint64(8))
            chunk, values = pd.factorize(part)
            pair, found = pd.factorize(code[going] * len(values) + chunk)
            code[going] = used + pair
            used += len(found)
            at += 8
            going = going[sizes[going] > at]
        code, values = pd.factorize(code)
        some = np.empty(len(values), np.int64)
        some[code[::-1]] = own[::-1]
        return code, some

    def prefixes(self, some: np.ndarray, limit: int | None) -> list[bytes]:
        """The prefixes of some terms, end byte included where they reach it."""
        sizes = self.length[some] + 1 if limit is None else np.minimum(self.length[some] + 1, limit)
        return [self.buffer[s:e] for s, e in zip(self.start[some].tolist(), (self.start[some] + sizes).tolist(), strict=True)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``PART_BYTES`` of text; a longer text is a part of its own."""
    for batch in batches:
        begin, size = 0, 0
        for row, length in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
            if size and size + length > PART_BYTES:
                yield batch.slice(begin, row - begin)
                begin, size = row, 0
            size += length
        if begin < batch.num_rows:
            yield batch.slice(begin)


class Sums:
    """Counts by (group, bytes), added up over a task's parts and handed on when there are too many."""

    def __init__(self, names: list[str]):
        self.names, self.groups, self.words, self.held, self.rows = names, {}, {}, [], 0

    def add(self, groups: list[tuple], words: list[bytes], group: np.ndarray, word: np.ndarray, counts: np.ndarray) -> None:
        """``group`` and ``word`` are positions in the two lists."""
        of_group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        of_word = np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int64)
        self.held.append((of_word[word] << 24 | of_group[group], counts))
        self.rows += len(counts)
        if self.rows > MOST_SUMS:
            self._merge()

    def _merge(self) -> None:
        if self.held:
            keys, counts = (np.concatenate(p) for p in zip(*self.held, strict=True))
            at, keys = pd.factorize(keys)
            self.held, self.rows = [(keys, np.bincount(at, counts, len(keys)).astype(np.int64))], len(keys)

    @property
    def full(self) -> bool:
        return self.rows > MOST_SUMS // 2 and len(self.held) == 1 or len(self.groups) > 1 << 20

    def take(self) -> pa.RecordBatch:
        self._merge()
        keys, counts = self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        group, word = pa.array(keys & 0xFFFFFF), pa.array(keys >> 24)
        columns = [pa.array([g[i] for g in self.groups], pa.string()).take(group) for i in range(len(self.names) - 2)]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array(list(self.words), pa.binary()).take(word), pa.array(counts)], self.names)
        self.__init__(self.names)
        return batch


def _level(texts: DataFrame, before: int, length: int, bits: np.ndarray | None) -> DataFrame:
    """``lang, prefix, n``: in how many documents of a language each candidate prefix of a level occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bits = Sums(["lang", "prefix", "n"]), shared.value
        for part in _parts(batches):
            terms = Terms(part.column(2).to_pylist())
            of_doc, langs = pd.factorize(part.column(0).to_numpy(zero_copy_only=False))
            own = np.arange(len(terms.start))
            if bits is not None:
                own = own[terms.length >= before]
                code, some = terms.codes(own, of_doc[terms.doc[own]], before)
                open_ones = has_bit(bits, _places([langs[i].encode() for i in of_doc[terms.doc[some]]], terms.prefixes(some, before)))
                own = own[open_ones[code]]
            if not len(own):
                continue
            code, some = terms.codes(own, of_doc[terms.doc[own]], length)
            each = pd.unique(terms.doc[own] * len(some) + code) % len(some)  # once a document
            sums.add([(g,) for g in langs], terms.prefixes(some, length), of_doc[terms.doc[some]], np.arange(len(some)), np.bincount(each, minlength=len(some)))
            if sums.full:
                yield sums.take()
        yield sums.take()

    return texts.mapInArrow(run, "lang string, prefix binary, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def kept_terms(texts: DataFrame, least: int) -> DataFrame:
    """``lang, term, n_docs``: the terms that at least ``least`` documents of their language hold. ``texts``: lang, source, bytes of the text."""
    kept, bits, before, number = None, None, 0, 0
    while True:
        length = LEVELS[number] if number < len(LEVELS) else before * 4
        level = stage(_level(texts, before, length, bits).where(F.col("n") >= least), f"prefixes-{number}")
        ended = level.where(F.expr("right(hex(prefix), 2) = '20'")).select("lang", F.expr("substring(prefix, 1, length(prefix) - 1)").alias("term"), F.col("n").alias("n_docs"))
        kept = ended if kept is None else kept.unionByName(ended)
        open_ones = level.where(F.expr("right(hex(prefix), 2) <> '20'"))
        if open_ones.isEmpty():
            return stage(kept, "terms")
        bits, before, number = presence_bits(open_ones.select(_place(F.col("prefix"))), BITS), length, number + 1


def term_counts(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, term, c``: occurrences of the kept terms in each group that has any."""
    shared = texts.sparkSession.sparkContext.broadcast(presence_bits(kept.select(_place(F.concat("term", F.lit(END)))), BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bits = Sums(["lang", "source", "term", "c"]), shared.value
        for part in _parts(batches):
            terms = Terms(part.column(2).to_pylist())
            if not len(terms.start):
                continue
            lang_of, langs = pd.factorize(part.column(0).to_numpy(zero_copy_only=False))
            group_of, groups = pd.factorize(pd.Series(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), dtype=object))
            code, some = terms.codes(np.arange(len(terms.start)), lang_of[terms.doc], None)
            words = terms.prefixes(some, None)
            on = has_bit(bits, _places([langs[i].encode() for i in lang_of[terms.doc[some]]], words))
            number = np.cumsum(on) - 1  # of the kept ones
            own = np.flatnonzero(on[code])
            if len(own):
                count = int(on.sum())
                pair, pairs = pd.factorize(group_of[terms.doc[own]] * count + number[code[own]])
                sums.add(list(groups), [w[:-1] for w, good in zip(words, on, strict=True) if good], pairs // count, pairs % count, np.bincount(pair))
            if sums.full:
                yield sums.take()
        yield sums.take()

    # Tasks have added up what they can; dealt by term once, the sum and the join need no other exchange.
    counted = texts.mapInArrow(run, "lang string, source string, term binary, c long").repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"))
    return counted.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")


def _rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exactly, and 1 where there are no terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.when(terms == 0, F.lit(1).cast("long")).otherwise(1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2), whole(total + 2 * terms)))


def _compare_tiles(key: tuple, rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Sum of (p-q)^2 div (p+q) over one block of terms for every pair of sources, the first from one tile and the second from the other."""
    lang, _, first, second = key
    sources = rows[rows["term"].isna()].sort_values("number")
    cells = rows[rows["term"].notna()]
    code, names = pd.factorize(cells["term"])
    numbers = sources["number"].to_numpy(np.int64)
    absent = sources["p"].to_numpy(np.int64)
    rate = np.repeat(absent[:, None], len(names), axis=1)
    rate[np.searchsorted(numbers, cells["number"].to_numpy(np.int64)), code] = cells["p"].to_numpy(np.int64)
    rest = int(sources["n_block"].iloc[0]) - len(names)  # terms that none of these sources uses
    name = sources["source"].to_numpy(object)
    a_side, b_side = np.flatnonzero(numbers // tile == first), np.flatnonzero(numbers // tile == second)
    out_a, out_b, out = [], [], []
    for a in a_side:
        others = b_side[numbers[b_side] > numbers[a]]
        if not len(others):
            continue
        d, s = rate[others] - rate[a], rate[others] + rate[a]
        value = (d * d // s).sum(axis=1, dtype=np.int64)
        d0, s0 = absent[others] - absent[a], absent[others] + absent[a]
        out.append(value + rest * (d0 * d0 // s0))
        out_a.append(np.repeat(name[a : a + 1], len(others)))
        out_b.append(name[others])
    sides = [pd.Series(np.concatenate(side) if side else [], dtype=object) for side in (out_a, out_b)]
    return pd.DataFrame({"lang": pd.Series([lang] * len(sides[0]), dtype=object), "source": sides[0], "item": sides[1], "value": np.concatenate(out) if out else np.zeros(0, np.int64)})


def source_pairs(cells: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each source and each other source of its language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    by_lang = groups.groupBy("lang").agg(F.first("v").alias("v"), F.max("number").alias("last")).select(
        "lang", blocks.alias("blocks"), (F.floor(F.col("last") / TILE) + 1).cast("int").alias("tiles"))
    by_lang = stage(by_lang, "languages")
    sizes = stage(kept.join(by_lang, "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("n_block")), "blocks")
    per_source = groups.join(by_lang, "lang").select("lang", "source", "number", "tiles", F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    per_source = per_source.join(sizes, ["lang", "block"], "left").select(
        "lang", "block", "tiles", "number", "source", F.lit(None).cast("binary").alias("term"), "p", F.coalesce("n_block", F.lit(0)).alias("n_block"))
    per_cell = cells.join(by_lang, "lang").select("lang", block.alias("block"), "tiles", "number", F.lit(None).cast("string").alias("source"), "term", "p", F.lit(None).cast("long").alias("n_block"))
    own, other = F.floor(F.col("number") / TILE).cast("int"), F.col("_other")
    dealt = per_source.unionByName(per_cell).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "block", F.least(own, other).alias("first"), F.greatest(own, other).alias("second"), "number", "source", "term", "p", "n_block")
    tile = TILE

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _compare_tiles(key, rows, tile)

    halves = dealt.groupBy("lang", "block", "first", "second").applyInPandas(compare, "lang string, source string, item string, value long").groupBy(
        "lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("i")), F.struct(F.col("item").alias("s"), F.col("source").alias("i"))))
    return halves.select("lang", both.alias("_pair"), "value").select("lang", F.col("_pair.s").alias("source"), F.col("_pair.i").alias("item"), "value")


def leading_terms(cells: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """``lang, source, item, value, rank``: the ``most`` terms of each source that raise it above its language."""
    languages = stage(groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.first("v").alias("v")), "language-sizes")
    terms = cells.groupBy("lang", "term").agg(F.sum("c").alias("c_lang"))
    rates = stage(terms.join(languages, "lang").select("lang", "term", _rate(F.col("c_lang"), F.col("n_lang"), F.col("v")).alias("q")), "term-rates")
    d, s = F.col("p") - F.col("q"), F.col("p") + F.col("q")
    above = cells.join(rates, ["lang", "term"]).where(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").cast("string").alias("item"), F.call_function("div", d * d, s).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def source_divergence(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from every other of its language, and its leading terms.

    * Null text, language and source count as ''. Rows are documents: repeated rows count each.
    * Part ``pair`` has every other source of the language (value 0 where it keeps no terms); part
      ``term`` at most ``top_terms`` kept terms that the source uses more than its language does.
    * Equal values are ordered by the item's bytes. A language with one source has no pairs.
    * Very long terms are followed to their end: their levels grow by four. An empty table gives an
      empty result. Other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("_bytes"))
    kept = kept_terms(texts, least_docs)
    counts = stage(term_counts(texts, kept), "term-counts")
    per_lang = stage(kept.groupBy("lang").agg(F.count("*").alias("v")), "kept-sizes")
    totals = stage(counts.groupBy("lang", "source").agg(F.sum("c").alias("n")), "group-sizes")
    present = texts.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    groups = present.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = stage(groups.select(
        "*", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number"), _rate(F.lit(0), F.col("n"), F.col("v")).alias("p0")), "groups")
    cells = stage(counts.join(groups, ["lang", "source"]).select("lang", "source", "number", "term", "c", _rate(F.col("c"), F.col("n"), F.col("v")).alias("p")), "cells")
    pairs = source_pairs(cells, groups, kept)
    pair_rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", pair_rank.alias("rank")).select(columns).unionByName(
        leading_terms(cells, groups, top_terms).withColumn("part", F.lit("term")).select(columns))
