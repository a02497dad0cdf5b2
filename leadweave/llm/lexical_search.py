"""Ranked lexical search: the best documents of all for each item of a stated query set.

Documents are taken in blocks inside their tasks. For one item a block has a presence bitmap for each
of the item's terms; packed, they give every document a mask of the terms it holds. Documents with
equal masks are one group, whose score cannot exceed the sum of the block's largest contributions of
its terms. Groups are evaluated from the highest such maximum down, until it is below the item's
k-th score so far, which a task carries from block to block. Each task returns its best per item.

The query set goes to all tasks in parts of bounded size (``PART_BYTES``); document frequencies and
lengths are counted over all documents first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Item text sent to the tasks at once; documents of a block; postings after which a block is full.
PART_BYTES, BLOCK, BLOCK_POSTINGS = 4 << 20, 4096, 2_000_000
#: Letters A-Z lowered, digits and a-z kept, other ASCII to a space; bytes of other characters stay.
TERM_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def search_terms(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII in a UTF-8 text, with A-Z lowered."""
    return text.translate(TERM_BYTES).split() if text else []


@dataclass(frozen=True)
class Statistics:
    docs: int            # documents with at least one term
    terms: int           # all their terms
    weights: np.ndarray  # of each term of the query set

    def shares(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a term's occurrences count in documents of so many terms, in whole numbers."""
        m = np.array([10 + 90 * int(n) * self.docs // self.terms for n in lengths.tolist()], np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The ``k`` best (score, id) of one item so far: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nulls = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def bar(self) -> int:
        """No lower score can enter; one that is equal may."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.bar
        scores, ids, nulls = np.r_[self.scores, scores[good]], np.r_[self.ids, ids[good]], np.r_[self.nulls, nulls[good]]
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def group_masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks (as rows of booleans, one column a term) and each document's number among them, from one bitmap a term."""
    packed = np.packbits(present, axis=0)
    words = np.zeros((present.shape[1], -(-len(packed) // 8) * 8), np.uint8)
    words[:, : len(packed)] = packed.T
    words = words.view(np.uint64)
    first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)[1:]
    for word in words.T[1:]:
        values, inverse = np.unique(word, return_inverse=True)
        first, group = np.unique(group * len(values) + inverse, return_index=True, return_inverse=True)[1:]
    return present[:, first].T, group


def search_block(best: Best, present: np.ndarray, worth: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> int:
    """Bring ``best`` up to date with one block; returns how many documents were evaluated.

    ``present`` and ``worth`` have a row for each term and a column for each document.
    """
    most = worth.max(axis=1)
    if int(most.sum()) < best.bar:
        return 0
    masks, group = group_masks(present)
    bound = masks @ most
    by_group = np.argsort(group, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(group, minlength=len(masks)))]
    order, at, step, evaluated = np.argsort(-bound, kind="stable"), 0, 1, 0
    while at < len(order) and bound[order[at]] >= best.bar:
        part = order[at : at + step]
        part = part[bound[part] >= best.bar]
        docs = np.concatenate([by_group[starts[g] : starts[g + 1]] for g in part])
        best.add(worth[:, docs].sum(axis=0), ids[docs], nulls[docs])
        evaluated += len(docs)
        at, step = at + len(part), step * 2
    return evaluated


def _statistics(texts: DataFrame, vocabulary: dict[bytes, int]) -> Statistics:
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, docs, terms = shared.value, 0, 0
        holding = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(1):
                found = search_terms(text.as_py())
                docs, terms = docs + bool(found), terms + len(found)
                at = set(map(vocabulary.get, set(found)))
                at.discard(None)
                holding[list(at)] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2], pa.int64()), pa.array(np.r_[holding[at], docs, terms], pa.int64())], ["at", "n"])

    counts = {r["at"]: r["n"] for r in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    docs = counts.get(-1, 0)
    weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * counts.get(at, 0) + 1))) for at in range(len(vocabulary))]
    return Statistics(docs, counts.get(-2, 0), np.array(weights, np.int64))


def _search_part(texts: DataFrame, items: dict, item_kind: str, k: int) -> DataFrame:
    """``item, doc_id, score``: each task's best documents for the items (number to set of terms)."""
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*items.values())))}
    stats = _statistics(texts, vocabulary)
    wanted = {n: np.array(sorted(vocabulary[t] for t in terms), np.int64) for n, terms in items.items() if terms}
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, stats, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, stats, wanted = shared.value
        best = {n: Best(k) for n in wanted}
        ids, lengths, counts, held = [], [], [], 0

        def search() -> None:
            sizes = np.array([len(c) for c in counts], np.int64)
            doc = np.repeat(np.arange(len(counts)), sizes)
            term = np.fromiter((t for c in counts for t in c), np.int64, len(doc))
            tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(doc))
            worth = stats.shares(tf, np.repeat(np.array(lengths, np.int64), sizes)) * stats.weights[term]
            order = np.argsort(term, kind="stable")
            doc, worth = doc[order], worth[order]
            ends = np.cumsum(np.bincount(term, minlength=len(vocabulary)))
            nulls = np.array([i is None for i in ids])
            known = np.array([0 if i is None else i for i in ids], np.int64)
            for n, terms in wanted.items():
                terms = terms[ends[terms] > np.where(terms > 0, ends[terms - 1], 0)]
                if not len(terms):
                    continue
                values = np.zeros((len(terms), len(ids)), np.int64)
                present = np.zeros(values.shape, bool)
                for row, t in enumerate(terms):
                    own = slice(ends[t - 1] if t else 0, ends[t])
                    values[row, doc[own]] = worth[own]
                    present[row, doc[own]] = True
                search_block(best[n], present, values, known, nulls)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = search_terms(text.as_py())
                own = Counter(map(vocabulary.get, found))
                own.pop(None, None)
                if own:
                    ids.append(doc_id), lengths.append(len(found)), counts.append(own)
                    held += len(own)
                if len(ids) >= BLOCK or held >= BLOCK_POSTINGS:
                    search()
                    ids, lengths, counts, held = [], [], [], 0
        if ids:
            search()
        for n, own in best.items():
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(own.ids), pa.int64()), pa.array(own.ids, pa.int64(), mask=own.nulls), pa.array(own.scores, pa.int64())], ["_item", "doc_id", "score"])

    return texts.mapInArrow(run, "_item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for each item.

    * Null and empty texts have no terms: such documents are never found, such items find nothing.
    * Equal scores are ordered by id, null ids last; rows are documents, so a repeated row is found
      again. Item rows with one id are one item with the terms of all of them; a null id is an id.
    * An empty table on either side gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_bytes"))
    queries = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("_text"))
    kind = queries.schema["item_id"].dataType.simpleString()
    size = queries.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts, out = -(-size // PART_BYTES) or 1, None
    for part in range(parts):
        by_id: dict = {}
        for row in queries.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect():  # a part of bounded size
            by_id.setdefault(row["item_id"], set()).update(search_terms((row["_text"] or "").encode()))
        numbers = dict(enumerate(by_id))
        if not any(by_id.values()):
            continue
        names = docs.sparkSession.createDataFrame(list(numbers.items()), f"_item long, item_id {kind}")
        found = _search_part(texts, {n: by_id[i] for n, i in numbers.items()}, kind, k)
        order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
