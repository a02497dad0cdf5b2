"""Language-model scores: a causal self-attention model over subword ids, and word counts as the base.

Word counts cover all training texts and are gathered in Spark; so are the subword counts, which
come from the counted words. They fix what the model predicts: each frequent subword is a class of its
own and the others share classes by frequency, so P(id) = P(class | context) * P(id | class, id before).
The attention model gives the first factor and the corpus counts the second.

The model is trained in numpy by federated averaging: every training text is read whole in the
windows of scoring, each task takes optimiser steps over its own windows, and the weights are averaged
in two levels. Scoring cuts a text into overlapping windows; each subword is predicted once, with
at least ``LEAD`` subwords of context where the text has them, by batched masked attention.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import fold_of, lower_words, stage

WINDOW, LEAD = 32, 8
STRIDE = WINDOW - LEAD
WIDTH, CLASSES, OWN_CLASSES = 16, 64, 48
OWN_ROWS, SHARED_ROWS = 4096, 1024
#: Words whose counts every task holds: at most so many, none longer than so many bytes. All other words are joined.
HOT_WORDS, HOT_BYTES = 1 << 17, 64
#: Rounds of federated averaging; each reads its own part of the training texts, so one pass covers all of them.
ROUNDS, BATCH = 2, 128
#: Windows that a task trains on at once.
PART_WINDOWS = 8192
#: Groups of the id before, by frequency; the weight of P(id | class) where an id and its group are rare together.
GROUPS, SMOOTH = 128, 10.0
_CACHE = 250_000
_COUNTER = 400_000
LN10 = float(np.log(10))


# Subwords -------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Subwords(dict):
    """Word (lower-cased UTF-8) to the bytes of its subword ids, 32 bits each; kept for words seen before, emptied when it grows too large.

    A word with its leading space is one piece for the merges; ids of many words are joined as bytes.
    """

    def __init__(self, path: str, pattern: str, always: Mapping[bytes, bytes] | None = None):
        super().__init__(always or {})
        self.encoding = _encoding(path, pattern)
        self.always = always or {}
        self.end = self.encoding.max_token_value + 1

    def begins_word(self) -> np.ndarray:
        """Which ids begin a word: those that carry its leading space, and the end."""
        return np.array([self.encoding.decode_single_token_bytes(i).startswith(b" ") for i in range(self.end)] + [True])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
            self.update(self.always)
        value = array("i", self.encoding._encode_single_piece(b" " + word)).tobytes()
        if len(value) <= 256:
            self[word] = value
        return value

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The ids of a text and the end."""
        return np.append(np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32), np.int32(self.end))


# The model ------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Classes:
    """What the corpus counts say about each id: class, input row, group, whether it begins a word, and log P(id | class, column).

    A column is the group of the id before; ids that begin a word, and the end, have a column of their own.
    """

    of: np.ndarray
    row: np.ndarray
    group: np.ndarray
    first: np.ndarray
    inside: np.ndarray
    prior: np.ndarray  # log P(class)

    def columns(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), GROUPS, np.int64)
        out[1:] = np.where(self.first.take(ids[1:]), GROUPS, self.group.take(ids[:-1]))
        return out


def _by_frequency(smooth: np.ndarray, parts: int, own: int) -> np.ndarray:
    """Part of each rank: the first ``own`` stand alone, the others fill the remaining parts with equal counts."""
    tail = np.cumsum(smooth[own:]) / smooth[own:].sum()
    return np.r_[np.arange(own), own + np.minimum((tail * (parts - own)).astype(np.int64), parts - own - 1)]


def _ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    return order, rank


def id_groups(counts: np.ndarray) -> np.ndarray:
    order, rank = _ranks(counts)
    return _by_frequency(counts[order] + 1.0, GROUPS, GROUPS * 3 // 4)[rank]


def make_classes(counts: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> Classes:
    """``counts`` by id; ``pairs`` by id and column."""
    order, rank = _ranks(counts)
    smooth = counts[order] + 1.0
    of_rank = _by_frequency(smooth, CLASSES, OWN_CLASSES)
    total = np.bincount(of_rank, smooth, minlength=CLASSES)
    of, alone = of_rank[rank], (smooth / total[of_rank])[rank]
    totals = np.zeros((CLASSES, GROUPS + 1))
    np.add.at(totals, of, pairs)
    inside = np.log((pairs + SMOOTH * alone[:, None]) / (totals[of] + SMOOTH)).astype(np.float32)
    places = np.arange(len(counts))
    row = np.where(places < OWN_ROWS, places, OWN_ROWS + places % SHARED_ROWS)
    return Classes(of.astype(np.int32), row[rank].astype(np.int32), id_groups(counts), first, inside, np.log((total + 1e-9) / total.sum()).astype(np.float32))


@dataclass(frozen=True)
class Model:
    embed: np.ndarray   # input rows
    place: np.ndarray   # positions in a window
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.query, self.key, self.value, self.out, self.bias]

    def pack(self) -> bytes:
        return b"".join(a.astype(np.float32).tobytes() for a in self.arrays())

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(OWN_ROWS + SHARED_ROWS, WIDTH), (WINDOW, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, CLASSES), (CLASSES,)]

    @staticmethod
    def unpack(flat: np.ndarray) -> Model:
        ends = np.cumsum([int(np.prod(s)) for s in Model.shapes()])
        return Model(*[part.reshape(s).astype(np.float32) for part, s in zip(np.split(flat, ends[:-1]), Model.shapes(), strict=True)])


def new_model(prior: np.ndarray, seed: int = 11) -> Model:
    random = np.random.default_rng(seed)
    draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    return Model(draw(OWN_ROWS + SHARED_ROWS, WIDTH, scale=0.3), draw(WINDOW, WIDTH, scale=0.1), *[draw(WIDTH, WIDTH, scale=WIDTH**-0.5) for _ in range(3)],
                 draw(WIDTH, CLASSES, scale=0.05), prior.astype(np.float32))


def _windows(line: np.ndarray) -> np.ndarray:
    """The windows of a line whose first LEAD places are context and whose others fill whole strides."""
    return line.take(np.arange(0, len(line) - LEAD, STRIDE)[:, None] + np.arange(WINDOW))


def _causal(first: int) -> np.ndarray:
    """0 where the query at window position ``first + i`` may look, else a large negative number."""
    return np.where(np.arange(WINDOW)[None, :] <= first + np.arange(WINDOW - first)[:, None], 0, -1e4).astype(np.float32)


def exponents(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp of ``values``, its sums over the last axis, and what was subtracted before: each row's maximum, or 0 where no sum overflows or vanishes without."""
    ones = np.ones(values.shape[-1], np.float32)
    summed = lambda a: (a.reshape(-1, a.shape[-1]) @ ones).reshape(a.shape[:-1])
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.exp(values)
        total = summed(out)
    if total.max(initial=0) < 1e26 and total.min(initial=1) > 1e-20:
        return out, total, 0.0
    top = values.max(axis=-1)
    np.subtract(values, top[..., None], out=out)
    np.exp(out, out=out)
    return out, summed(out), top


class Scorer:
    """Tables derived from a model for scoring: projections of every input row and position are computed once.

    The last row of the tables stands for places before a text. Its key has a component of its own that
    takes it out of every softmax.
    """

    def __init__(self, model: Model, classes: Classes, end: int):
        self.classes, self.model, self.end = classes, model, end
        scale = np.float32(WIDTH**-0.5)
        column = lambda rows, value: np.full((rows, 1), value, np.float32)
        rows, places = len(model.embed), len(model.place)
        self.pad = rows
        embed = np.r_[model.embed, np.zeros((1, WIDTH), np.float32)]
        self.left = np.c_[embed @ model.query * scale, column(rows + 1, 1), embed]
        self.left_place = np.c_[model.place[LEAD:] @ model.query * scale, np.zeros((STRIDE, 1 + WIDTH), np.float32)]
        away = column(rows + 1, 0)
        away[-1] = -1e4
        self.right = np.c_[embed @ model.key, away, embed @ model.value]
        self.right_place = np.c_[model.place @ model.key, column(places, 0), model.place @ model.value]
        self.mask = _causal(LEAD)

    def log10(self, documents: list[np.ndarray], windows: int = 128) -> np.ndarray:
        """log10 probability of each document, an array of ids whose last is the end id."""
        sums = np.zeros(len(documents))
        lines, targets, owners, held = [], [], [], 0
        for number, ids in enumerate(documents):
            inputs = np.empty(len(ids), np.int32)
            inputs[0], inputs[1:] = self.classes.row[self.end], self.classes.row.take(ids[:-1])
            classes = self.classes.of.take(ids)
            sums[number] += self.classes.inside[ids, self.classes.columns(ids)].sum(dtype=np.float64)
            for begin in range(0, len(ids), STRIDE * 1024):  # a very long text comes in parts that overlap as windows do
                end = min(len(ids), begin + STRIDE * 1024)
                count, lead = -(-(end - begin) // STRIDE), min(LEAD, begin)
                line, target = np.full(LEAD + count * STRIDE, self.pad, np.int32), np.full(count * STRIDE, -1, np.int32)
                line[LEAD - lead : LEAD + end - begin] = inputs[begin - lead : end]
                target[: end - begin] = classes[begin:end]
                lines.append(_windows(line))
                targets.append(target.reshape(count, STRIDE))
                owners.append(np.full(count, number))
                held += count
                if held >= 1024:
                    self._add(sums, np.concatenate(lines), np.concatenate(targets), np.concatenate(owners), windows)
                    lines, targets, owners, held = [], [], [], 0
        if held:
            self._add(sums, np.concatenate(lines), np.concatenate(targets), np.concatenate(owners), windows)
        return sums / LN10

    def _add(self, sums: np.ndarray, rows: np.ndarray, targets: np.ndarray, owners: np.ndarray, windows: int) -> None:
        lines = np.arange(windows * STRIDE)
        for begin in range(0, len(rows), windows):
            part, target = rows[begin : begin + windows], targets[begin : begin + windows].ravel()
            right = self.right.take(part, axis=0)
            right += self.right_place
            left = self.left.take(part[:, LEAD:], axis=0)
            left += self.left_place
            score = left[:, :, : WIDTH + 1] @ right[:, :, : WIDTH + 1].transpose(0, 2, 1)
            score += self.mask
            share, total, _ = exponents(score)
            hidden = share @ right[:, :, WIDTH + 1 :]
            hidden /= total[..., None]
            hidden += left[:, :, WIDTH + 1 :]
            logits = hidden.reshape(-1, WIDTH) @ self.model.out
            logits += self.model.bias
            _, total, top = exponents(logits)
            own = logits[lines[: len(target)], target]
            own -= np.log(total) + top
            own[target < 0] = 0
            sums += np.bincount(owners[begin : begin + windows], own.reshape(-1, STRIDE).sum(axis=1, dtype=np.float64), minlength=len(sums))


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of ``values`` by number."""
    counts = np.bincount(rows, minlength=size)
    present = np.flatnonzero(counts)
    order = np.argsort(rows.astype(np.uint16) if size <= 1 << 16 else rows, kind="stable")
    out = np.zeros((size, values.shape[1]), np.float32)
    out[present] = np.add.reduceat(values.take(order, axis=0), (np.cumsum(counts) - counts)[present], axis=0)
    return out


def gradients(model: Model, rows: np.ndarray, target: np.ndarray, lead: int = 0) -> tuple[float, list[np.ndarray]]:
    """Mean loss and gradients for windows of input rows and target classes (-1 where there is none; such inputs are in no softmax).

    The first ``lead`` positions are context only: they have no targets, and nothing is predicted there.
    """
    windows, width = rows.shape
    scale = np.float32(WIDTH**-0.5)
    away = np.where(rows < 0, -1e4, 0).astype(np.float32)[:, None, :]
    rows, target = np.maximum(rows, 0), target[:, lead:].ravel()
    embedded = model.embed.take(rows, axis=0)
    x = embedded + model.place
    asking = np.ascontiguousarray(x[:, lead:])
    # Products with a shared matrix are taken over all windows at once, not window by window.
    flat = lambda a: a.reshape(-1, a.shape[-1])
    times = lambda a, matrix: (flat(a) @ matrix).reshape(*a.shape[:-1], -1)
    q, k, v = times(asking, model.query * scale), times(x, model.key), times(x, model.value)
    att = q @ k.transpose(0, 2, 1)
    att += _causal(lead)
    if away.any():
        att += away
    att, total, _ = exponents(att)
    total = total[..., None]
    mixed = att @ v
    mixed /= total
    hidden = flat(mixed + embedded[:, lead:])
    logits = hidden @ model.out
    logits += model.bias
    own_at = (np.arange(len(target)), target)
    own = logits[own_at]
    share, sums, top = exponents(logits)
    keep = target >= 0
    count = max(1, int(keep.sum()))
    loss = float((np.log(sums) + top - own)[keep].sum() / count)
    # Rows are scaled where they are narrow: ``share`` times ``each`` is the gradient of the logits, ``att`` divided by ``total`` the attention.
    share[own_at] -= sums
    each = (keep * np.float32(1 / count) / sums)[:, None]
    d_hidden = share @ model.out.T
    d_hidden *= each
    hidden *= each
    d_hidden = d_hidden.reshape(mixed.shape)
    d_mixed = d_hidden / total
    d_score = d_mixed @ v.transpose(0, 2, 1)
    d_score -= np.einsum("bij,bij->bi", d_mixed, mixed)[..., None]
    d_score *= att
    d_q, d_k, d_v = d_score @ k * scale, d_score.transpose(0, 2, 1) @ q, att.transpose(0, 2, 1) @ d_mixed
    d_x = times(d_k, model.key.T)
    d_x += times(d_v, model.value.T)
    d_x[:, lead:] += times(d_q, model.query.T)
    d_place = (np.ones(windows, np.float32) @ d_x.reshape(windows, -1)).reshape(width, WIDTH)
    d_x[:, lead:] += d_hidden
    return loss, [
        _summed(rows.ravel(), flat(d_x), len(model.embed)), d_place, flat(asking).T @ flat(d_q), flat(x).T @ flat(d_k), flat(x).T @ flat(d_v),
        hidden.T @ share, each[:, 0] @ share]


def train_locally(model: Model, rows: np.ndarray, target: np.ndarray, rate: float, seed: int, lead: int = 0) -> Model:
    """One pass of Adam over a task's windows, whose first ``lead`` positions have no targets."""
    arrays = [a.copy() for a in model.arrays()]
    moment, square = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    order = np.random.default_rng(seed).permutation(len(rows))
    for step, begin in enumerate(range(0, len(order), BATCH), 1):
        part = order[begin : begin + BATCH]
        _, grads = gradients(Model(*arrays), rows[part], target[part], lead)
        level = float((1 - 0.99**step) ** 0.5)
        pace = rate * level / (1 - 0.9**step)
        for a, g, m, s in zip(arrays, grads, moment, square, strict=True):
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            np.square(g, out=g)
            g *= 0.01
            s += g
            np.sqrt(s, out=g)
            g += 1e-8 * level
            np.divide(m, g, out=g)
            g *= pace
            a -= g
    return Model(*arrays)


# Spark: counts, training, scores --------------------------------------------------------------------

@dataclass(frozen=True)
class LanguageModel:
    classes: Classes
    model: Model
    vocabulary: DataFrame  # word, n over the training texts, ids
    tokens: int            # N, ends included
    distinct: int          # V, the end included
    ends: int              # training texts
    path: str
    pattern: str


def word_counts(train: DataFrame) -> DataFrame:
    """``word, n`` over all texts (one column of bytes), counted in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(lower_words(text.as_py()))
                if len(found) > _COUNTER:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
                    found = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_ids(vocabulary: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``ids``, the subword ids of each word (32 bits each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(subwords.__missing__, batch.column(0).to_pylist()), pa.binary())], ["word", "n", "ids"])

    return vocabulary.select("word", "n").mapInArrow(run, "word binary, n long, ids binary")


def _flat_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words and how many each has."""
    found = ids.to_pylist()
    return np.frombuffer(b"".join(found), np.int32).astype(np.int64), np.fromiter(map(len, found), np.int64, len(found)) // 4


def subword_counts(vocabulary: DataFrame, ends: int, end: int) -> np.ndarray:
    """Corpus count of every id, from the counted words; as many numbers come back as there are ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            ids, sizes = _flat_ids(batch.column(0))
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = np.zeros(end + 1, np.int64)
    table = vocabulary.select("ids", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[table["id"].to_numpy()] = table["n"].to_numpy()
    counts[end] = ends
    return counts


def pair_counts(vocabulary: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Corpus count of every id by column (``Classes``), from the counted words; bounded by ids times columns."""
    group = id_groups(counts)
    shared = vocabulary.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        total = np.zeros(len(group) * (GROUPS + 1), np.int64)
        for batch in batches:
            ids, sizes = _flat_ids(batch.column(0))
            if len(ids):
                column = np.r_[GROUPS, group[ids[:-1]]]
                column[(np.cumsum(sizes) - sizes)[sizes > 0]] = GROUPS
                np.add.at(total, ids * (GROUPS + 1) + column, np.repeat(batch.column(1).to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    table = vocabulary.select("ids", "n").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(len(counts) * (GROUPS + 1), np.float64)
    pairs[table["at"].to_numpy()] = table["n"].to_numpy()
    pairs = pairs.reshape(len(counts), GROUPS + 1)
    pairs[-1, GROUPS] = counts[-1]
    return pairs


def text_windows(ids: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Input and target ids of the windows of scoring, at most PART_WINDOWS at once; every id of the text is a target once.

    -1 stands where there is none: inputs before and after a text, targets there and in the lead of a window.
    """
    before, count = np.append(np.int32(end), ids[:-1]), -(-len(ids) // STRIDE)
    for part in range(0, count, PART_WINDOWS):
        begin, stop = part * STRIDE, min(len(ids), (part + PART_WINDOWS) * STRIDE)
        lead, size = min(LEAD, begin), LEAD - (begin - stop) // STRIDE * STRIDE
        inputs, targets = np.full(size, -1, np.int32), np.full(size - LEAD, -1, np.int32)
        inputs[LEAD - lead : LEAD + stop - begin] = before[begin - lead : stop]
        targets[: stop - begin] = ids[begin:stop]
        rows, target = _windows(inputs), np.full((len(targets) // STRIDE, WINDOW), -1, np.int32)
        target[:, LEAD:] = targets.reshape(-1, STRIDE)
        yield rows, target


def train_model(encoded: DataFrame, lm: LanguageModel, rate: float = 0.01) -> Model:
    """Seeds and averages are per task, so weights, and with them ``score``, depend on how the input is partitioned.

    Federated averaging over the tasks of ``encoded`` (``encode_texts``), whole texts, each in one round; averages of averages, so that few models reach the driver."""
    spark = encoded.sparkSession
    classes, end = lm.classes, len(lm.classes.of) - 1
    model = lm.model
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, replace(classes, inside=None)))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            model, classes = shared.value
            number, seen, held, count = TaskContext.get().partitionId(), 0, [], 0

            def trained() -> Model:
                ids, wanted = (np.concatenate(parts) for parts in zip(*held, strict=True))
                return train_locally(model, np.where(ids >= 0, classes.row[ids], -1), np.where(wanted >= 0, classes.of[wanted], -1), rate / (turn + 1), 1000 * turn + number, LEAD)

            for batch in batches:
                for packed in batch.column(0):
                    for part in text_windows(unpack_ids(packed.as_buffer(), end), end):
                        held.append(part)
                        count += len(part[0])
                        if count >= PART_WINDOWS:
                            model, seen, held, count = trained(), seen + count, [], 0
            if count:
                model, seen = trained(), seen + count
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([number % 16], pa.int32()), pa.array([float(seen)]), pa.array([model.pack()], pa.binary())], ["part", "weight", "model"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = None, 0.0
            for batch in batches:
                for own, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    flat = np.frombuffer(packed.as_py(), np.float32) * np.float64(own)
                    total, weight = flat if total is None else total + flat, weight + own
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["part", "weight", "model"])

        kind = "part int, weight double, model binary"
        own = encoded.where(F.col("_turn") == turn).select("_ids")
        parts = own.mapInArrow(run, kind).repartition(16, "part").mapInArrow(average, kind).collect()
        if not parts:
            continue
        total = sum(r["weight"] for r in parts)
        model = Model.unpack(sum(np.frombuffer(r["model"], np.float32) * (r["weight"] / total) for r in parts))
    return model


def count_corpus(train: DataFrame, path: str, pattern: str, text_col: str = "text") -> LanguageModel:
    """The counts over all rows of ``train``, with an untrained model. Null texts are empty; an empty table gives zero counts."""
    vocabulary = stage(with_ids(word_counts(train.select(F.col(text_col).cast("binary"))), path, pattern), "words")
    ends = train.count()
    row = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    subwords = Subwords(path, pattern)
    counts = subword_counts(vocabulary, ends, subwords.end)
    classes = make_classes(counts, subwords.begins_word(), pair_counts(vocabulary, counts))
    return LanguageModel(classes, new_model(classes.prior), vocabulary, row["n"] + ends, row["v"] + (ends > 0), ends, path, pattern)


def fit_language_model(train: DataFrame, path: str, pattern: str, text_col: str = "text") -> LanguageModel:
    """Learn from all rows of ``train``. Null texts are empty; an empty table gives zero counts and an untrained model."""
    lm = count_corpus(train, path, pattern, text_col)
    texts = train.select(F.lit(None).cast("int").alias("_id"), text_col)
    return replace(lm, model=train_model(encode_texts(texts, lm, "_id", text_col, F.lit(True)), lm))


def _hot_words(vocabulary: DataFrame) -> dict[bytes, tuple[int, bytes]]:
    """Count and ids of the most frequent words, at most HOT_WORDS: whole steps of the count, from the top, as long as they fit."""
    step = F.floor(F.log2("n") * 16).cast("int")
    short = vocabulary.where(F.length("word") <= HOT_BYTES).withColumn("_step", step)
    least, total = 1 << 30, 0
    for row in sorted(short.groupBy("_step").agg(F.count("*").alias("c")).collect(), reverse=True):
        total += row["c"]
        if total > HOT_WORDS:
            break
        least = row["_step"]
    table = short.where(F.col("_step") >= least).select("word", "n", "ids").toArrow()
    return {w: (n, ids) for w, n, ids in zip(*(table[c].to_pylist() for c in ("word", "n", "ids")), strict=True)}


def pack_ids(ids: np.ndarray, end: int) -> bytes:
    return ids.astype(np.uint16 if end < 1 << 16 else np.int32).tobytes()


def unpack_ids(packed: bytes | pa.Buffer, end: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint16 if end < 1 << 16 else np.int32).astype(np.int32)


def encode_texts(docs: DataFrame, lm: LanguageModel, id_col: str, text_col: str, trains: Column) -> DataFrame:
    """Reads every text once, for training and scoring: its ids, what the frequent words say about it, and its other words for a join.

    ``_turn`` is the round in which a text trains, null where ``trains`` is not true. ``_row`` numbers the rows, so
    repeated rows and ids each get their result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_hot_words(lm.vocabulary))
    known_ends, size, path, pattern = lm.ends, lm.tokens + lm.distinct + 1, lm.path, lm.pattern
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        logs = {w: float(np.log10((n + 1) / size)) for w, (n, _) in shared.value.items()}
        subwords = Subwords(path, pattern, {w: ids for w, (_, ids) in shared.value.items()})
        unknown, end_log = repeat(float("nan")), float(np.log10((known_ends + 1) / size))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                tokens, known, base, ids, cold_words, cold_counts, ends = [], [], [], [], [], [], [0]
                for text in part.column(1):
                    words = lower_words(text.as_py())
                    values = np.fromiter(map(logs.get, words, unknown), np.float64, len(words))
                    rare = np.isnan(values)
                    rest = Counter(compress(words, rare.tolist()))
                    tokens.append(len(words) + 1)
                    known.append(len(words) - rest.total() + (known_ends > 0))
                    base.append(float(values.sum(where=~rare)) + end_log)
                    cold_words += rest
                    cold_counts += rest.values()
                    ends.append(len(cold_words))
                    ids.append(pack_ids(subwords.ids(words), subwords.end))
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(number, number + part.num_rows), pa.int64()), part.column(0), part.column(2), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(cold_words, pa.binary()), pa.array(cold_counts, pa.int64())], ["word", "n"]))],
                    ["_row", id_col, "_turn", "_ids", "n_tokens", "_known", "_base", "_cold"])
                number += part.num_rows

    text = F.col(text_col).cast("binary")
    turn = F.when(trains, F.pmod(F.xxhash64(text, F.lit("round")), F.lit(ROUNDS)).cast("int")).alias("_turn")
    return stage(docs.select(F.col(id_col), text, turn).mapInArrow(
        run, f"_row long, `{id_col}` {kind}, _turn int, _ids binary, n_tokens long, _known long, _base double, _cold array<struct<word: binary, n: long>>"), "encoded")


def score_encoded(encoded: DataFrame, lm: LanguageModel, id_col: str) -> DataFrame:
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((lm.model, lm.classes))
    size, end = lm.tokens + lm.distinct + 1, len(lm.classes.of) - 1
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value, end)
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                score = scorer.log10([unpack_ids(packed.as_buffer(), end) for packed in part.column(0)])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score, pa.float64())], [*part.schema.names[1:], "score"])

    scored = stage(encoded.select("_ids", "_row", F.col(id_col), "n_tokens", "_known", "_base").mapInArrow(
        run, f"_row long, `{id_col}` {kind}, n_tokens long, _known long, _base double, score double"), "scored")
    rare = encoded.select("_row", F.explode("_cold").alias("_word")).select("_row", F.col("_word.word").alias("word"), F.col("_word.n").alias("_times"))
    # Rare words carry few rows each, so this join has no hot key; the frequent ones were looked up in place.
    counted = rare.join(lm.vocabulary.select("word", "n"), "word", "left")
    sums = counted.groupBy("_row").agg(
        F.sum(F.col("_times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(size)))).alias("_rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("_times")).otherwise(0)).alias("_rare_known"))
    return scored.join(sums, "_row", "left").select(
        F.col(id_col), "n_tokens", (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).alias("n_known"), F.lit(lm.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rare_base", F.lit(0.0))).alias("base_score"), "score")


def score_language(docs: DataFrame, lm: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for each row of ``docs``.

    Null and empty texts are one token, the end. Rows are told apart by a number of their own, so
    repeated rows and ids each get their result. An empty table gives an empty result.
    """
    return score_encoded(encode_texts(docs, lm, id_col, text_col, F.lit(False)), lm, id_col)


def score_held_out(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Fit on the rows outside fold ``held_out`` and score all rows; adds ``held_out``. Each text is encoded once for both."""
    trains = fold_of(F.col(id_col), folds) != held_out
    lm = count_corpus(docs.where(trains), path, pattern, text_col)
    encoded = encode_texts(docs, lm, id_col, text_col, trains)
    return score_encoded(encoded, replace(lm, model=train_model(encoded, lm)), id_col).select(
        F.col(id_col), (fold_of(F.col(id_col), folds) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
