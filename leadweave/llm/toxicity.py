"""Toxicity scores by non-negative positive-unlabelled learning.

Texts with a confirmed toxic label are the positives, all of them; every other training text is
unlabelled, whatever its label says, because a missing or zero label doesn't make a text clean. Numpy classifiers over word
and word-beginning features minimise the risk that the class prior corrects: the part of the
unlabelled risk that the positives explain is taken out, and never below zero.

Only the fit uses bounded samples (``FitOptions``). The prior, the feature statistics and the
scores cover all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm.common import Hidden, fold_of, stage

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
LONGEST_WORD = 40
_CACHE = 300_000


@dataclass(frozen=True)
class FitOptions:
    """Bounds and settings of the fit. Samples are taken by a hash of the id, so reruns agree."""

    max_positive: int = 20_000
    max_unlabelled: int = 40_000
    max_candidates: int = 50_000
    max_features: int = 4_096
    min_log_odds: float = 1.5
    min_strength: float = 3.0
    classifiers: int = 2
    steps: int = 2_000
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings; a run too long for a word, as in scripts without spaces, its beginnings and the three-letter pieces inside it."""
    whole = ["=" + word] if len(word) <= LONGEST_WORD else sorted({"~" + word[i : i + 3] for i in range(len(word) - 2)})
    return whole + ["^" + word[:n] for n in PREFIXES if n < len(word)]


class FeatureWords(dict):
    """Word to the numbers of its known features, kept for words seen before; emptied when it grows too large."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        value = tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)
        if len(word) <= LONGEST_WORD:
            self[word] = value
        return value


def document_features(text: str | None, words: FeatureWords) -> Counter:
    """Known features of a whole text with the number of distinct words that carry them."""
    found: Counter = Counter()
    for word in set(LETTERS.findall((text or "").lower())):
        known = words[word]
        if known:
            found.update(known)
    return found


def _hash_share(id_column: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(id_column, F.lit("sample")), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)


def _maybe_in(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not in ``ids`` (one column): a bit for each hash, 4 MB for any number of ids.

    It only spares shuffling texts. Ids that share a bit pass, so an exact join has to follow.
    """
    kind = rows.schema[id_col].dataType
    place = lambda c: F.pmod(F.xxhash64(c.cast(kind)), F.lit(1 << 25))
    bits = ids.where(F.col(ids.columns[0]).isNotNull()).select(place(F.col(ids.columns[0])).alias("_place")).groupBy(
        F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position(place(F.col(id_col))).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(F.col(id_col))) == F.col("_bucket")).where(
        F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*rows.columns)


def _candidates(positive: DataFrame, least: int, most: int) -> dict[str, int]:
    """Features of at least ``least`` positive documents with their number, the most frequent first, ``most`` of them at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update({f for w in set(LETTERS.findall((text.as_py() or "").lower())) for f in word_features(w)})
                if len(found) > 500_000:
                    yield _counted(found, "n")
                    found = Counter()
        yield _counted(found, "n")

    counts = positive.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r["feature"]: r["n"] for r in counts.orderBy(F.desc("n"), "feature").limit(most).collect()}


def _counted(found: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["feature", name])


def _document_counts(rows: DataFrame, features: list[str]) -> dict[str, int]:
    """In how many of all ``rows`` each feature occurs. One row a feature and task is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = FeatureWords(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen[list(document_features(text.as_py(), words))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["feature", "n"])

    counts = rows.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    return {features[r["feature"]]: r["n"] for r in counts}


def _vectors(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a bounded sample: row starts, feature numbers, values."""
    shared = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = FeatureWords(shared.value)
        for batch in batches:
            found = [document_features(text.as_py(), words) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([
                pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([[float(np.log1p(n)) for n in f.values()] for f in found], pa.list_(pa.float32()))], ["at", "value"])

    table = rows.mapInArrow(run, "at array<int>, value array<float>").toArrow().combine_chunks()
    sizes = table["at"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
    flat = lambda name, kind: (table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)).astype(kind)
    return np.r_[0, np.cumsum(sizes)].astype(np.int64), flat("at", np.int64), flat("value", np.float64)


def _margins(part: np.ndarray, rows: tuple, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, at, value = rows
    sizes = starts[part + 1] - starts[part]
    owner = np.repeat(np.arange(len(part)), sizes)
    inside = np.repeat(starts[part] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    return np.bincount(owner, weights[at[inside]] * value[inside], minlength=len(part)), owner, at[inside], value[inside]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pu(positive: tuple, unlabelled: tuple, prior: float, size: int, options: FitOptions, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss.

    risk = prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]). Where the second part is
    below zero it is flat, and only the first one moves the weights.
    """
    random = np.random.default_rng(seed)
    weights, moment, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weights[-1] = np.log(prior / (1 - prior))
    n_pos, n_unl = len(positive[0]) - 1, len(unlabelled[0]) - 1
    for step in range(1, options.steps + 1):
        p, u = random.integers(0, n_pos, min(n_pos, 1000)), random.integers(0, n_unl, min(n_unl, 4000))
        grad = np.zeros(size + 1)
        zp, own_p, at_p, val_p = _margins(p, positive, weights)
        zu, own_u, at_u, val_u = _margins(u, unlabelled, weights)
        zp, zu = zp + weights[-1], zu + weights[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        plus = -prior * _sigmoid(-zp) / len(p)                      # of the positive part
        minus_u, minus_p = _sigmoid(zu) / len(u), -prior * _sigmoid(zp) / len(p)  # of the negative part
        if negative < 0:
            minus_u, minus_p = minus_u * 0, minus_p * 0
        gp = plus + minus_p
        grad[:-1] = np.bincount(at_p, gp[own_p] * val_p, minlength=size) + np.bincount(at_u, minus_u[own_u] * val_u, minlength=size)
        grad[-1] = gp.sum() + minus_u.sum()
        grad[:-1] += options.decay * weights[:-1]
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        weights = weights - options.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


@dataclass(frozen=True)
class ToxicityModel:
    features: list[str]
    weights: np.ndarray  # one row for each classifier, the bias last

    def score(self, found: Counter) -> float:
        at = list(found)
        z = self.weights[:, at] @ np.log1p(list(found.values())) + self.weights[:, -1] if at else self.weights[:, -1]
        return float(_sigmoid(z).mean())


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 folds: int = 3, held_out: int = 1, options: FitOptions = FitOptions()) -> ToxicityModel:
    """Learn from labels outside fold ``held_out`` and from the texts of the same folds.

    Without labels, positives or unlabelled texts, as with empty tables, the model is a bias at the prior
    (0.5 without labels).
    """
    known = labels.where(fold_of(F.col(id_col), folds) != held_out).where(F.col(label_col).isNotNull())
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col(label_col) == 1).cast("long")), F.lit(0)).alias("p")).first()
    share = count["p"] / count["n"] if count["n"] else 0.5
    nothing = ToxicityModel([], np.full((1, 1), np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    if not count["p"]:
        return nothing
    # Texts of training rows with any confirmed toxic label. They alone are positive and nothing else is left out of the unlabelled pool.
    train = docs.where(fold_of(F.col(id_col), folds) != held_out).select(id_col, F.col(text_col).cast("string").alias("_text"))
    toxic = known.where(F.col(label_col) == 1).select(F.col(id_col).alias("_positive")).distinct()
    labelled = known.select(F.col(id_col).alias("_labelled")).distinct()
    # Written down in between: the optimiser would else join first and shuffle all texts.
    maybe = stage(_maybe_in(train, id_col, toxic), "maybe-confirmed")
    confirmed = stage(maybe.join(toxic, F.col(id_col) == F.col("_positive"), "left_semi"), "confirmed")
    total, n_pos = train.count(), confirmed.count()
    n_unl, n_known = total - n_pos, train.select(id_col).join(labelled, F.col(id_col) == F.col("_labelled"), "left_semi").count()
    if not n_pos or not n_unl:
        return nothing
    # The threshold is a share of the rows that are counted: all confirmed ones.
    pos_counts = _candidates(confirmed.select("_text"), max(2, n_pos // 1000), options.max_candidates)
    if not pos_counts:
        return nothing
    all_counts = _document_counts(train.select("_text"), list(pos_counts))
    unl_counts = {f: all_counts.get(f, 0) - n for f, n in pos_counts.items()}
    odds = {f: np.log((n + 0.5) / (n_pos + 1)) - np.log((unl_counts[f] + 0.5) / (n_unl + 1)) for f, n in pos_counts.items()}
    # Strength of evidence: log odds in units of their standard error.
    strength = {f: odds[f] / np.sqrt(1 / (n + 0.5) + 1 / (unl_counts[f] + 0.5)) for f, n in pos_counts.items()}
    features = sorted((f for f in pos_counts if odds[f] >= options.min_log_odds and strength[f] >= options.min_strength), key=lambda f: (-strength[f], f))[: options.max_features]
    if not features:
        return nothing
    positive = confirmed.where(_hash_share(F.col(id_col), min(1.0, options.max_positive / n_pos))).select("_text")
    # Confirmed ids of the same share of hashes: no more of them than rows in the sample, so they can be sent to all tasks.
    in_sample = _hash_share(F.col(id_col), min(1.0, options.max_unlabelled / total))
    sampled_toxic = confirmed.where(in_sample).select(F.col(id_col).alias("_positive")).distinct()
    sample = train.where(in_sample).join(F.broadcast(sampled_toxic), F.col(id_col) == F.col("_positive"), "left_anti").select("_text")
    pos_rows, unl_rows = _vectors(positive, features), _vectors(sample, features)
    if len(pos_rows[0]) < 2 or len(unl_rows[0]) < 2:
        return nothing
    # The prior of the unlabelled pool: confirmed positives are outside it, unlabelled ones at their usual share inside.
    prior = min(max(n_pos / n_known * (total - n_known) / n_unl, 1e-3), 0.999)
    fitted = [fit_pu(pos_rows, unl_rows, prior, len(features), options, options.seed + k) for k in range(options.classifiers)]
    return ToxicityModel(features, np.array([np.r_[w, b] for w, b in fitted]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1,
                   threshold: float = 0.7, keep_columns: bool = False) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` for each row; with ``keep_columns`` all columns of ``docs`` and ``_score``.

    Null and empty texts have no features and get the score of the bias. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = FeatureWords({f: i for i, f in enumerate(model.features)})
        for batch in batches:
            scores = pa.array([model.score(document_features(t.as_py(), words)) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "_score"])

    if keep_columns:
        return docs.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("_score", T.DoubleType())]))
    at = 1
    scored = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kinds[id_col].dataType.simpleString()}, _text string, _score double")
    return scored.select(F.col(id_col), (fold_of(F.col(id_col), folds) == held_out).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    hidden = Hidden(docs)
    return score_toxicity(hidden.docs, model, text_col=text_col, keep_columns=True).where(F.col("_score") < threshold).select(*hidden.columns())
