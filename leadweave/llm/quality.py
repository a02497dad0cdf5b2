"""Document quality by hierarchical empirical Bayes.

A numpy classifier turns each text into evidence (log odds). Labels are also aggregated per host and
per path below it; each path's rate is shrunk towards its host's and each host's towards the
global rate, with strengths estimated from how much hosts, and paths inside hosts, differ beyond
chance. A document's score combines its evidence with the log odds of its path against the global rate.

Rates and strengths cover all labelled rows of the training folds; only the classifier's fit uses a
bounded sample (``max_rows``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm.common import fold_of, stage

FEATURES = ("words", "word_length", "distinct_words", "capitals", "digits", "marks", "repeated_lines", "sentence_words", "top_word")
_CAPITAL, _DIGIT, _MARK, _END = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d"), re.compile(r"[^\w\s]"), re.compile(r"[.!?](?=\s|$)")
SALTS = 16


def text_features(text: str) -> list[float]:
    """``FEATURES`` of a whole text; zeros for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts, lines = Counter(words), [line for line in text.split("\n") if line.strip()]
    length = len(text)
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / len(words), len(counts) / len(words), len(_CAPITAL.findall(text)) / length, len(_DIGIT.findall(text)) / length,
        len(_MARK.findall(text)) / length, 1 - len(set(lines)) / len(lines), len(words) / (1 + len(_END.findall(text))), counts.most_common(1)[0][1] / len(words)]


def with_features(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``id``, the columns ``keep`` and ``_x``, the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([text_features(t.as_py() or "") for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], x], [*batch.schema.names[1:], "_x"])

    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), id_col, *keep)
    return chosen.mapInArrow(run, T.StructType([*chosen.drop("_text").schema.fields, T.StructField("_x", T.ArrayType(T.DoubleType()))]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (bias last) of a ridge logistic regression by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.clip((x - mean) / spread, -8, 8), np.ones(len(x))]
    # Squares let a middle range be better than both ends.
    z = np.c_[z[:, :-1], z[:, :-1] ** 2, z[:, -1]]
    weights, penalty = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        change = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * weights)
        weights = weights + np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return mean, spread, weights


def evidence(mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> Column:
    """Log odds of the classifier over ``_x``, as an expression."""
    half = len(mean)
    z = [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("_x")[i] - float(mean[i])) / float(spread[i]))) for i in range(half)]
    terms = [float(weights[i]) * z[i] + float(weights[half + i]) * z[i] * z[i] for i in range(half)]
    return sum(terms[1:], terms[0]) + float(weights[-1])


def _strength(groups: DataFrame, parent: Column) -> float:
    """Prior strength by moments: how much group rates (y / n) vary around ``parent`` beyond binomial chance. Three sums come back."""
    row = groups.agg(
        F.sum((F.col("y") - F.col("n") * parent) ** 2 / F.col("n")).alias("spread"), F.sum(parent * (1 - parent)).alias("chance"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("weight")).first()
    if not row["weight"]:
        return 1.0
    # E[(y - n m)^2 / n] = m (1 - m) (1 + (n - 1) r), with r = 1 / (strength + 1).
    r = max(0.0, row["spread"] - row["chance"]) / max(1e-9, row["weight"] - row["chance"])
    return float(min(1e6, max(1.0, 1 / max(r, 1e-6) - 1)))


def site_posteriors(labelled: DataFrame, prior: float) -> DataFrame:
    """``_host, _path, host_posterior, path_posterior`` from ``_host, _path, _y``. Sums are partial before they are shuffled."""
    paths = stage(labelled.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_y").alias("y")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    strength = _strength(hosts, F.lit(prior))
    hosts = hosts.select("_host", ((F.col("y") + strength * prior) / (F.col("n") + strength)).alias("host_posterior"))
    below = stage(paths.join(hosts, "_host"), "below")
    inner = _strength(below, F.col("host_posterior"))
    return below.select("_host", "_path", "host_posterior", ((F.col("y") + F.lit(inner) * F.col("host_posterior")) / (F.col("n") + inner)).alias("path_posterior"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
                  label_col: str = "quality", folds: int = 3, held_out: int = 1, max_rows: int = 50_000, threshold: float = 0.5) -> DataFrame:
    """Id, ``held_out``, ``evidence``, ``host_posterior``, ``path_posterior``, ``score`` and ``predicted`` for each row of ``docs``.

    * A null host or path is a site of its own. Sites without labels have the posterior of the level above.
    * Null and empty texts have zero features and are scored like any other.
    * Of several labels of one id the lowest counts; rows that repeat an id are scored each, with its label.
    * Without labels the rate is 0.5 and the evidence 0. An empty table gives an empty result.
      Other columns are not read.
    """
    host, path = F.coalesce(F.col(host_col).cast("string"), F.lit("\0")), F.coalesce(F.col(path_col).cast("string"), F.lit("\0"))
    keyed = docs.withColumn("_host", host).withColumn("_path", path)
    rows = stage(with_features(keyed, id_col, text_col, ["_host", "_path"]), "features")
    known = labels.where(F.col(label_col).isNotNull()).where(fold_of(F.col(id_col), folds) != held_out).groupBy(id_col).agg(
        F.min(F.col(label_col).cast("double")).alias("_y"))
    labelled = stage(rows.join(known, id_col), "labelled")
    total = labelled.agg(F.count("*").alias("n"), F.coalesce(F.avg("_y"), F.lit(0.5)).alias("rate")).first()
    prior = min(max(total["rate"], 1e-3), 1 - 1e-3)
    odds = F.lit(0.0)
    if total["n"]:
        share = int(min(1.0, max_rows / total["n"]) * 1_000_003) + 1
        table = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < share).select("_x", "_y").toArrow()
        y = table["_y"].to_numpy()
        if 0 < y.sum() < len(y):
            odds = evidence(*fit_logistic(np.array(table["_x"].to_pylist()), y))
        else:
            odds = F.lit(float(np.log(prior / (1 - prior))))
    sites = stage(site_posteriors(labelled, prior), "sites")
    hosts = sites.groupBy("_host").agg(F.first("host_posterior").alias("_above"))
    # A site may hold a third of all rows: rows are salted, and the small site tables repeated for each salt.
    salted = rows.withColumn("evidence", odds).drop("_x").withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    repeated = lambda t: t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(repeated(sites), ["_host", "_path", "_salt"], "left").join(repeated(hosts), ["_host", "_salt"], "left")
    above = F.coalesce("host_posterior", "_above", F.lit(prior))
    logit = lambda p: F.log(p / (1 - p))
    final = joined.withColumn("host_posterior", above).withColumn("path_posterior", F.coalesce("path_posterior", above))
    score = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_posterior")) - float(np.log(prior / (1 - prior))))))
    return final.select(F.col(id_col), (fold_of(F.col(id_col), folds) == held_out).alias("held_out"), "evidence", "host_posterior", "path_posterior",
                        score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
