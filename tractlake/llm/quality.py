"""Quality by regularised quadratic discriminant analysis of document statistics.

Every whole text gives a vector of transformed statistics. Each class has a mean and a covariance shrunk towards a
diagonal one; the score is a calibrated difference of Gaussian log densities, whose Mahalanobis distances use Cholesky
factors that are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.common import Scratch, table
from tractlake.llm.labelled import held_out, logistic, sigmoid
from tractlake.llm.textkernel import text_bytes

SHRINK = 0.1
PREDICT = 0.3
#: Bins of the log-density difference over which the score is calibrated.
BINS, BIN_RANGE = 400, 200.0
# The characters whose shares are measured.
GROUPS = (b"#*$%&<>", b"!?", b"|", b"0123456789", b".,;:", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
N_FEATURES = 8 + len(GROUPS)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text: logs of counts, log odds of shares."""
    words = text.split()
    n, distinct = len(words), len(set(words))
    chars = sum(map(len, words))
    odds = lambda part, whole: float(np.log((part + 0.5) / (whole - part + 0.5)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    head = [np.log1p(n), np.log((chars + 1) / (n + 1)), odds(distinct, n), odds(pairs, max(0, n - 1)), odds(len(set(lines)), len(lines)), np.log1p(len(lines)), odds(max(map(len, lines), default=0), len(text)), odds(sum(len(w) == 1 for w in words), n)]
    return [*map(float, head), *(odds(len(text) - len(text.translate(None, g)), len(text)) for g in GROUPS)]


@dataclass
class Model:
    mean: np.ndarray  # of the two classes
    factor: np.ndarray  # Cholesky factors of their covariances
    constant: np.ndarray  # log prior less half the log determinant
    weights: np.ndarray  # calibration: constant and slope

    def __post_init__(self):
        # a triangular factor's inverse is triangular: found once, distances are products from then on
        self.whitening = np.array([np.tril(np.linalg.inv(f)) for f in self.factor])

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        out = []
        for k in (0, 1):
            z = self.whitening[k] @ (x - self.mean[k]).T
            out.append(self.constant[k] - 0.5 * (z * z).sum(axis=0))
        return np.clip(out[1] - out[0], -BIN_RANGE, BIN_RANGE)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.weights[0] + self.weights[1] * self.difference(x))


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "stats") -> DataFrame:
    """The key of every row and its text's statistics; null text is empty."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [key, name])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {name} array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of ``stats`` for each class ``y``, added up in tasks first."""
    size = N_FEATURES * (N_FEATURES + 1)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, N_FEATURES), np.array(batch.column(1).to_pylist())
            for k in set(y.tolist()):
                own = x[y == k]
                total[k] = total.get(k, np.zeros(1 + size)) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], ["y", "i", "v"])

    out: dict[int, np.ndarray] = {}
    for y, i, v in rows.select("stats", "y").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v")).collect():
        out.setdefault(y, np.zeros(1 + size))[i] = v
    return {y: (v[0], v[1 : 1 + N_FEATURES], v[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES)) for y, v in out.items()}


def fit(rows: DataFrame, shrink: float = SHRINK) -> Model | float:
    """A model of ``stats`` and ``y`` over all given rows, or the share of class 1 where a class has fewer than two rows."""
    sums = moments(rows)
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    if min(n.values()) < 2:
        return (n[1] + 1) / (n[0] + n[1] + 2)
    mean = np.array([sums[k][1] / n[k] for k in (0, 1)])
    cov = [sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = np.diag((n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])) + 1e-3
    own = [shrink + (1 - shrink) / (1 + n[k] / (10 * N_FEATURES)) for k in (0, 1)]  # few rows: shrunk further
    cov = [(1 - own[k]) * cov[k] + own[k] * np.diag(pooled) + 1e-6 * np.eye(N_FEATURES) for k in (0, 1)]
    factor = np.array([np.linalg.cholesky(c) for c in cov])
    constant = np.array([np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(factor[k])).sum() for k in (0, 1)])
    model = Model(mean, factor, constant, np.array([0.0, 1.0]))
    step = 2 * BIN_RANGE / BINS

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(model.difference(x) / step).astype(np.int32)), batch.column(1)], ["bin", "y"])

    bins = rows.select("stats", "y").mapInArrow(run, "bin int, y int").groupBy("bin", "y").count().collect()
    x, y, w = (np.array(c, dtype=float) for c in zip(*(((b + 0.5) * step, y, c) for b, y, c in bins), strict=True))
    model.weights = logistic(x[:, None], y, w, ridge=1e-3)
    return model


def score(stats: DataFrame, model: Model | float, key: str = "doc_id") -> DataFrame:
    """Key and score of every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, N_FEATURES)
            s = model.score(x) if isinstance(model, Model) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], [key, "score"])

    return stats.select(key, "stats").mapInArrow(run, f"`{key}` {stats.schema[key].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Key and score (0 to 1, higher: label 1 likelier) of every document, learned from all labelled rows outside the held-out fold.

    Null text is empty, and empty texts are scored like others; null keys are scored but never learned from; labels
    other than 0 and 1 are left out; repeated rows are scored, and learned from, as often as they stand. If a class has
    fewer than two rows, all scores are its smoothed share. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(with_statistics(docs, key, text), "statistics")
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("y"))
    model = fit(scratch.save(stats.join(known, key).select("stats", "y"), "labelled"))
    return score(stats, model, key)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from labels outside the held-out fold."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
