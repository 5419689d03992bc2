"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and towards its own diagonal. Scores
are differences of Mahalanobis log densities, computed with the classes' Cholesky factors (factored once, on the
driver), then mapped to a probability by a two-parameter logistic calibration.

The model is fitted on at most MAX_ROWS labelled rows, those with the smallest hashes of their ids; everything else
covers all rows and whole texts. Edge cases: null and empty texts have the statistics of an empty text and get a
score too; several labels of one document count as the lowest; without labels of both classes every score is the
share of label 1 (0.5 without any label); repeated rows each get a row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MAX_ROWS = 20_000
THRESHOLD = 0.3
SHRINK = (0.02, 0.1, 0.3, 0.6)

_CLASSES = {
    "upper": C.byte_class((0x41, 0x5A)),
    "digit": C.byte_class((0x30, 0x39)),
    "space": ~C.NOT_SPACE,
    "line": C.byte_class((0x0A, 0x0A)),
    "stop": C.byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x3A, 0x3B)),
    "shout": C.byte_class((0x21, 0x21), (0x3F, 0x3F)),
    "bar": C.byte_class((0x7C, 0x7C), (0x2F, 0x2F), (0x5C, 0x5C)),
    "symbol": C.byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5E, 0x60), (0x7E, 0x7E)),
    "quote": C.byte_class((0x22, 0x22), (0x27, 0x29), (0x2D, 0x2D), (0x5B, 0x5B), (0x5D, 0x5D), (0x7B, 0x7B), (0x7D, 0x7D)),
    "wide": C.byte_class((0xC0, 0xFF)),
}
_NOT_LINE = ~_CLASSES["line"]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.int64)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some], dtype=np.int64)
    return out


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=len(first) - 1)


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row per text: logs of counts and of smoothed shares."""
    n_bytes = np.diff(off)
    n_chars = n_bytes - _sums((raw & 0xC0) == 0x80, off)
    starts, ends, first = C.words(raw, off, C.NOT_SPACE)
    h = C.word_hashes(raw, starts, ends)
    n_words = np.diff(first)
    size = ends - starts
    share = lambda k, n: np.log((k + 0.5) / (n + 1.0))
    columns = [np.log1p(n_chars), np.log1p(n_words), np.log((n_bytes - _sums(_CLASSES["space"][raw], off) + 1) / (n_words + 1))]
    columns += [share(_sums(t[raw], off), n_chars) for t in _CLASSES.values()]
    columns.append(share(_distinct(h, first), n_words))
    columns.append(share(_sums(size > 12, first), n_words))
    columns.append(share(_sums(size <= 3, first), n_words))
    # words that end in something else than a letter, digit or wide character, and words without any lower-case letter
    tail = raw[ends - 1] if len(ends) else raw[:0]
    columns.append(share(_sums(~C.ALNUM[C.LOWER[tail]], first), n_words))
    low = np.concatenate([[0], np.cumsum(C.byte_class((0x61, 0x7A), (0x80, 0xFF))[raw], dtype=np.int32)])
    columns.append(share(_sums(low[ends] == low[starts], first), n_words))
    l_starts, l_ends, l_first = C.words(raw, off, _NOT_LINE)
    n_lines = np.diff(l_first)
    columns.append(share(n_lines - _distinct(C.word_hashes(raw, l_starts, l_ends), l_first), n_lines))
    return np.stack(columns, axis=1).astype(float)


@dataclass
class Model:
    """Means and Cholesky factors of both classes, and the calibration; without factors the score is `rate`."""

    rate: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    mu: tuple = ()
    inverse: tuple = ()
    log_det: tuple = ()
    slope: float = 1.0
    bias: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, by the number of statistics."""
        z = (x - self.mean) / self.scale
        logs = [-0.5 * (((z - m) @ i.T) ** 2).sum(axis=1) - d for m, i, d in zip(self.mu, self.inverse, self.log_det, strict=True)]
        return np.clip((logs[1] - logs[0]) / x.shape[1], -50, 50)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.bias, -40, 40)))


def _discriminant(x: np.ndarray, y: np.ndarray, shrink: float) -> Model:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    cov = [np.cov(z[y == k].T, bias=True) if (y == k).sum() > 1 else np.eye(z.shape[1]) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(cov))
    mu, inverse, log_det = [], [], []
    for k, c in enumerate(cov):
        own = (1 - shrink) * c + shrink * pooled
        own = (1 - shrink) * own + shrink * np.diag(np.diag(own)) + 0.01 * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        mu.append(z[y == k].mean(axis=0))
        inverse.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    return Model(y.mean(), mean, scale, tuple(mu), tuple(inverse), tuple(log_det))


def _calibrate(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the difference, by Newton steps with a small penalty on the slope."""
    w = np.array([1.0, 0.0])
    x = np.stack([d, np.ones_like(d)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + np.array([1e-2 * w[0], 0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit_arrays(x: np.ndarray, y: np.ndarray, folds: int = 5) -> Model:
    """The shrinkage and the calibration come from cross-validated differences."""
    if len(y) == 0:
        return Model()
    if min((y == 0).sum(), (y == 1).sum()) < folds:
        return Model(rate=float(y.mean()))
    fold = np.empty(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % folds
    best = None
    for shrink in SHRINK:
        d = np.empty(len(y))
        for f in range(folds):
            d[fold == f] = _discriminant(x[fold != f], y[fold != f], shrink).difference(x[fold == f])
        slope, bias = _calibrate(d, y)
        loss = log_loss(1 / (1 + np.exp(-np.clip(slope * d + bias, -40, 40))), y)
        if best is None or loss < best[0]:
            best = (loss, shrink, slope, bias)
    model = _discriminant(x, y, best[1])
    model.slope, model.bias = best[2], best[3]
    return model


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    own = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in C.chunks(batches, "text"):
            x = statistics(raw, off)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label").cast(pa.int32()), "x": pa.array(list(x), pa.list_(pa.float64()))})

    # at most max_rows pairs of numbers: small enough to broadcast whatever the corpus
    rows = docs.join(F.broadcast(own), "doc_id").select("doc_id", "text", "label").mapInArrow(features, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, x array<double>")
    got = sorted(rows.collect(), key=lambda r: (r[0], r[2]))
    return fit_arrays(np.array([r[2] for r in got], float), np.array([r[1] for r in got], int)) if got else Model()


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Adds score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in C.chunks(batches, "text"):
            p = model.score(statistics(raw, off))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "predicted": pa.array((p >= threshold).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def _training(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    C.tune(docs.sparkSession)
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return docs, labels.select(labels[doc_id].alias("doc_id"), labels[label].alias("label")).filter(fold_of(F.col("doc_id")) != 0)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose fold is 0 never train the model."""
    docs, labels = _training(docs, labels, label, doc_id, text)
    out = score(docs, fit(docs, labels, max_rows))
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, each judged by its own text, with all their columns."""
    model = fit(*_training(docs, labels, label, doc_id, text), max_rows)
    return C.keep_by_text(docs, text, lambda raw, off: model.score(statistics(raw, off)) >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"))
