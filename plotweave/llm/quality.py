"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

The class means and covariances come from sums over all training rows, which Spark adds up; each covariance is
shrunk towards the pooled one and its diagonal. A score is the logistic of the class log-density difference, from
Mahalanobis distances by Cholesky factors that are computed once on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotweave.llm.arrow_text import chunks, sums, utf8
from plotweave.plans.durable import Scratch

FEATURES = ("size", "upper", "symbol", "bar", "digit", "stop", "space", "line", "other", "distinct", "top", "word")
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    kinds = np.full(256, 9, np.uint8)  # 9: letters
    for kind, chars in ((1, bytes(range(65, 91))), (2, b"#$%&*!@^~=<>_+\\{}[]"), (3, b"|"), (4, b"0123456789"), (5, b".,;:?'\"()-/"), (6, b" \t"), (7, b"\r\n"), (8, bytes(range(9)) + bytes(range(14, 32)))):
        kinds[list(chars)] = kind
    return kinds


_KIND = _classes()


def _words(text: str) -> tuple[int, int, int]:
    """Words, distinct words, occurrences of the most frequent word."""
    words = text.lower().split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return len(words), len(counts), max(counts.values(), default=0)


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of each text: logarithms of smoothed shares. Null texts count as empty."""
    data, offsets = utf8(column)
    kind = _KIND[data]
    n = np.diff(offsets).astype(np.float64)
    count = {k: sums(kind == k, offsets).astype(np.float64) for k in range(1, 9)}
    words = np.array([_words(t or "") for t in column.to_pylist()], np.float64).reshape(len(column), 3)
    share = lambda x, of, by=1.0: np.log((x + by * 0.5) / (of + by))
    return np.column_stack([
        np.log1p(n), *(share(count[k], n, 20.0) for k in range(1, 9)),
        share(words[:, 1], words[:, 0], 4.0), share(words[:, 2], words[:, 0], 20.0), np.log1p(n / np.maximum(words[:, 0], 1)),
    ])


class Discriminant:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, count: np.ndarray, total: np.ndarray, outer: np.ndarray, shrink: float = 0.3, ridge: float = 0.1):
        """count, total and outer hold, per class, the rows, the sum of x and the sum of x xT."""
        d = total.shape[1]
        self.trained = bool((count > 0).all())
        if not self.trained:  # one class alone: its share is the score
            self.constant = float(count[1] > 0) if count.sum() else 0.5
            return
        mean = total / count[:, None]
        scatter = np.stack([outer[k] - count[k] * np.outer(mean[k], mean[k]) for k in (0, 1)])
        pooled = scatter.sum(0) / max(count.sum() - 2, 1)
        target = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        self.mean, self.factor, self.base = mean, [], []
        for k in (0, 1):
            own = (1 - shrink) * scatter[k] / max(count[k] - 1, 1) + shrink * target
            chol = np.linalg.cholesky(own)
            self.factor.append(np.linalg.inv(chol))
            self.base.append(np.log(count[k] / count.sum()) - np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.trained:
            return np.full(len(x), self.constant)
        density = [self.base[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    for batch in chunks(batches, "text"):
        x = statistics(batch.column("text"))
        values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * d, pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "x"])


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row's whole text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_featured, "doc_id long, x array<double>")


def held_out(folds: int, fold: int):
    """True for rows that no classifier may learn from; false without an id, which has no label either."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, target: str = "quality") -> Discriminant:
    """Learn from all rows of ``rows`` (doc_id, x) that ``labels`` marks and that are not held out."""
    d = len(FEATURES)
    # rows without both columns can't be learnt from; a document with two labels counts with each
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("y in (0, 1)")
    train = rows.where(~held_out(4, 2)).join(marks, "doc_id")
    x = F.col("x")
    cells = [F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(d)), *(F.sum(x[i] * x[j]).alias(f"o{i}_{j}") for i in range(d) for j in range(i, d))]
    count, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in train.groupBy("y").agg(*cells).collect():  # two rows at most
        count[r["y"]] = r["n"]
        total[r["y"]] = [r[f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                outer[r["y"], i, j] = outer[r["y"], j, i] = r[f"o{i}_{j}"]
    return Discriminant(count, total, outer)


def _scorer(model: Discriminant):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(FEATURES)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return scored


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    The statistics of a text are computed once and written to the shared folder; fitting and scoring read them.
    Null texts score as empty ones; equal texts score alike. Rows of one id are scored each by its own text.
    With labels of one class alone the score is that class, without any label 0.5. Other columns are not read.
    """
    rows = Scratch(docs.sparkSession, "quality").write(featured(docs), "features")
    model = fit(rows, labels)
    scored = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keeper(model: Discriminant):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= THRESHOLD))

    return keep


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns; no text is shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(scratch.write(featured(docs), "features"), labels)
    scratch.drop("features")
    return docs.mapInArrow(_keeper(model), docs.schema)
