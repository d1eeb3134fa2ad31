"""Quality classifier: random Fourier features over document statistics, ridge by partition sums, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Labelled rows that a fit uses at most, chosen by hash of their id.
FIT_ROWS = 200_000
#: Random Fourier features, ridge weight, folds of the calibration, threshold of a prediction.
FEATURES, RIDGE, FOLDS, ACCEPT = 384, 1.0, 4, 0.3
N_STATS = 22
_MARKS = (b"!", b"|", b"#$%&*", b".", b",", b"?;:", b"<>{}[]()/\\=_@~^", b"'\"`", b"-")
_CODES = [np.frombuffer(m, np.uint8) for m in _MARKS]


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; of null as of the empty text."""
    text = text or ""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    words, lines = text.split(), text.split("\n")
    n, chars = max(1, len(words)), max(1, len(data))
    seen = Counter(words)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    wide = counts[128:].sum()
    out = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(chars / n), len(seen) / n, max(seen.values(), default=0) / n, sum(map(eq, words, words[1:])) / n]
    out += [upper / max(1, upper + lower), digits / chars, wide / chars]
    out += [np.log1p(20 * counts[c].sum() / n) for c in _CODES]
    out += [np.log1p(len(lines) / n * 20), 1 - len(set(lines)) / len(lines), np.log1p(max(map(len, lines))), sum(map(str.isupper, words)) / n]
    return np.asarray(out, np.float32)


def _arrays(texts: pa.Array) -> pa.ListArray:
    flat = [statistics(t) for t in texts.to_pylist()]
    values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.float32), pa.float32())
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * N_STATS, values)


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) per row; maps only."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(batch.column(1))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<float>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _stats_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, N_STATS)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean score and value of each block of the monotone least-squares fit, by rising score.

    Equal scores are one point, with their mean and weight; then adjacent
    violators are pooled.
    """
    points, at = np.unique(x, return_inverse=True)
    weights = np.bincount(at).astype(float)
    blocks: list[list[float]] = []
    for w, a, b in zip(weights, weights * points, np.bincount(at, y)):
        blocks.append([w, a, b])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[1] / b[0] for b in blocks]), np.array([b[2] / b[0] for b in blocks])


def ridge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a + RIDGE * np.eye(len(b)), b)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> Model:
    """Fit on labelled rows of stats that aren't held out.

    Equal ids in labels count as their mean; null labels as none.  With no
    labelled row, or one class only, every score is the share of label 1 (0.5
    without labels).  Normal equations are summed by partition and fold.  Each
    row's raw score for the calibration comes from the other folds' equations,
    the weights from all.  What reaches the driver is FOLDS sums of FEATURES x
    FEATURES numbers a partition, one partition after the other, and the raw
    scores of at most fit_rows rows.
    """
    y = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    y = y.filter(~held_out())
    n = y.count()
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000))
    y = y.withColumn("bucket", bucket).filter(F.col("bucket") < int(1_000_000 * min(1.0, fit_rows / max(1, n))) + (n <= fit_rows))
    train = materialize(stats.join(y, "doc_id").select("stats", F.col("y").cast("double"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "quality-train")
    rng = np.random.default_rng(seed)
    one, zero = np.zeros(1), np.ones(1)

    def sums(batches):
        total = np.zeros(2 * N_STATS + 1)
        for batch in batches:
            x = _stats_of(batch.column(0))
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = train.coalesce(8).select("stats").mapInArrow(sums, "s array<double>").collect()
    total = np.sum([r["s"] for r in parts], axis=0) if parts else np.zeros(2 * N_STATS + 1)
    rows = total[-1]
    share = train.agg(F.avg("y")).first()[0]
    mean = total[:N_STATS] / max(1, rows)
    scale = np.sqrt(np.maximum(total[N_STATS:-1] / max(1, rows) - mean**2, 0)) + 1e-3
    # width of the Gaussian kernel: the mean squared distance of two standardized rows is 2 * N_STATS
    directions = rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS) * 1.5
    blank = Model(mean, scale, directions, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), one, zero * (0.5 if share is None else share))
    if share is None or share in (0.0, 1.0):
        return blank
    size = FEATURES + 1

    def normal(batches):
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            z, y_, fold = blank.features(_stats_of(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(fold):
                a[k] += z[fold == k].T @ z[fold == k]
                b[k] += z[fold == k].T @ y_[fold == k]
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.concatenate([a[k].ravel(), b[k]]).astype("<f8").tobytes()], pa.binary())], names=["fold", "s"])

    got = np.zeros((FOLDS, size * size + size))
    for r in train.coalesce(8).select("stats", "y", "fold").mapInArrow(normal, "fold int, s binary").toLocalIterator():
        got[r["fold"]] += np.frombuffer(r["s"], "<f8")
    solved = lambda g: ridge(g[:-size].reshape(size, size), g[-size:])
    others = np.stack([solved(got.sum(0) - got[k]) for k in range(FOLDS)], axis=1)

    def unseen(batches):
        for batch in batches:
            raw = blank.features(_stats_of(batch.column(0))) @ others
            yield pa.RecordBatch.from_arrays([pa.array(raw[np.arange(len(raw)), batch.column(2).to_numpy()]), batch.column(1)], names=["raw", "y"])

    kept = train.select("stats", "y", "fold").mapInArrow(unseen, "raw double, y double").toArrow()
    knots, values = isotonic(kept["raw"].to_numpy(), kept["y"].to_numpy())
    return Model(**{**vars(blank), "weights": solved(got.sum(0)), "knots": knots, "values": values})


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of stats."""

    def work(batches):
        for batch in batches:
            s = model.score(_stats_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = stats.mapInArrow(work, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of docs; null and empty texts are scored by the statistics of an empty text, repeated rows alike, other columns are ignored."""
    stats = materialize(statistics_table(docs), "quality-stats")
    return score(stats, fit(stats, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is ACCEPT or more, with all their columns.

    Statistics are taken once, and written beside the rows.  Null and empty
    texts are judged as an empty text is, repeated rows alike; without labels
    (or with one class) all rows have one score; an empty table gives no rows.
    """
    names = docs.columns
    at, mark = names.index("text"), "stats"
    while mark in names:
        mark += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.ArrayType(T.FloatType()))])

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _arrays(batch.column(at))], names=[*names, mark])

    both = materialize(docs.mapInArrow(work, schema), "quality-docs")
    model = fit(both.select("doc_id", F.col(mark).alias("stats")), labels)

    @F.pandas_udf("boolean")
    def accepts(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_list()).astype(np.float64)) >= ACCEPT) if len(stats) else pd.Series([], dtype=bool)

    return both.filter(accepts(F.col(mark))).select(*[f"`{c}`" for c in names])
