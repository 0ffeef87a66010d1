"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics come from the bytes and words of a whole text and are transformed (logarithms, square roots of shares) so
that classes are near normal. Each class gets a mean and a covariance shrunk towards the pooled one and then towards a
multiple of the identity; the Cholesky factors of both are computed once and reused for every document. The score is the
logistic of the difference of the two log densities plus that of the log priors, so it is 0.5 where both are alike.

Sums for the fit are aggregated on the executors: a batch sends one count, sum and cross-product per class. Documents
whose crc32(id) mod 5 is 0 are held out. The classifier reads only the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, ship

#: Shrinkage towards the pooled covariance, and of that towards its mean variance times the identity.
POOL = 0.3
RIDGE = 0.02
FOLDS = 5
CUT = 0.3
#: Log densities are tempered: words of one text are far from independent.
TEMPER = 0.5
FEW_CHARS, FEW_WORDS = 40, 8

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~=+_{}[]\\/"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True
_HIGH = np.arange(256) >= 128
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "bang", "stops", "distinct", "repeat_next", "bars", "lines", "high", "worst_line_symbols", "worst_line_upper", "worst_line_repeat")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text; an empty one has its own fixed point (all zeros)."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros(len(NAMES))
    n = len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    # shares are taken of a little more than the text has, so that a few words are no strong evidence
    solid = len(data) - count[_SPACE].sum() + FEW_CHARS
    letters = count[_UPPER].sum() + count[_LOWER].sum() + count[_HIGH].sum() + FEW_CHARS
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    worst = [0.0, 0.0, 0.0]
    for line in data.split(b"\n"):
        w = line.split()
        if len(w) < 6:
            continue
        c = np.bincount(np.frombuffer(line, np.uint8), minlength=256)
        size = len(line) - len(w) + 1 + FEW_CHARS
        worst[0] = max(worst[0], c[_SYMBOL].sum() / size)
        worst[1] = max(worst[1], c[_UPPER].sum() / (c[_UPPER].sum() + c[_LOWER].sum() + FEW_CHARS))
        worst[2] = max(worst[2], sum(map(bytes.__eq__, w, w[1:])) / (len(w) + FEW_WORDS))
    return np.array(
        [
            np.log1p(n),
            np.log((len(data) - count[_SPACE].sum()) / n),
            np.sqrt(count[_UPPER].sum() / letters),
            np.sqrt(count[_DIGIT].sum() / solid),
            np.sqrt(count[_SYMBOL].sum() / solid),
            np.sqrt(count[33] / solid),
            np.sqrt(count[_STOP].sum() / (n + FEW_WORDS)),
            np.log(distinct / n) / np.log(n + 1.0),
            np.sqrt(again / (n + FEW_WORDS)),
            np.sqrt(count[124] / (n + FEW_WORDS)),
            np.log1p(count[10] / (n + FEW_WORDS) * 100),
            np.sqrt(count[_HIGH].sum() / solid),
            *np.sqrt(worst),
        ]
    )


@dataclass(frozen=True)
class Model:
    """Means, Cholesky factors and log priors of the two classes (0, 1)."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    inverse_factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = []
        for mean, inv, det in zip(self.means, self.inverse_factors, self.log_dets):
            y = (z - mean) @ inv.T
            logs.append(-0.5 * (y * y).sum(axis=1) - det)
        margin = TEMPER * (logs[1] - logs[0]) + self.log_prior
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """The model from each class's count, sum and cross-products. A class without rows takes the other's moments."""
    p = len(NAMES)
    empty = (0.0, np.zeros(p), np.zeros((p, p)))
    parts = [sums.get(c, empty) for c in (0, 1)]
    total = sum(n for n, _, _ in parts)
    if total == 0:
        return Model(np.zeros(p), np.ones(p), (np.zeros(p),) * 2, (np.eye(p),) * 2, (0.0, 0.0), 0.0)
    centre = sum(s for _, s, _ in parts) / total
    spread = np.sqrt(np.maximum(np.diag(sum(q for _, _, q in parts)) / total - centre**2, 1e-6))
    means, covs = [], []
    for n, s, q in parts:
        m = s / n if n else centre
        c = q / n - np.outer(m, m) if n else np.zeros((p, p))
        means.append((m - centre) / spread)
        covs.append(c / np.outer(spread, spread))
    pooled = sum(n * c for (n, _, _), c in zip(parts, covs)) / total
    factors, dets = [], []
    for (n, _, _), c in zip(parts, covs):
        pool = max(POOL, 2 * p / (n + 2 * p))
        c = (1 - pool) * c + pool * pooled
        c = (1 - RIDGE) * c + RIDGE * max(np.trace(c) / p, 1e-3) * np.eye(p)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(float(np.log(np.diag(low)).sum()))
    prior = float(np.log((parts[1][0] + 1) / (parts[0][0] + 1)))
    return Model(centre, spread, tuple(means), tuple(factors), tuple(dets), prior)


def _features(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod FOLDS is 0; a null id's is that of the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def describe(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ``x``, the statistics, one row per input row: the only pass over the texts."""
    ship(df.sparkSession)
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(NAMES))


def fit(described: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on all labelled documents that are not held out; ids with several labels count once for each."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    rows = described.join(known, F.col("doc_id") == F.col("_id")).select("_y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            y, x = b.column(0).to_numpy(), _matrix(b.column(1))
            for c in (0, 1):
                z = x[y == c]
                if len(z):
                    n, s, q = acc.get(c, (0.0, 0.0, 0.0))
                    acc[c] = [n + len(z), s + z.sum(axis=0), q + z.T @ z]
        for c, (n, s, q) in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([float(n)]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], names=["c", "n", "s", "q"])

    sums = rows.mapInArrow(run, "c int, n double, s array<double>, q array<double>")
    p = len(NAMES)
    entries = sums.select("c", "n", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # 2 * p * (p + 1) numbers
    out = {}
    for c in (0, 1):
        mine = {r["i"]: r["v"] for r in entries if r["c"] == c}
        if mine:
            v = np.array([mine[i] for i in range(p + p * p)])
            out[c] = (next(r["n"] for r in entries if r["c"] == c), v[:p], v[p:].reshape(p, p))
    return fit_from_sums(out)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df`` but a ``score`` it had, and ``score``: 0 to 1, higher where label 1 is likelier."""
    ship(df.sparkSession)
    fields = [f for f in df.schema if f.name != "score"]
    src = df.select(*[F.col(f"`{f.name}`") for f in fields])
    at = [f.name for f in fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x) if len(x) else np.empty(0), pa.float64())], names=[*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return src.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def score_described(described: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score`` from ``describe``'s table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return described.select("doc_id", "x").mapInArrow(run, f"doc_id {described.schema['doc_id'].dataType.simpleString()}, score double")


def op5(df: DataFrame, labels: DataFrame) -> DataFrame:
    described = durable(describe(df))
    got = score_described(described, fit(described, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
