"""Quality scores: random Fourier features, ridge normal equations, isotonic calibration.

1. Every text gets a short vector of document statistics (one pass, no shuffle).
2. The vectors of the labelled training rows are standardised and mapped to
   random Fourier features, which approximate a Gaussian kernel. Each partition
   sums its share of the normal equations; ``FAN_IN`` sums meet in a task, and so on
   until one is left, which goes to the driver. Its size depends on the number of
   features alone.
3. Ridge scores are calibrated by isotonic regression over a histogram of fixed
   size, and every text is scored.

Only labels and statistics are shuffled. All labelled training rows are used.

Edge cases: a null text counts as empty and is scored as such. Rows without id
are scored but never train. A document labelled several times trains with the
mean of its labels. Repeated rows are scored each on its own. Without training
rows every score is 0.5. Very long texts are measured whole. Equal statistics score
alike. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, materialise, release
from .wordhash import text_chunks, words_of

STATISTICS = (
    "log_words", "word_bytes", "symbols", "separators", "upper", "shouts", "digits", "stops", "commas", "distinct", "repeated", "doubled", "words_a_line", "long_words",
)


#: Partial sums that one task adds.
FAN_IN = 16


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_CLASSES = {
    "symbols": _flags(b"#*$%&<>{}~^_=+"),
    "upper": _flags(bytes(range(65, 91))),
    "shouts": _flags(b"!"),
    "digits": _flags(b"0123456789"),
    "stops": _flags(b".?"),
    "commas": _flags(b",;:"),
}
_NEWLINE = _flags(b"\n")
_PIPE = _flags(b"|")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text, from the bytes of a chunk of texts."""
    n = len(offsets) - 1
    w = words_of(data, offsets)
    count = np.diff(w.bounds)
    per_word = np.maximum(count, 1)

    def bytes_of(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(flags[data], dtype=np.float64)])[offsets])

    def words_with(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[w.bounds])

    owner = np.repeat(np.arange(n), count)

    def distinct(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, owner))
        o, k = owner[order], key[order]
        first = np.ones(len(o), bool)
        first[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
        return np.bincount(o[first], minlength=n)

    size = w.end - w.start
    letters = np.maximum(words_with(size), 1)
    grams, valid = w.grams(3)
    n_grams = np.maximum(count - 2, 1)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    columns = [
        np.log1p(count),
        letters / per_word,
        bytes_of(_CLASSES["symbols"]) / letters,
        bytes_of(_PIPE) / per_word,
        bytes_of(_CLASSES["upper"]) / letters,
        bytes_of(_CLASSES["shouts"]) / per_word,
        bytes_of(_CLASSES["digits"]) / letters,
        bytes_of(_CLASSES["stops"]) / per_word,
        bytes_of(_CLASSES["commas"]) / per_word,
        distinct(owner, w.hash) / per_word,
        1 - distinct(owner[: len(grams)][valid], grams[valid]) / n_grams * (count > 2) - (count <= 2),
        words_with(same) / per_word,
        np.log1p(count / (bytes_of(_NEWLINE) + 1)),
        words_with(size >= 15) / per_word,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(data, offsets) for _, _, data, offsets in text_chunks(batch.column("text"))]
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


@dataclass(frozen=True)
class FourierFeatures:
    """A fixed random map: cos of random projections of standardised, clipped statistics."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, n: int, bandwidth: float, seed: int) -> FourierFeatures:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(0, 1 / bandwidth, (len(mean), n)), rng.uniform(0, 2 * np.pi, n))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        f = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([f, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _equations(batches: Iterator[pa.RecordBatch], features: FourierFeatures) -> Iterator[pa.RecordBatch]:
    """One row a partition: the flattened sums of z zᵀ and z y."""
    d = len(features.phase) + 1
    total = np.zeros(d * d + d)
    for batch in batches:
        if batch.num_rows:
            z, y = features(_matrix(batch.column("x"))), np.asarray(batch.column("y"))
            total += np.concatenate([(z.T @ z).ravel(), z.T @ y])
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column("s"):
            part = np.asarray(row.values)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of sorted points: centres and values of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, weight):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass(frozen=True)
class QualityModel:
    features: FourierFeatures | None
    coefficients: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.coefficients, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every text; written, as fit and scoring both read it."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("x", T.ArrayType(T.FloatType()))])
    return materialise(bound_batches(documents).select("doc_id", "text").mapInArrow(_measure, schema))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", n_features: int = 256, bandwidth: float = 3.0, ridge: float = 1e-3, seed: int = 7, bins: int = 1000) -> QualityModel:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    train = measured.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).join(known, "doc_id").select("x", "y")
    train = materialise(train)
    d = len(STATISTICS)
    moments = train.agg(F.count("*"), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return QualityModel(None, np.zeros(0), np.zeros(0), np.zeros(0))
    mean, scale = np.array(moments[1::2]), np.array(moments[2::2])
    features = FourierFeatures.draw(mean, np.where(scale > 1e-9, scale, 1.0), n_features, bandwidth, seed)
    parts = train.mapInArrow(lambda it: _equations(it, features), "s array<double>")
    sums = materialise(parts)
    n = sums.count()
    while n > 1:
        n = -(-n // FAN_IN)
        added = materialise(sums.repartition(n).mapInArrow(_add, "s array<double>"))
        release(sums)
        sums = added
    total = np.sum([np.asarray(r.s) for r in sums.collect()], axis=0)  # one row
    release(sums)
    k = n_features + 1
    a, b = total[: k * k].reshape(k, k), total[k * k :]
    coefficients = np.linalg.solve(a + ridge * moments[0] / n_features * np.eye(k), b)
    draft = QualityModel(features, coefficients, np.zeros(0), np.zeros(0))

    def bin_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.round(draft.raw(_matrix(batch.column("x"))) * (bins / 3)).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    # At most ``bins`` + 1 rows, whatever the number of training rows.
    rows = train.mapInArrow(bin_of, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    knots, values = pool_adjacent(np.array([r.bin * 3 / bins for r in rows]), np.array([r.y for r in rows]), np.array([float(r.n) for r in rows]))
    release(train)
    return QualityModel(features, coefficients, knots, values)


def score(measured: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    schema = T.StructType([measured.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return measured.mapInArrow(apply, schema).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def score_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, **options) -> DataFrame:
    """Measure, fit and score."""
    measured = measure(documents)
    return score(measured, fit(measured, labels, label, **options), threshold)
