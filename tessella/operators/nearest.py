"""Exact nearest neighbours of a block of queries: each task compares by matrix products and keeps what can win."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the table of distances that a task holds at once.
CELLS = 2_000_000


def near_pairs(vectors: DataFrame, queries: DataFrame, k: int, ident: str, vector: str, query_id: str) -> DataFrame:
    """(query_id, ident, distance): of each task and query the vectors that can be among the k nearest, ties included.

    ``queries``: (query_id, _q), a block that fits one task; it is collected and sent to
    all. Products rule pairs out with an allowance for their rounding; what is left gets its distance by differences.
    """
    asked = queries.select(query_id, "_q").collect()
    schema = T.StructType([queries.schema[query_id], vectors.schema[ident], T.StructField("distance", T.DoubleType())])
    sent = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in asked], [np.asarray(r[1], np.float64) for r in asked]))
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[schema[0].dataType.simpleString()]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = sent.value
        names = pa.array(ids, kind)
        sizes = np.array([len(q) for q in rows], np.int64)
        blocks = [Block(np.flatnonzero(sizes == d), np.stack([rows[i] for i in np.flatnonzero(sizes == d)]), k) for d in np.unique(sizes)]
        step = max(1, CELLS // max(1, len(rows)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                column = batch.column(vector)
                length = np.where(np.asarray(column.is_valid()), np.nan_to_num(np.asarray(column.value_lengths().fill_null(-1)), nan=-1), -1)
                for b in blocks:
                    own = np.flatnonzero(length == b.q.shape[1])
                    if not len(own):
                        continue
                    x = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), b.q.shape[1])
                    i, j, d = b.compare(x)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(b.at[j])), batch.column(ident).take(pa.array(own[i])), pa.array(d)], names=schema.names)

    return vectors.where(F.col(vector).isNotNull()).mapInArrow(near, schema)


class Block:
    """Queries of one length, and the k least squared distances to each that a task has seen."""

    def __init__(self, at: np.ndarray, q: np.ndarray, k: int):
        self.at, self.q, self.k = at, q, k
        self.norm = (q * q).sum(axis=1)
        self.best = np.full((k, len(q)), np.inf)

    def compare(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, distance) of the pairs that can be among the k nearest so far."""
        norm = (x * x).sum(axis=1)
        d = norm[:, None] - 2 * (x @ self.q.T) + self.norm[None, :]
        self.best = np.partition(np.vstack([self.best, d]), self.k - 1, axis=0)[: self.k]
        allowed = 1e-9 * (norm[:, None] + self.norm[None, :]) + 1e-12
        # Vectors that hold no number stay, as their distance is none.
        i, j = np.nonzero(d <= self.best.max(axis=0)[None, :] + allowed)
        diff = x[i] - self.q[j]
        return i, j, np.sqrt(np.einsum("ij,ij->i", diff, diff))
