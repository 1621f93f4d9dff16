"""Exact nearest neighbours with pivots: what the triangle inequality rules out is neither read nor compared.

At ingestion each vector is assigned to its nearest pivot and stored in that
pivot's cell with its distance to it; each cell keeps its number of vectors and the least and
greatest distance. A search looks into each query's nearest cells first, until they hold k
vectors; the k-th distance found bounds the rest. Cells that can't hold
anything nearer are pruned as partitions, and of the others only vectors are compared whose
distance to the pivot differs from the query's by no more than the bound. The
result is exact, whatever the pivots; they decide the share that is computed.

Pivots are chosen from a sample of at most ``SAMPLE`` rows; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import scratch, written

#: Rows that pivots are chosen from, and pivots.
SAMPLE, PIVOTS = 10_000, 64
#: Allowance for rounding, as a share of what is compared.
ROUNDING = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by differences, a row of ``a`` at a time in memory."""
    return np.stack([np.sqrt(((row - b) ** 2).sum(axis=1)) for row in a]) if len(a) else np.zeros((0, len(b)))


def choose_pivots(vectors: DataFrame, ident: str, vector: str, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Vectors of the sample far from each other: the first by the hash of its id, then always that which is farthest from those chosen."""
    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(ident), ident).select(vector).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r[0] for r in rows if len(r[0]) == len(rows[0][0])], np.float64)
    chosen, far = [0], np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
    return x[chosen]


@dataclass
class PivotIndex:
    """Vectors below ``path`` by cell; one row a cell is held: its number of vectors, and least and greatest distance to its pivot."""

    table: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray
    ident: str
    vector: str

    @classmethod
    def build(cls, vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", n: int = PIVOTS, path: str | None = None) -> PivotIndex:
        """Null vectors and those of another length than the pivots' aren't indexed."""
        spark = vectors.sparkSession
        path = path or scratch(spark)
        pivots = choose_pivots(vectors, ident, vector, n)
        sent = spark.sparkContext.broadcast(pivots)
        schema = T.StructType([vectors.schema[ident], vectors.schema[vector], T.StructField("to_pivot", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for batch in batches:
                d = distances(_matrix(batch.column(vector), p.shape[1]), p)
                cell = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(ident), batch.column(vector), pa.array(d[np.arange(len(d)), cell]), pa.array(cell.astype(np.int32))], names=schema.names)

        fit = vectors.select(ident, vector).where(F.size(vector) == pivots.shape[1]) if len(pivots) else vectors.select(ident, vector).limit(0)
        # Rebalanced by cell, so that a cell has few files and a hot one several.
        fit.mapInArrow(assign, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        table = spark.read.schema(schema).parquet(path)
        cells = table.groupBy("cell").agg(F.count("*").alias("n"), F.min("to_pivot").alias("least"), F.max("to_pivot").alias("most")).collect()
        size, least, most = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in cells:  # a row a pivot
            size[r.cell], least[r.cell], most[r.cell] = r.n, r.least, r.most
        return cls(table, pivots, size, least, most, ident, vector)

    def nearest(self, queries: DataFrame, k: int, query_id: str = "qid") -> tuple[DataFrame, DataFrame]:
        """(query_id, ident, distance, rank) of the k nearest of each query, ties by ident; and one row (computed, pairs) of the distances computed.

        ``queries``: (query_id, vector), a bounded set that is collected, as are its bounds, a row a query. A null
        query or one of another length finds nothing.
        """
        spark = queries.sparkSession
        schema = T.StructType([queries.schema[query_id], self.table.schema[self.ident], T.StructField("distance", T.DoubleType())])
        asked = [r for r in queries.select(query_id, self.vector).collect() if r[1] is not None and len(self.pivots) and len(r[1]) == self.pivots.shape[1]]
        if not asked:
            return spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())])), spark.createDataFrame([(0, 0)], "computed long, pairs long")
        ids, q = [r[0] for r in asked], np.array([r[1] for r in asked], np.float64)
        to = distances(q, self.pivots)
        order = np.argsort(to, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        first = np.zeros(to.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        allowed = ROUNDING * (1 + to)
        begun = written(self._compare(ids, q, to, first, np.full(len(q), np.inf), allowed, k, schema))
        bound = np.full(len(q), np.inf)
        for r in self._kth(begun, k).collect():  # a row a query
            bound[r["_q"]] = r["d"]
        lower = np.maximum(0, np.maximum(to - self.most, self.least - to))
        rest = ~first & (self.size > 0) & (lower <= bound[:, None] + allowed)
        further = written(self._compare(ids, q, to, rest, bound, allowed, k, schema))
        both = begun.unionByName(further)
        w = Window.partitionBy(query_id).orderBy("distance", self.ident)
        ranked = both.where("_q >= 0").drop("_q").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        told = both.where("_q < 0").agg(F.coalesce(F.sum("distance"), F.lit(0.0)).cast("long").alias("computed")).withColumn("pairs", F.lit(len(q) * int(self.size.sum())))
        return ranked, told

    def _kth(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("_q").orderBy("distance")
        return found.where("_q >= 0").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k).select("_q", F.col("distance").alias("d"))

    def _compare(self, ids: list, q: np.ndarray, to: np.ndarray, needs: np.ndarray, bound: np.ndarray, allowed: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
        """Pairs within each query's bound, in the cells that it needs; a row of query -1 has how many distances a batch took."""
        spark, ident, vector = self.table.sparkSession, self.ident, self.vector
        cells = [int(c) for c in np.flatnonzero(needs.any(axis=0))]
        sent = spark.sparkContext.broadcast((ids, q, to, needs, bound, allowed))
        kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[schema[0].dataType.simpleString()]

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, to, needs, bound, allowed = sent.value
            names, bound = pa.array(ids, kind), bound.copy()
            for batch in batches:
                x, cell, own = _matrix(batch.column(vector), q.shape[1]), np.asarray(batch.column("cell")), np.asarray(batch.column("to_pivot"))
                rows, asked, d, computed = [], [], [], 0
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    for j in np.flatnonzero(needs[:, c]):
                        near = at[np.abs(own[at] - to[j, c]) <= bound[j] + allowed[j, c]]
                        e = np.sqrt(((x[near] - q[j]) ** 2).sum(axis=1))
                        computed += len(near)
                        if len(e) >= k:
                            bound[j] = min(bound[j], np.partition(e, k - 1)[k - 1])
                        hit = e <= bound[j]
                        rows.append(near[hit])
                        asked.append(np.full(int(hit.sum()), j))
                        d.append(e[hit])
                i, j = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (rows, asked))
                columns = [pa.concat_arrays([names.take(pa.array(j)), pa.nulls(1, kind)]), pa.concat_arrays([batch.column(ident).take(pa.array(i)), pa.nulls(1, batch.column(ident).type)])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.append(np.concatenate(d) if d else [], float(computed))), pa.array(np.append(j, -1))], names=[*schema.names, "_q"])

        return self.table.where(F.col("cell").isin(cells)).mapInArrow(compare, T.StructType([*schema, T.StructField("_q", T.LongType())]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
