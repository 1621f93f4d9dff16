"""Near-duplicate vectors of equal label, by randomised-rotation binary codes and exact cosines.

Codes. A unit vector o is rotated by random signs and Hadamard transforms; its
code is the signs of what comes out, and its factor a = <code, o> is stored, so
that <code, q> / a estimates <o, q> without bias. For a pair at cosine c, <code, q>
is a c plus an error of sqrt(1 - c^2) sqrt(1 - a^2) times one coordinate of a random
direction; the estimate's confidence bound takes that coordinate as at most
``EPSILON`` / sqrt(dimensions - 1), exceeded with a probability below 1e-8 (never, where
the quotient is 1 or more). Rotated vectors are compared as bytes, and the
length of what rounding takes off is added to the bound. Pairs that the bound
rules out in either direction go; all others get their exact cosine.

Candidates. A group of equal label and length that is larger than ``LIMIT`` isn't
compared whole: each run places every vector in one node by ``depth`` tokens (the
largest of ``WIDTH`` random projections and its sign), and as many runs are made as
find a pair at the threshold with probability ``RECALL``. The depth grows with the
group, so that nodes of unrelated vectors stay small at every size.

Scale. Equal vectors of a label are one member with a count. First only codes
meet, in blocks of at most ``LIMIT``; a large node is dealt as pairs of blocks over
tasks. The members with a candidate then meet their vectors in the same way. A
block pair returns at most a row a member (its links and a local root), never its
pairs, and a pair is counted in its first common node only. The time of a group of
similar vectors grows with the square of its distinct ones.

Edge cases. Rows whose label or vector is null, or whose vector is empty, zero or
holds null or non-finite components, link with nothing. Vectors of different
lengths have no cosine and don't link. A pair just at the threshold is linked.
Rows without vec_id link as others; a component's id is its least vec_id, or null
if none has one. ``kept`` is whether the row's vec_id is that id, so that all rows of a repeated
vec_id stay or go together. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jaccard_join import components
from .shared import bound_batches, drop_kept, materialise, release
from .wordhash import mix

THRESHOLD = 0.93
RECALL = 0.9999
EPSILON = 6.0
#: Random projections of one token, which has twice as many values.
WIDTH = 32
#: Members that a node of unrelated vectors has on average, at most.
AVERAGE = 128
MAX_DEPTH = 5
#: Most members of a group that is compared whole, and of a block.
LIMIT = 512

_U = np.uint64


@cache
def same_token(threshold: float, trials: int = 200_000) -> float:
    """Probability that a pair at the threshold has the same token: a simulation's estimate less three standard errors."""
    rng = np.random.default_rng(5)
    same = 0
    for _ in range(10):
        y = rng.normal(size=(trials // 10, WIDTH))
        z = threshold * y + math.sqrt(1 - threshold**2) * rng.normal(size=y.shape)
        same += int((_tokens(y) == _tokens(z)).sum())
    p = same / trials
    return p - 3 * math.sqrt(p * (1 - p) / trials)


def _tokens(y: np.ndarray) -> np.ndarray:
    at = np.abs(y).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(y, at[..., None], -1)[..., 0] > 0)


def depth_of(size: int) -> int:
    """Tokens of a node, for a group of so many members; 0: compared whole."""
    if size <= LIMIT:
        return 0
    return min(MAX_DEPTH, max(1, math.ceil(math.log(size / AVERAGE, 2 * WIDTH))))


def runs_of(depth: int, token: float, recall: float) -> int:
    return 1 if depth == 0 else math.ceil(math.log(1 - recall) / math.log(1 - token**depth))


def nodes_of(x: np.ndarray, group: int, size: int, token: float, recall: float) -> np.ndarray:
    """Nodes of unit vectors of one group: a column a run."""
    depth = depth_of(size)
    runs = runs_of(depth, token, recall)
    out = np.empty((len(x), runs), np.int64)
    for run in range(runs):
        node = np.full(len(x), mix(np.array([(group * 1_000_003 + run) % (1 << 64)], np.uint64))[0])
        if depth:
            planes = np.random.default_rng([17, run, x.shape[1]]).normal(size=(x.shape[1], depth * WIDTH))
            for t in _tokens((x @ planes).reshape(len(x), depth, WIDTH)).T:
                node = mix(node * _U(0xD6E8FEB86659FD93) + t.astype(np.uint64) + _U(1))
        out[:, run] = node.view(np.int64)
    return out


def rotated(x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Rows filled up with zeros to a power of two, under random signs and Hadamard transforms in turn."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([29, d]).choice([-1.0, 1.0], (rounds, d))
    for s in signs:
        y = y * s
        h = 1
        while h < d:
            z = y.reshape(len(y), d // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), d)
            h *= 2
        y = y / math.sqrt(d)
    return y


class Codes:
    """Signs, factors and bytes of rotated unit vectors."""

    __slots__ = ("error", "factor", "grain", "levels", "signs")

    def __init__(self, y: np.ndarray):
        d = y.shape[1]
        self.signs = y > 0
        self.factor = np.abs(y).sum(axis=1) / math.sqrt(d)
        self.grain = np.abs(y).max(axis=1) / 127
        self.levels = np.rint(y / self.grain[:, None]).astype(np.int8)
        self.error = np.sqrt(((y - self.levels * self.grain[:, None]) ** 2).sum(axis=1)) + 1e-6


def possible(signs: np.ndarray, factor: np.ndarray, levels: np.ndarray, grain: np.ndarray, error: np.ndarray, threshold: float, epsilon: float = EPSILON) -> np.ndarray:
    """Whether each pair's confidence bound reaches the threshold, in both directions."""
    d = signs.shape[1]
    code = np.where(signs, np.float32(1 / math.sqrt(d)), np.float32(-1 / math.sqrt(d)))
    seen = code @ levels.astype(np.float32).T * grain[None, :] + error[None, :]
    spread = min(1.0, epsilon / math.sqrt(max(1, d - 1)))
    least = factor * threshold - math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factor**2)) * spread
    reached = seen >= least[:, None] - 1e-5
    return reached & reached.T


def _sketch(batches: Iterator[pa.RecordBatch], threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    drop_kept()
    token = same_token(threshold)
    for batch in batches:
        group, size = np.asarray(batch.column("gid")), np.asarray(batch.column("size"))
        whole = batch.column("x")
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            x = whole.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
            x /= np.abs(x).max(axis=1)[:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            nodes = nodes_of(x, int(g), int(size[at[0]]), token, recall)
            c = Codes(rotated(x))
            signs, levels = np.packbits(c.signs, axis=1), c.levels
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("m").take(pa.array(at)),
                    pa.array(group[at]),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * nodes.shape[1], pa.int32()), pa.array(nodes.ravel())),
                    pa.array([s.tobytes() for s in signs], pa.binary()),
                    pa.array([v.tobytes() for v in levels], pa.binary()),
                    pa.array(c.factor),
                    pa.array(c.grain),
                    pa.array(c.error),
                ],
                names=["m", "gid", "nodes", "signs", "levels", "factor", "grain", "error"],
            )


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, of sorted batches, also where a group goes on in the next batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _to_compare(rows: pa.Table) -> np.ndarray:
    """Pairs that this block pair decides: of the two blocks, and in no earlier node together."""
    node, a, b = (rows.column(k)[0].as_py() for k in ("node", "a", "b"))
    todo = ~np.eye(rows.num_rows, dtype=bool)
    if a != b:
        own = np.asarray(rows.column("own"))
        todo &= own[:, None] != own[None, :]
    nodes = rows.column("nodes").combine_chunks()
    owner, flat = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(nodes.offsets))), np.asarray(nodes.flatten())
    early = flat < node
    owner, flat = owner[early], flat[early]
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    for members in np.split(owner, np.flatnonzero(flat[1:] != flat[:-1]) + 1):
        if len(members) > 1:
            todo[np.ix_(members, members)] = False
    return todo


_KEYS = ["gid", "node", "a", "b"]


def _bytes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float, epsilon: float) -> Iterator[pa.RecordBatch]:
    """The members of each block pair with a pair that the bounds don't rule out."""
    drop_kept()
    for rows in groups_of(batches, _KEYS):
        todo = _to_compare(rows)
        if todo.any():
            numbers = [np.asarray(rows.column(k)) for k in ("factor", "grain", "error")]
            signs, levels = np.unpackbits(_bytes(rows.column("signs"), np.uint8), axis=1), _bytes(rows.column("levels"), np.int8)
            todo &= possible(signs[:, : levels.shape[1]].astype(bool), numbers[0], levels, numbers[1], numbers[2], threshold, epsilon)
        found = pa.array(np.flatnonzero(todo.any(axis=1)))
        yield rows.select(["gid", "node", "m"]).take(found).combine_chunks().to_batches()[0] if len(found) else _none(rows.select(["gid", "node", "m"]))


def _none(rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in rows.schema], names=rows.schema.names)


def cosines(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # squares of very large or small components stay finite
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return (x @ x.T) / (n[:, None] * n[None, :])


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for rows in groups_of(batches, _KEYS):
        todo = _to_compare(rows)
        if todo.any():
            x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
            todo &= cosines(x) >= threshold
            todo &= todo.T
        at = np.flatnonzero(todo.any(axis=1))
        key = np.asarray(rows.column("m"))[at]
        linked = todo[np.ix_(at, at)]
        links = linked @ np.asarray(rows.column("copies"))[at]
        root = key.copy()
        while len(at):
            new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(links.astype(np.int64)), pa.array(root)], names=["set_key", "links", "root"])


def _dealt(placed: DataFrame, payload: DataFrame, n_parts: int) -> DataFrame:
    """Members of each node with their payload, as all pairs of the node's blocks, sorted within tasks."""
    sizes = placed.groupBy("gid", "node").agg(F.count("*").alias("n")).where("n > 1")
    g = F.ceil(F.col("n") / LIMIT).cast("int")
    # Pairs of blocks of one node go to one task after the other, so that a large node spreads evenly.
    slot = F.pmod(F.pmod(F.xxhash64("gid", "node"), F.lit(n_parts)) + F.expr("CAST(b AS BIGINT) * (b + 1) DIV 2 + a"), F.lit(n_parts)).cast("int")
    return (
        placed.join(sizes, ["gid", "node"])
        .withColumn("own", F.pmod(F.xxhash64("m"), g).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), g - 1)))
        .select("gid", "node", "m", "own", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"))
        .withColumn("slot", slot)
        .join(payload, "m")
        .repartitionById(n_parts, F.col("slot"))
        .drop("slot")
        .sortWithinPartitions(*_KEYS)
    )


def usable(label: str, vector: str):
    x = F.col(vector)
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(F.col(label).isNotNull() & F.forall(x, number) & F.exists(x, lambda c: c != 0), F.lit(False))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, epsilon: float = EPSILON) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("x"))
    good = rows.where(usable("label", "x"))
    distinct = good.groupBy("label", "x").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    members = materialise(distinct.withColumn("m", F.monotonically_increasing_id()))
    sizes = members.groupBy("label", F.size("x").alias("dim")).agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialise(sizes.withColumn("gid", F.monotonically_increasing_id()))
    grouped = members.withColumn("dim", F.size("x")).join(sizes, ["label", "dim"]).select("m", "gid", "size", "x")
    schema = "m long, gid long, nodes array<long>, signs binary, levels binary, factor double, grain double, error double"
    sketches = materialise(bound_batches(grouped).mapInArrow(lambda it: _sketch(it, threshold, recall), schema))

    placed = sketches.select("gid", "m", F.explode("nodes").alias("node"))
    met = _dealt(placed, sketches.drop("gid"), n_parts).mapInArrow(lambda it: _candidates(it, threshold, epsilon), "gid long, node long, m long")
    met = materialise(met.distinct())
    payload = members.select("m", "copies", "x").join(sketches.select("m", "nodes"), "m")
    compared = materialise(_dealt(met, payload, n_parts).mapInArrow(lambda it: _exact(it, threshold), "set_key long, links long, root long"))
    release(sketches, met, sizes)

    links = compared.groupBy(F.col("set_key").alias("m")).agg(F.sum("links").alias("links"))
    labels = components(compared.select("set_key", "root")).select(F.col("set_key").alias("m"), F.col("label").alias("c"))
    joined = members.join(links, "m", "left").join(labels, "m", "left").select(
        F.col("label").alias("l"),
        F.col("x").alias("y"),
        "rep",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("c", "m").alias("c"),
    )
    joined = materialise(joined)
    first = joined.groupBy("c").agg(F.min("rep").alias("component_id"))
    found = rows.join(joined.join(first, "c").select("l", "y", "n_links", "component_id"), (F.col("label") == F.col("l")) & (F.col("x") == F.col("y")) & usable("label", "x"), "left")
    component = F.when(F.col("l").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
