"""Similarity self-join of texts by the Jaccard coefficient of their word 5-grams.

Chosen path. For each run a text's set of shingles is embedded as ``COORDINATES``
minhash tokens of the run's own. From a root for each run, every set follows the same rule: the path so
far chooses one coordinate, sometimes two (1/threshold on average), and the set
moves to the child named by its token there. Similar sets thus share a child in
expectation at every level. A node of at most ``limit`` distinct sets is a
leaf and is compared by brute force; a larger one splits further, up to
``MAX_DEPTH``. Runs repeat until a pair at the threshold shares a leaf with the
target probability.

Scale. Texts with equal sets are one member with a count, so copies cost one
row a task. Nodes with one member vanish, and of nodes with the same members
only the first stays. What is left meets its shingles and is compared in blocks
of bounded size: a large node is dealt as pairs of blocks over tasks, exact
overlaps come from matrix products, and a block pair returns at most one row a
member (its links and a local root), never its pairs. A pair is counted in its
first common node only. Components join the local roots over all nodes.

Shingles are counted as 40-bit hashes within a pair: of two sets of 1000, one
shingle in a million such pairs is taken for shared by chance.

Edge cases: words part at ASCII white space. Very long texts are compared whole. A
pair just at the threshold is linked. A text of one to four words has one
shingle of all its words; a null or empty text has none, is linked to nothing
and is a class of its own. Repeated rows are copies of each other. Rows without
id are linked as others; the class id is the least id of the class, or null.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, drop_kept, free_names, materialise, release
from .wordhash import mix, text_chunks, words_of

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
#: Minhash tokens of each run. Runs share none, so that they miss a pair independently.
COORDINATES = 16
MIN_DEPTH, MAX_DEPTH = 2, 4
#: Most members of a node that is not split further, and of a block.
LIMIT = 512

_U = np.uint64
_P = _U(0xD6E8FEB86659FD93)
#: Bytes of a shingle's hash that are compared.
BYTES = 5


def survival(threshold: float, depth: int) -> float:
    """Probability that a pair at the threshold still shares a node at that depth, for one run."""
    two = 1 / threshold - 1
    q = 1.0
    for _ in range(depth):
        c = threshold * q
        q = (1 - two) * c + two * (1 - (1 - c) ** 2)
    return q


def runs_needed(threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, MAX_DEPTH)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    n = len(offsets) - 1
    w = words_of(data, offsets)
    count = np.diff(w.bounds)
    owner = np.repeat(np.arange(n), count)
    g, ok = w.grams(k)
    at = np.flatnonzero(ok)
    texts, hashes = [owner[at]], [g[at]]
    for j in range(1, k):  # texts of fewer words: one shingle of them all
        short = np.flatnonzero(count == j)
        if len(short):
            h, _ = w.grams(j)
            texts.append(short)
            hashes.append(mix(h[w.bounds[short]] + _U(j)))
    text, key = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    text, key = text[first], key[first]
    return key, np.searchsorted(text, np.arange(n + 1))


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[_U(0)], np.cumsum(mix(sets), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).astype(np.int64)


def paths(sets: np.ndarray, bounds: np.ndarray, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the texts with shingles: (text, run x path, depth from MIN_DEPTH) and which paths exist."""
    starts = bounds[:-1]
    odd = np.random.default_rng(11).integers(1, 1 << 63, runs * COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
    tokens = np.empty((len(starts), len(odd)), np.uint64)
    for j, a in enumerate(odd):
        # The upper half of a product with an odd number orders the hashes anew.
        x = sets * a
        x ^= x >> _U(32)
        x *= a
        tokens[:, j] = np.minimum.reduceat(x, starts)
    rows = np.arange(len(starts))[:, None]
    two = _U(int((1 / threshold - 1) * 2**64))
    nodes = np.repeat(mix(np.arange(1, runs + 1))[None, :], len(starts), 0)
    alive = np.ones(nodes.shape, bool)
    history: list[np.ndarray] = []
    for depth in range(MAX_DEPTH):
        def child(salt: int) -> np.ndarray:
            own = np.arange(nodes.shape[1]) % runs * COORDINATES
            c = (mix(nodes + _U(salt)) % _U(COORDINATES)).astype(np.int64) + own
            return mix((nodes + _U(salt)) * _P + tokens[rows, c])

        second = alive & (mix(nodes + _U(3)) < two)
        nodes = np.hstack([child(1), child(2)])
        alive = np.hstack([alive, second])
        history = [np.hstack([h, h]) for h in history]
        if depth >= MIN_DEPTH - 1:
            history.append(nodes)
    return np.stack(history, axis=2).astype(np.int64), alive


def _embed(batches: Iterator[pa.RecordBatch], runs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    drop_kept()
    levels = MAX_DEPTH - MIN_DEPTH + 1
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column("text")):
            sets, bounds = shingle_sets(data, offsets)
            full = np.flatnonzero(np.diff(bounds))
            keys = set_keys(sets, bounds)
            counts = np.zeros(b - a, np.int64)
            flat = [np.zeros(0, np.int64)] * levels
            if len(full):
                nodes, alive = paths(sets, np.append(bounds[:-1][full], bounds[-1]), runs, threshold)
                counts[full] = alive.sum(axis=1)
                flat = [nodes[:, :, i][alive] for i in range(levels)]
            none = np.ones(b - a, bool)
            none[full] = False
            nodes_of = pa.StructArray.from_arrays([pa.array(x) for x in flat], names=[f"p{i}" for i in range(levels)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), nodes_of)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(keys, mask=none), lists], names=["doc_id", "text_key", "set_key", "nodes"]
            )


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column("text")):
            sets, bounds = shingle_sets(data, offsets)
            keys, small = set_keys(sets, bounds), np.ascontiguousarray(sets.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :BYTES])
            full = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[full]), pa.array([small[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary())], names=["set_key", "shingles"]
            )


def unpacked(shingles: bytes) -> np.ndarray:
    """The upper bytes of the hashes as numbers, in the order of the whole ones."""
    out = np.zeros((len(shingles) // BYTES, 8), np.uint8)
    out[:, 8 - BYTES :] = np.frombuffer(shingles, np.uint8).reshape(-1, BYTES)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def overlaps(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [a, a + step])
        x = np.zeros((m, step), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


#: Up to so many pairs of a block are compared one by one, more by matrix products.
FEW_PAIRS = 20_000


def _links(sets: list[np.ndarray], todo: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of ``todo`` (symmetric) at or above the threshold."""
    sizes = np.array([len(s) for s in sets], np.float64)
    todo = todo & (sizes[:, None] >= threshold * sizes[None, :]) & (sizes[None, :] >= threshold * sizes[:, None])
    linked = np.zeros(todo.shape, bool)
    at = np.flatnonzero(todo.any(axis=1))
    if not len(at):
        return linked
    if todo.sum() <= 2 * FEW_PAIRS:
        for i, j in zip(*np.nonzero(np.triu(todo))):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            linked[i, j] = linked[j, i] = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        return linked
    both = overlaps([sets[i] for i in at]).astype(np.float64)
    linked[np.ix_(at, at)] = both >= threshold * (sizes[at][:, None] + sizes[at][None, :] - both) - 1e-9
    return linked & todo


def _roots(linked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Least key of each member's component."""
    label = keys.copy()
    while True:
        seen = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, seen)
        if (new == label).all():
            return label
        label = new


def _compare_group(rows: list[tuple], threshold: float) -> list[tuple[int, int, int]]:
    """rows: (node, block a, block b, own block, set key, copies, other nodes, shingles) of one block pair."""
    node, a, b = rows[0][:3]
    keys = np.array([r[4] for r in rows], np.int64)
    copies = np.array([r[5] for r in rows], np.int64)
    todo = ~np.eye(len(rows), dtype=bool)
    if a != b:  # pairs within a block are compared where a == b
        own = np.array([r[3] for r in rows])
        todo &= own[:, None] != own[None, :]
    # A pair that an earlier node holds too is compared and counted there.
    earlier: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for k in r[6]:
            if k < node:
                earlier.setdefault(k, []).append(i)
    for members in earlier.values():
        if len(members) > 1:
            todo[np.ix_(members, members)] = False
    counted = _links([unpacked(r[7]) for r in rows], todo, threshold)
    if not counted.any():
        return []
    links = counted @ copies
    roots = _roots(counted, keys)
    return [(int(k), int(n), int(r)) for k, n, r, any_ in zip(keys, links, roots, counted.any(axis=1)) if any_]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, a, b): one group after the other, also across batches."""
    drop_kept()
    held: list[tuple] = []
    out: list[tuple[int, int, int]] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["set_key", "links", "root"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns = [part.column(n).to_pylist() for n in ("node", "a", "b", "own", "set_key", "copies", "others", "shingles")]
            for row in zip(*columns):
                if held and row[:3] != held[0][:3]:
                    out += _compare_group(held, threshold)
                    held = []
                held.append(row)
        yield flush()
    if held:
        out += _compare_group(held, threshold)
    yield flush()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(set_key, label): least key of each node's component, from edges (set_key, root).

    Every round takes the least label among the neighbours and then the label's
    own label, so that long chains halve. Aggregations are partial before the
    shuffle, so a hub of very many edges costs a row a task.
    """
    both = edges.where("set_key <> root").select(F.col("set_key").alias("u"), F.col("root").alias("v")).distinct()
    both = materialise(both.union(both.select("v", "u")).distinct())
    table = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("set_key"), F.least("u", "v").alias("label")))
    labels = table
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("set_key").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near.withColumnRenamed("u", "set_key"), "set_key").select("set_key", "label", F.least("label", "near").alias("step"))
        jump = labels.select(F.col("set_key").alias("step"), F.col("label").alias("jump"))
        new = materialise(stepped.join(jump, "step", "left").select("set_key", F.col("label").alias("old"), F.least("step", "jump").alias("label")))
        if new.where("label <> old").isEmpty():
            release(new, both)
            return labels
        release(table)
        table, labels = new, new.select("set_key", "label")
    raise RuntimeError("components did not settle")


def join_similar(df: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, limit: int = LIMIT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, text_key, class_id (least id of the class), class_key, n_links (documents at or above the threshold)."""
    runs = runs_needed(threshold, recall)
    levels = MAX_DEPTH - MIN_DEPTH + 1
    texts = df.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    node_type = T.ArrayType(T.StructType([T.StructField(f"p{i}", T.LongType()) for i in range(levels)]))
    schema = T.StructType([texts.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("set_key", T.LongType()), T.StructField("nodes", node_type)])
    embedded = materialise(bound_batches(texts).mapInArrow(lambda it: _embed(it, runs, threshold), schema))
    keyed = materialise(embedded.select("doc_id", "text_key", "set_key"))

    members = keyed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep_id"))

    # Down the tree: a node's distinct sets, those alone vanish, large nodes go one level deeper.
    paths_ = embedded.select("set_key", F.explode("nodes").alias("n")).select("set_key", "n.*")
    leaves, spent = None, [embedded]
    for i in range(levels):
        at = [f"p{j}" for j in range(i, levels)]
        rows = paths_.select("set_key", F.col(at[0]).alias("node")).distinct()
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum(F.xxhash64("set_key").cast("decimal(20,0)")).cast("string").alias("content")).where("size > 1")
        sizes = materialise(sizes)
        spent.append(sizes)
        done = sizes if i == levels - 1 else sizes.where(F.col("size") <= limit)
        found = rows.join(done, "node")
        leaves = found if leaves is None else leaves.unionByName(found)
        if i < levels - 1:
            large = sizes.where(F.col("size") > limit).select(F.col("node").alias(at[0]))
            if large.isEmpty():
                break
            paths_ = materialise(paths_.join(large, at[0], "left_semi").select("set_key", *at[1:]).distinct())
            spent.append(paths_)
    # Nodes with the same members: the first.
    all_leaves = materialise(leaves)
    release(*spent)
    first = all_leaves.groupBy("size", "content").agg(F.min("node").alias("node")).select("node")
    leaves = materialise(all_leaves.join(first, "node", "left_semi").select("set_key", "node", "size"))
    release(all_leaves)

    # Shingles of the members that are left, from their texts.
    held = leaves.groupBy("set_key").agg(F.collect_set("node").alias("others"))
    placed = materialise(held.join(members, "set_key"))
    wanted = placed.select(F.col("rep_id").alias("_id")).distinct()
    # Alike at every size: what is wanted grows with the corpus, so it is never sent to all tasks.
    payload = bound_batches(texts).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(_payload, "set_key long, shingles binary")
    payload = payload.groupBy("set_key").agg(F.first("shingles").alias("shingles"))
    held = materialise(placed.join(payload, "set_key"))

    # Blocks: a node of n members is compared as all pairs of its ceil(n / limit) blocks.
    n_blocks = F.ceil(F.col("size") / limit).cast("int")
    n_parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Pairs of blocks of one node, counted along the triangle, go to one task after the other, so that a large node spreads evenly.
    slot = F.pmod(F.pmod(F.xxhash64("node"), F.lit(n_parts)) + F.expr("CAST(b AS BIGINT) * (b + 1) DIV 2 + a"), F.lit(n_parts)).cast("int")
    dealt = (
        leaves.withColumn("g", n_blocks)
        .withColumn("own", F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("g")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("set_key", "node", "own", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"))
        .withColumn("slot", slot)
    )
    compared = (
        dealt.join(held, "set_key")
        .select("node", "a", "b", "own", "set_key", "copies", "others", "shingles", "slot")
        .repartitionById(n_parts, F.col("slot"))
        .drop("slot")
        .sortWithinPartitions("node", "a", "b")
        .mapInArrow(lambda it: _compare(it, threshold), "set_key long, links long, root long")
    )
    compared = materialise(compared)
    release(placed, held, leaves)

    links = compared.groupBy("set_key").agg(F.sum("links").alias("links"))
    labels = components(compared.select("set_key", "root"))
    linked = members.join(links, "set_key", "left").join(labels, "set_key", "left").select(
        "set_key",
        "rep_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("label", "set_key").alias("class_key"),
    )
    linked = materialise(linked)
    classes = linked.groupBy("class_key").agg(F.min("rep_id").alias("class_id"))
    by_set = linked.join(classes, "class_key").select("set_key", "n_links", "class_key", "class_id")
    alone = keyed.where(F.col("set_key").isNull()).select(
        "doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("class_key"), F.lit(0).cast("long").alias("n_links")
    )
    found = keyed.where(F.col("set_key").isNotNull()).join(by_set, "set_key")
    return found.select("doc_id", "text_key", "class_id", "class_key", "n_links").unionByName(alone)


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_one(df: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that stay: of each class the one of least id, and the texts without words.

    Of rows that are equal in id and text one stays; of texts without words with the same id, too.
    """
    found = join_similar(df, text=text, id_col=id_col, **options)
    key, id_, key_ = free_names(df, "text_key", "id2", "key2")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    first = found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(order).alias("m")).select("m.id", "m.key")
    alone = found.where(F.col("class_key").isNull()).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    stays = first.unionByName(alone).select(F.col("id").alias(id_), F.col("key").alias(key_)).distinct()
    keyed = df.withColumn(key, text_key(text))
    kept = keyed.join(stays.hint("merge"), F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_)), "left_semi")
    return kept.dropDuplicates([id_col, key]).select(*df.columns)
