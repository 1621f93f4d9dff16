"""Repeated passages by sparse suffix arrays.

Suffixes are kept at content-selected positions only: the minimisers of the
16-word grams, of which every 50 adjacent words hold one.

1. Each text gives its anchors, a gram hash and a hash of the context that a
   50-word passage through the anchor can reach (34 words left, 50 right).
2. Anchors whose gram occurs once are dropped, as no passage repeats there.
   Anchors with the same whole context match left and right in full: the context
   is repeated, and one of them stands for all in what follows.
3. The suffixes of the others, their words as hashes, are sorted: ranges of grams
   over the tasks, suffixes in each. Neighbours are compared for their common
   prefix. Adjacent suffixes with ``r`` words in common are an interval; sorted anew
   by what stands left of the anchor, read backwards, neighbours in it are extended
   to the left. Those with ``50 - r`` words in common there repeat the passage of 50
   words that begins so many before the anchor. All intervals are taken, of 16 to
   50 words, as the suffix that matches furthest to the right need not be the one
   that matches furthest to the left. So the result is exact.

The result is the union of all 50-word windows that occur at least twice in the
corpus. Counts are summed in each task before the shuffle, so a passage in a
third of all documents costs a row a task; joins put one row a hash against the
rest and can be split. Texts are shuffled once, and only numbers otherwise.

A gram with more than ``GROUP`` different contexts isn't sorted in one task: all
windows of its anchors are hashed and counted instead, which gives the same
windows and spreads over any number of tasks.

Edge cases: a null text counts as empty; texts of fewer than ``MIN_WORDS`` words
have no passage. Very long texts are read whole. Words part at ASCII white space,
and are compared by 40 bits of their hashes. Passages that repeat inside
one text count. Copies of a text are repeated as a whole, repeated rows too.
Rows without id are counted and reported. Ties in any order change nothing. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, drop_kept, materialise, text_or_empty
from .wordhash import Words, mix, text_chunks, words_of

MIN_WORDS = 50
GRAM = 16
WINDOW = MIN_WORDS - GRAM + 1
LEFT, RIGHT = WINDOW - 1, MIN_WORDS
#: Most different contexts of a gram whose suffixes are sorted in one task.
GROUP = 2048
#: Bytes of a word in a suffix.
BYTES = 5

_U = np.uint64
_STEP = _U(0xA0761D6478BD642F)
_BACK = _U(pow(0xA0761D6478BD642F, -1, 1 << 64))


class Ranges:
    """Hashes of any ranges of words, from prefix sums."""

    def __init__(self, w: Words):
        n = len(w.hash)
        steps = np.full(n + 1, _STEP)
        steps[0] = 1
        backs = np.full(n + 1, _BACK)
        backs[0] = 1
        self.back = np.multiply.accumulate(backs)
        self.sums = np.concatenate([[_U(0)], np.cumsum(w.hash * np.multiply.accumulate(steps)[:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of MIN_WORDS words inside a text, and its anchor."""
    n = len(w.hash) - MIN_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, _ = w.grams(GRAM)
    owner = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    start = np.flatnonzero(owner[:n] == owner[MIN_WORDS - 1 :])
    best = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1)
    return start, start + best[start]


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, text, gram hash and context hash of the anchors."""
    _, at = windows(w)
    at = np.unique(at)
    text = np.searchsorted(w.bounds, at, "right") - 1
    first, end = np.maximum(at - LEFT, w.bounds[text]), np.minimum(at + RIGHT, w.bounds[text + 1])
    r = Ranges(w)
    context = mix(r(first, end) + (at - first).astype(np.uint64) * _U(1000) + (end - at).astype(np.uint64))
    return at - w.bounds[text], text, r(at, at + GRAM), context


_ANCHOR = [("p", "int"), ("k", "long"), ("c", "long")]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column("text")):
            w = words_of(data, offsets)
            at, text, gram, context = anchors(w)
            rows = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(gram.astype(np.int64)), pa.array(context.astype(np.int64))], names=["p", "k", "c"])
            bounds = np.searchsorted(text, np.arange(b - a + 1))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(np.diff(w.bounds), pa.int32()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)],
                names=["doc_id", "key", "n_words", "anchors"],
            )


_PROBED = "kind int, k long, right binary, left binary, key long, p int, n long"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each anchor in the row's list ``probes`` its suffix and what stands left of it, read backwards (kind 0).

    Of anchors of large groups instead all windows (kind 1): hash, first word and weight as k, p and n.
    """
    drop_kept()
    for batch in batches:
        probes = batch.column("probes").to_pylist()
        keys = np.asarray(batch.column("key"))
        for a, b, data, offsets in text_chunks(batch.column("text")):
            w = words_of(data, offsets)
            ahead = np.ascontiguousarray(w.hash.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :BYTES])
            right_of, left_of, total = ahead.tobytes(), np.ascontiguousarray(ahead[::-1]).tobytes(), len(w.hash)
            weight = np.zeros(total, np.int64)
            grams, places, counts, owners, rights, lefts = [], [], [], [], [], []
            for i in range(a, b):
                base, end = int(w.bounds[i - a]), int(w.bounds[i - a + 1])
                for x in probes[i]:
                    at = base + x["p"]
                    if x["large"]:
                        weight[at] = x["n"]
                        continue
                    grams.append(x["k"])
                    places.append(x["p"])
                    counts.append(x["n"])
                    owners.append(keys[i])
                    rights.append(right_of[at * BYTES : min(at + RIGHT, end) * BYTES])
                    lefts.append(left_of[(total - at) * BYTES : (total - at + min(LEFT, x["p"])) * BYTES])
            yield _rows(0, grams, rights, lefts, owners, places, counts)
            if weight.any():
                start, at = windows(w)
                keep = weight[at] > 0
                start, at = start[keep], at[keep]
                text = np.searchsorted(w.bounds, start, "right") - 1
                hashes = Ranges(w)(start, start + MIN_WORDS).astype(np.int64)
                none = [None] * len(start)
                yield _rows(1, hashes, none, none, keys[a + text], start - w.bounds[text], weight[at])


def _rows(kind: int, k, right, left, key, p, n) -> pa.RecordBatch:
    columns = [pa.array([kind] * len(p), pa.int32()), pa.array(k, pa.int64()), pa.array(right, pa.binary()), pa.array(left, pa.binary())]
    columns += [pa.array(key, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "k", "right", "left", "key", "p", "n"])


def common_words(a: bytes, b: bytes) -> int:
    """Length in words of the common prefix."""
    lo, hi = 0, min(len(a), len(b)) // BYTES
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * BYTES : mid * BYTES] == b[lo * BYTES : mid * BYTES]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def extend_neighbours(right: list[bytes], left: list[bytes]) -> np.ndarray:
    """For suffixes in order, and for each number of words left of the anchor, whether another one has the window of MIN_WORDS that begins there."""
    m = len(right)
    found = np.zeros((m, LEFT + 1), bool)
    shared = np.array([common_words(a, b) for a, b in zip(right, right[1:])], np.int64)
    rank = np.empty(m, np.int64)
    order = sorted(range(m), key=left.__getitem__)
    rank[order] = np.arange(m)
    padded = np.frombuffer(b"".join(x.ljust(LEFT * BYTES, b"\0") for x in left), np.uint8).reshape(m, LEFT * BYTES)
    reach = np.array([len(x) // BYTES for x in left], np.int64)
    for r in range(GRAM, RIGHT + 1):
        cut = shared < r
        if cut.all():
            break
        interval = np.concatenate([[0], np.cumsum(cut)])
        at = np.lexsort((rank, interval))
        a, b, n = at[:-1], at[1:], RIGHT - r
        same = (interval[a] == interval[b]) & (reach[a] >= n) & (reach[b] >= n)
        a, b = a[same], b[same]
        same = (padded[a, : n * BYTES] == padded[b, : n * BYTES]).all(axis=1)
        found[a[same], n] = found[b[same], n] = True
    return found


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in order of gram and words: the repeated spans (key, s, e) of those that stand for themselves alone."""
    drop_kept()
    held: list[tuple] = []
    out: list[tuple[int, int, int]] = []

    def close() -> None:
        if len(held) == 2:
            # Two suffixes share one passage: as far as both agree to either side.
            before, after = common_words(held[0][2], held[1][2]), common_words(held[0][1], held[1][1])
            if before + after >= MIN_WORDS:
                out.extend((key, p - before, p + after) for _, _, _, key, p, n in held if n == 1)
        elif len(held) > 2:
            found = extend_neighbours([x[1] for x in held], [x[2] for x in held])
            # Windows that begin at adjacent words are one span.
            edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            for (i, least), most in zip(np.argwhere(edges > 0).tolist(), np.argwhere(edges < 0)[:, 1].tolist()):
                _, _, _, key, p, n = held[i]
                if n == 1:
                    out.append((key, p - most + 1, p - least + MIN_WORDS))
        held.clear()

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("k", "right", "left", "key", "p", "n"))):
            if held and held[0][0] != row[0]:
                close()
            held.append(row)
        yield _spans(out)
    close()
    yield _spans(out)


def _spans(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [(), (), ()]
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["key", "s", "e"])


def repeated_passages(df: DataFrame, text: str = "text", id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """One row a maximal repeated passage: doc_id, start and end (words, end exclusive), n_words of the text."""
    texts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("key"), F.col(text).alias("text"))
    kind = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("c", T.LongType())]))
    schema = T.StructType([texts.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("anchors", kind)])
    found = materialise(bound_batches(texts).mapInArrow(_anchors, schema))

    # Contexts of the grams that occur more than once, each with its count and one place.
    each = found.select("doc_id", "key", F.explode("anchors").alias("a")).select("doc_id", "key", "a.*")
    # Written before they are joined: a join with an aggregation below can't be split where a key is hot.
    often = materialise(each.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    # A context has one gram. Grouped by the context alone, rows of one frequent gram are summed before they meet.
    contexts = each.join(often, "k", "left_semi").groupBy("c").agg(F.first("k").alias("k"), F.count("*").alias("n"), F.min(F.struct("key", "doc_id", "p")).alias("at"))
    contexts = materialise(contexts)

    copied = found.where(F.col("n_words") >= MIN_WORDS).groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key")
    copied = materialise(copied)
    single = found.join(copied, "key", "left_anti")

    # Whole contexts that occur again.
    whole = contexts.where("n > 1").select("c")
    full = (
        single.select("key", "n_words", F.explode("anchors").alias("a"))
        .select("key", "n_words", "a.*")
        .join(whole, "c", "left_semi")
        .select("key", F.greatest(F.col("p") - LEFT, F.lit(0)).alias("s"), F.least(F.col("p") + RIGHT, F.col("n_words")).alias("e"))
    )

    # Grams with several contexts: the suffix of one place of each.
    several = materialise(contexts.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k", (F.col("m") > group).alias("large")))
    probe = F.struct("k", F.col("at.p").alias("p"), "n", "large")
    probes = contexts.join(several, "k").groupBy(F.col("at.key").alias("_key"), F.col("at.doc_id").alias("_id")).agg(F.collect_list(probe).alias("probes"))
    # Alike at every size: the probes grow with the corpus, so they are never sent to all tasks.
    placed = texts.join(probes.hint("merge"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    # Of rows that repeat a whole row of the table one is enough.
    placed = placed.groupBy("_key", "_id").agg(F.first("key").alias("key"), F.first("text").alias("text"), F.first("probes").alias("probes")).select("key", "text", "probes")
    probed = materialise(bound_batches(placed).mapInArrow(_probe, _PROBED))

    suffixes = probed.where("kind = 0").drop("kind").repartitionByRange("k").sortWithinPartitions("k", "right")
    sorted_ = materialise(suffixes.mapInArrow(_extend, "key long, s int, e int"))
    # Of a gram with more contexts all windows through the anchors are counted.
    hashed = probed.where("kind = 1").select(F.col("k").alias("h"), "key", F.col("p").alias("s"), "n")
    again = materialise(hashed.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    counted = hashed.where("n = 1").join(again, "h", "left_semi").select("key", "s", (F.col("s") + MIN_WORDS).alias("e"))
    partly = sorted_.unionByName(counted)

    spans = full.unionByName(partly).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("all"))
    # Overlapping and adjoining spans become one: a span opens where it begins after all before it.
    empty = F.expr("cast(array() AS array<struct<s:int,e:int>>)")
    merged = F.aggregate(
        "all",
        F.struct(empty.alias("out"), F.lit(-1).alias("s"), F.lit(-1).alias("e")),
        lambda a, x: F.when(a["e"] < 0, F.struct(a["out"].alias("out"), x["s"].alias("s"), x["e"].alias("e")))
        .when(x["s"] <= a["e"], F.struct(a["out"].alias("out"), a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e")))
        .otherwise(F.struct(F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))).alias("out"), x["s"].alias("s"), x["e"].alias("e"))),
        lambda a: F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))),
    )
    spans = spans.select("key", F.explode(merged).alias("x")).select("key", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    narrow = found.select("doc_id", "key", "n_words")
    partial = narrow.join(spans, "key").select("doc_id", "start", "end", "n_words")
    whole_texts = narrow.join(copied, "key", "left_semi").select("doc_id", F.lit(0).alias("start"), F.col("n_words").alias("end"), "n_words")
    return partial.unionByName(whole_texts)
