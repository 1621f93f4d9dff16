"""Benchmark decontamination by spaced seeds.

Fixed masks select six of eleven adjacent words and ignore the others. Every
position of every benchmark item and of every training text is hashed by every
mask; texts and items meet by a join on equal hashes. A hit fixes an alignment of
text and item, and the words around it are compared one by one: an overlap holds
if some ``SPAN`` aligned words (all of a shorter item) agree in at least
``AGREEMENT`` of their places. The masks are chosen so that any 16 aligned words
with up to three substitutions hold an intact seed of some mask, and shorter items
have masks by their length that leave a seed whatever substitutions are allowed,
down to items of one word, so that no such overlap is missed. As the seed lies
inside the overlap, five words before it and fifteen after it decide.

Words are compared without case and punctuation, so that a passage in capitals or
with other marks is found; a word of punctuation alone is passed over. Reported
positions count the words of the text as it stands.

Nothing of the benchmark is collected. Its seeds are a written table. A bit filter
of at most ``2 ** MAX_FILTER_BITS`` bits, whatever the benchmark's size, tells the
scan of the texts which hashes can be seeds; only those leave the scan, with the
words around them, and are joined to the table. Nearly all texts are thus read
once and never shuffled. A benchmark too large for the filter makes it less
selective and the join larger, never the result smaller. Of hits that are equal
in hash and in all words around them a text keeps the first and an item one, so
that a text of one repeated word costs no more than others.

Edge cases: a null or empty text or item has no word and no overlap, nor has any
text with an empty benchmark; an empty table gives no rows. Very long texts are
compared whole. Repeated rows and items are reported each. Of a text's equally
good windows with an item the first counts. Item ids may be of any type, and null.
Extra columns pass through; those named as the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, drop_kept, free_names, materialise, release
from .wordhash import Words, mix, text_chunks, words_of

# The word positions that each mask compares.
MASKS = ((0, 2, 3, 7, 8, 10), (0, 1, 4, 7, 9, 10), (0, 1, 2, 8, 9, 10), (0, 1, 3, 6, 9, 10))
REACH = 11
SPAN = 16
AGREEMENT = 0.8
#: Words before a seed that an overlap around it can take in, and words from it on.
BEFORE, AFTER = SPAN - REACH, SPAN
#: Bits of the filter for each seed, and the most it may have: 32 MB.
BITS_A_SEED, MAX_FILTER_BITS = 128, 28

_U = np.uint64
#: Multipliers of the filter's three probes.
_PROBES = tuple(_U(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_RESULT = ("item_id", "start", "end", "agree")


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over all n words of a short item: two blocks each, of two blocks more than substitutions are allowed.

    So many substitutions leave two blocks untouched at least, which are a mask.
    """
    allowed = n - math.ceil(AGREEMENT * n - 1e-9)
    blocks = [tuple(int(j) for j in part) for part in np.array_split(np.arange(n), allowed + 2)]
    return [a + b for a, b in combinations(blocks, 2)]


def folded(texts: list[str | None]) -> pa.Array:
    """The texts without case, punctuation and format characters as NUL bytes."""
    low = pa.array([(t or "").casefold() for t in texts], pa.large_string())
    return pc.replace_substring_regex(low, r"[\p{P}\p{Cf}]", "\0")


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of folded texts without their NULs, and the place of each among the words of its text as it stands."""
    kept = data != 0
    w = words_of(data, offsets)
    place = np.arange(len(w.start)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
    if kept.all():
        return w, place
    before = np.concatenate([[0], np.cumsum(kept)])
    return words_of(data[kept], before[offsets]), place[before[w.end] > before[w.start]]


def seed_hashes(w: Words, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the mask's words at each position, and whether mask and text fit there."""
    n = len(w.hash) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n, salt, np.uint64)
    for j in mask:
        out = out * _U(0xD6E8FEB86659FD93) + w.hash[j : j + n]
    owner = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    return mix(out), owner[:n] == owner[mask[-1] :]


def masks_for(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(salt, mask) of all seeds; those for items of a length below SPAN have salts above 100 times that length."""
    return [*enumerate(MASKS, 1)] + [(100 * n + k, mask) for n in lengths for k, mask in enumerate(short_masks(n))]


def around(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words from BEFORE before to AFTER after each position, and which of them are in the same text."""
    text = np.searchsorted(w.bounds, at, "right") - 1
    places = at[:, None] + np.arange(-BEFORE, AFTER)
    inside = (places >= w.bounds[text][:, None]) & (places < w.bounds[text + 1][:, None])
    return np.where(inside, places, 0), inside


def first_of_equal(text: np.ndarray, h: np.ndarray, at: np.ndarray, words: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Of the hits that are equal in text, hash and the words around, the index of the first."""
    odd = np.random.default_rng(5).integers(1, 1 << 62, words.shape[1], dtype=np.uint64) * _U(2) + _U(1)
    key = mix(h + (np.where(inside, mix(words), _U(0)) * odd).sum(axis=1, dtype=np.uint64))
    order = np.lexsort((at, key, text))
    t, k = text[order], key[order]
    first = np.ones(len(order), bool)
    first[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    return order[first]


def lists_of(values: np.ndarray, inside: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list a row, null where not inside."""
    flat = pa.array(values.ravel().astype(np.int64), pa.int64(), mask=~inside.ravel()).cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a seed of an item: (item, n words, hash, words around it)."""
    drop_kept()
    for batch in batches:
        for row, stop, data, offsets in text_chunks(folded(batch.column("text").to_pylist())):
            w, _ = plain_words(data, offsets)
            length = np.diff(w.bounds)
            owner = np.repeat(np.arange(stop - row), length)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for salt, mask in masks_for(sorted({int(n) for n in length if 0 < n < SPAN})):
                h, ok = seed_hashes(w, mask, salt)
                at = np.flatnonzero(ok)
                n = length[owner[at]]
                at = at[(n == salt // 100) & (at == w.bounds[owner[at]])] if salt >= 100 else at[n >= SPAN]
                found.append((at, h[at]))
            at, h = (np.concatenate(x) for x in zip(*found))
            places, inside = around(w, at)
            words = w.hash[places] if len(w.hash) else np.zeros(places.shape, np.uint64)
            keep = first_of_equal(owner[at], h, at, words, inside)
            item = pa.array(owner[at][keep] + row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item").take(item),
                    batch.column("item_id").take(item),
                    pa.array(length[owner[at]][keep], pa.int32()),
                    pa.array(h[keep].astype(np.int64)),
                    lists_of(words[keep], inside[keep], pa.int64()),
                ],
                names=["item", "item_id", "n", "h", "item_words"],
            )


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h * p) >> _U(64 - bits) for p in _PROBES]


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """The bit filter of the seeds' hashes as 64-bit words, and the logarithm of its bits."""
    n = seeds.count()
    bits = min(MAX_FILTER_BITS, max(10, math.ceil(math.log2(max(1, n * BITS_A_SEED)))))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(probes(np.asarray(batch.column("h")).astype(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> _U(6)).astype(np.int64)), pa.array((_U(1) << (slots & _U(63))).astype(np.int64))], names=["at", "bits"])

    # At most a row for each 64 bits, so the driver's share is bounded as the filter is.
    rows = seeds.select("h").mapInArrow(set_bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[np.asarray(rows.column("at").combine_chunks())] = np.asarray(rows.column("bits").combine_chunks()).astype(np.uint64)
    return out, bits


def may_hold(filter_: np.ndarray, bits: int, h: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Positions whose hash passes all probes."""
    at = np.flatnonzero(ok)
    for p in _PROBES:
        slot = (h[at] * p) >> _U(64 - bits)
        at = at[(filter_[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) > 0]
    return at


def _hits(batches: Iterator[pa.RecordBatch], text: str, name: str, keep: list[str], filter_: np.ndarray, bits: int, masks: list[tuple[int, tuple[int, ...]]]) -> Iterator[pa.RecordBatch]:
    """The rows, each with the list of its hits: hash, position, words around it and their places in the text as it stands."""
    drop_kept()
    for batch in batches:
        for row, stop, data, offsets in text_chunks(folded(batch.column(text).to_pylist())):
            w, raw = plain_words(data, offsets)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for salt, mask in masks:
                h, ok = seed_hashes(w, mask, salt)
                at = may_hold(filter_, bits, h, ok)
                found.append((at, h[at]))
            at, h = (np.concatenate(x) for x in zip(*found))
            owner = np.searchsorted(w.bounds, at, "right") - 1
            places, inside = around(w, at)
            words = w.hash[places] if len(w.hash) else np.zeros(places.shape, np.uint64)
            first = first_of_equal(owner, h, at, words, inside)
            owner, at, h, words, places, inside = (x[first] for x in (owner, at, h, words, places, inside))
            kinds = [pa.array(h.astype(np.int64)), pa.array(at - w.bounds[owner]), lists_of(words, inside, pa.int64()), lists_of(raw[places] if len(raw) else places, inside, pa.int32())]
            hits = pa.StructArray.from_arrays(kinds, names=["h", "p", "words", "raw"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(stop - row + 1)), pa.int32()), hits)
            part = batch.slice(row, stop - row)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), lists], names=[*keep, name])


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def best_window(n: Column, words: Column, item_words: Column, position: Column, raw: Column) -> Column:
    """struct(agree, back, start, end) of the best window around a seed, null where none is wide enough or agrees enough."""
    need = F.least(n, F.lit(SPAN))

    def window(same: Column, s: Column) -> Column:
        return _let(
            F.slice(same, s + 1, need),
            lambda x: F.when(
                F.forall(x, lambda y: y.isNotNull()),
                F.struct(
                    F.size(F.filter(x, lambda y: y)).cast("long").alias("agree"),
                    (-(position + s)).alias("back"),
                    F.get(raw, s).cast("long").alias("start"),
                    (F.get(raw, s + need - 1) + 1).cast("long").alias("end"),
                ),
            ),
        )

    starts = F.when(n < SPAN, F.array(F.lit(BEFORE))).otherwise(F.sequence(F.lit(0), F.lit(BEFORE)))
    best = _let(F.zip_with(words, item_words, lambda a, b: a == b), lambda same: F.array_max(F.transform(starts, lambda s: window(same, s))))
    return _let(best, lambda b: F.when(b["agree"] >= F.ceil(AGREEMENT * need - 1e-9), b))


def _scan(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, str, str, list[DataFrame]]:
    """Rows of ``df`` with their hits (written), and every overlap by row; names of row and hits, and tables to release."""
    row, hits = free_names(df, "row", "hits")
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind = T.StructType(
        [T.StructField("item", T.LongType()), items.schema["item_id"], T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("item_words", T.ArrayType(T.LongType()))]
    )
    seeds = materialise(bound_batches(items).mapInArrow(_seeds, kind))
    bits_of, bits = seed_filter(seeds)
    lengths = sorted(r["n"] for r in seeds.where(F.col("n") < SPAN).select("n").distinct().collect())  # fewer than SPAN
    masks = masks_for(lengths)
    sent = df.sparkSession.sparkContext.broadcast(bits_of)  # at most 2 ** MAX_FILTER_BITS bits
    hit = T.StructType(
        [T.StructField("h", T.LongType()), T.StructField("p", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("raw", T.ArrayType(T.IntegerType()))]
    )
    read = df.select(*dict.fromkeys([*keep, text])).withColumn(row, F.monotonically_increasing_id())
    kept = [*keep, row]
    schema = T.StructType([*(read.schema[c] for c in kept), T.StructField(hits, T.ArrayType(hit))])
    scanned = materialise(bound_batches(read).mapInArrow(lambda it: _hits(it, text, hits, kept, sent.value, bits, masks), schema))
    # Which side is sent whole, if any, is left to the planner, which knows the sizes of both written tables.
    each = scanned.where(F.size(hits) > 0).select(F.col(row).alias("row"), F.explode(hits).alias("x")).select("row", "x.*")
    met = each.join(seeds, "h").select("row", "item", "item_id", best_window(F.col("n"), F.col("words"), F.col("item_words"), F.col("p"), F.col("raw")).alias("best"))
    overlaps = met.where(F.col("best").isNotNull()).groupBy("row", "item").agg(F.first("item_id").alias("item_id"), F.max("best").alias("best"))
    return scanned, overlaps, row, hits, [seeds]


def find_overlaps(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each text and item that overlap: the columns of ``df`` but the text, then item_id, start, end (words) and agree."""
    keep = [c for c in df.columns if c.lower() not in (text.lower(), *_RESULT)]
    scanned, overlaps, row, hits, _ = _scan(df, benchmark, keep, text, item_id, item_text)
    rows = scanned.where(F.size(hits) > 0).drop(hits)
    found = overlaps.select(F.col("row").alias(row), "item_id", "best.start", "best.end", "best.agree")
    return rows.join(found, row).drop(row)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` without any overlap with the benchmark, columns as they were.

    Texts without a hit, which are nearly all, are not shuffled.
    """
    scanned, overlaps, row, hits, spent = _scan(df, benchmark, df.columns, text, item_id, item_text)
    dirty = materialise(overlaps.select(F.col("row").alias(row)).distinct())
    release(*spent)
    passed = scanned.where(F.size(hits) == 0).select(*df.columns)
    checked = scanned.where(F.size(hits) > 0).join(dirty, row, "left_anti").select(*df.columns)
    return passed.unionByName(checked)
