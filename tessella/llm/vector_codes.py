"""Product codes of vectors: integer k-means in four parts, with segment-mean lower bounds.

Each component x becomes floor(1024 x). A vector is cut into ``PARTS`` equal
parts; each part position has a codebook of ``ENTRIES`` entries that starts as
the parts of the least vec_ids and is refined in ``ROUNDS`` rounds. A part is
assigned to its nearest entry: for blocks of a part, the squared distance is at
least length * (difference of means)^2 + (difference of residual norms)^2. One
block of a whole part filters all entries, halves, quarters and so on filter what
is left, and the survivors get exact integer distances. The bounds allow for
rounding, so no nearest entry is lost; ties go to the lower index.

Scale. Tasks return sums and counts by part and entry, which are added up before
and after one shuffle; the driver gets the codebooks alone (PARTS * ENTRIES
entries, whatever the number of vectors). Label sums are aggregated before they
are shuffled and joined back. The integer vectors are written once and read by
every round.

Edge cases. Rows whose vector is null or empty, or holds null or non-finite
components, are dropped. The length of the vector of the least vec_id counts;
vectors of another length are dropped, and a length that four doesn't divide is
filled up with zeros. Components beyond 2^26 as integers are held there, so that
squared sums fit a long. Rows without vec_id come last in the order; repeated
vec_ids are ordered by their vectors, and each row is coded. Fewer rows than
ENTRIES make a smaller codebook. Labels are summed by equality, nulls together.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, materialise, release

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Largest integer component.
MOST = 1 << 26
#: Parts that are compared at once: their bounds fit a processor's cache.
STEP = 512


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v, the integer components; rows without a whole finite vector are dropped."""
    x = F.col("embedding")
    whole = (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * SCALE))).cast("int")
    return vectors.where(x.isNotNull() & whole).select("vec_id", "label", F.transform(x, held).alias("v"))


class Blocks:
    """Vectors in equal blocks, from coarse to fine: of each level the scaled means and the residual norms of the blocks.

    The bound of a pair is the squared distance of these rows, as length * (difference
    of means)^2 is the squared difference of means that are scaled by the root of the length.
    """

    def __init__(self, x: np.ndarray):
        self.levels = []
        width = x.shape[1]
        for n in LEVELS:
            if width % n == 0 and (n == 1 or width // n > 1):
                b = x.reshape(len(x), n, width // n).astype(np.float64)
                mean = b.mean(axis=2)
                rest = np.sqrt(((b - mean[:, :, None]) ** 2).sum(axis=2))
                self.levels.append(np.hstack([mean * np.sqrt(width // n), rest]))
        self.square = (self.levels[0] ** 2).sum(axis=1)


def _bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of all pairs at one level, as one matrix product."""
    one = np.ones((len(a), 1))
    return np.hstack([-2 * a, one, (a * a).sum(axis=1)[:, None]]) @ np.hstack([b, (b * b).sum(axis=1)[:, None], np.ones((len(b), 1))]).T


#: Blocks of a part at each level.
LEVELS = (1, 2, 4, 8, 16)
#: While more than this share of the pairs is left, a level bounds all pairs at once, which is cheaper than one by one.
DENSE = 1 / 16


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry and the exact squared distance; ties to the lower index."""
    codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    entries = Blocks(book)
    for at in range(0, len(x), STEP):
        codes[at : at + STEP], errors[at : at + STEP], _ = _nearest(x[at : at + STEP], book, entries)
    return codes, errors


def _exact(x: np.ndarray, book: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = x[i] - book[j]
    return np.einsum("ij,ij->i", d, d)


def _nearest(x: np.ndarray, book: np.ndarray, entries: Blocks) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest`` of one step, and how many exact distances it took."""
    own = Blocks(x)
    rows = np.arange(len(x))
    # Rounding of the bounds is far below a billionth of what they are made of.
    slack = 1e-9 * (own.square + float(entries.square.max())) + 1e-6
    most = np.full(len(x), np.iinfo(np.int64).max)
    mask, i, j, taken = None, None, None, 0
    for a, b in zip(own.levels, entries.levels):
        if i is None:
            low = _bounds(a, b)
            if mask is not None:
                low[~mask] = np.inf
            # The exact distance to the entry of the least bound is one that the nearest doesn't exceed.
            most = np.minimum(most, _exact(x, book, rows, low.argmin(axis=1)))
            taken += len(x)
            mask = low <= (most + slack)[:, None]
            if mask.mean() <= DENSE:
                i, j = np.nonzero(mask)
        else:
            near = ((a[i] - b[j]) ** 2).sum(axis=1) <= (most + slack)[i]
            i, j = i[near], j[near]
    if i is None:
        i, j = np.nonzero(mask)
    d = _exact(x, book, i, j)
    # Rows are in order of (row, entry): the first least distance of a row has the lowest index.
    first = np.searchsorted(i, rows)
    best = np.minimum.reduceat(d, first)
    hit = np.flatnonzero(d == best[i])
    code = np.zeros(len(x), np.int64)
    code[i[hit][::-1]] = j[hit][::-1]
    return code, best, taken + len(i)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    return np.pad(values, ((0, 0), (0, width * PARTS - values.shape[1])))


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Count and sums of each entry's parts in this task: at most a row for each part and entry."""
    width = books[0].shape[1]
    sums = [np.zeros((len(b), width), np.int64) for b in books]
    counts = [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("v"), width)
        for p, book in enumerate(books):
            own = x[:, p * width : (p + 1) * width]
            code, _ = nearest(own, book)
            order = np.argsort(code, kind="stable")
            found, first, n = np.unique(code[order], return_index=True, return_counts=True)
            sums[p][found] += np.add.reduceat(own[order], first)
            counts[p][found] += n
    at = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
    lists = pa.array([sums[p][e].tolist() for p, e in at], pa.list_(pa.int64()))
    columns = [pa.array([int(p) for p, _ in at], pa.int32()), pa.array([int(e) for _, e in at], pa.int32()), pa.array([int(counts[p][e]) for p, e in at], pa.int64()), lists]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "s"])


def first_entries(kept: DataFrame) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the ENTRIES least vec_ids, at most ENTRIES rows."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    if not rows:
        return []
    length = len(rows[0].v)
    width = -(-length // PARTS)
    x = np.array([r.v for r in rows if len(r.v) == length], np.int64)
    x = np.pad(x, ((0, 0), (0, width * PARTS - length)))
    return [x[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]


def refined(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, then entries to floor(sum / count); unused entries stay."""
    width = books[0].shape[1]
    parts = kept.mapInArrow(lambda it: _sums(it, books), "part int, entry int, n long, s array<long>")
    added = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    out = [b.copy() for b in books]
    for r in added.collect():  # PARTS * ENTRIES rows at most
        out[r.part][r.entry] = [s // r.n for s in r.s]
    return out


def _code(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    width = books[0].shape[1]
    for batch in batches:
        codes, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            x = _matrix(batch.column("v"), width)
            for p, book in enumerate(books):
                code, d = nearest(x[:, p * width : (p + 1) * width], book)
                codes[:, p] = code
                error += d
        names = pa.array([c.tobytes().hex() for c in codes], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), names, pa.array(error)], names=["vec_id", "label", "code", "error"])


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, written, and the final codebooks."""
    kept = integers(vectors)
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    books = first_entries(kept)
    if not books:
        return vectors.sparkSession.createDataFrame([], schema), []
    length = len(kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").first().v)
    kept = bound_batches(materialise(kept.where(F.size("v") == length)))
    for _ in range(rounds):
        books = refined(kept, books)
    out = materialise(kept.mapInArrow(lambda it, b=books: _code(it, b), schema))
    release(kept)
    return out, books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    coded, books = compress(vectors, rounds)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )
