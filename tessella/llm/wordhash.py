"""Vectorised word hashing over Arrow string buffers.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All words of a
chunk of texts are found and hashed at once with prefix sums over the UTF-8
buffer, so the cost is a few nanoseconds a byte and no Python object is made
per word. The hash of a word depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in chunks of about this many bytes, to bound the memory of a task.
CHUNK_BYTES = 2_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        m = max(n, CHUNK_BYTES + 1)
        steps = np.full(m, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words:
    """Words of several texts: hash, byte range and the text each belongs to."""

    __slots__ = ("bounds", "end", "hash", "start")

    def __init__(self, hash_: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray):
        self.hash, self.start, self.end, self.bounds = hash_, start, end, bounds

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position on, and whether all k are in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out = out * _U(0xD6E8FEB86659FD93) + self.hash[j : n - k + 1 + j]
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return mix(out), owner[: n - k + 1] == owner[k - 1 :]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """``data``: UTF-8 bytes of all texts; ``offsets``: where each begins, and the end."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64))
    solid = ~_IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    begins[edge] = solid[edge]
    ends = np.zeros(n + 1, bool)
    ends[1:] = solid
    ends[1:-1] &= ~solid[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power("up", n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power("down", n)[start])
    return Words(hashes, start, end, np.searchsorted(start, offsets).astype(np.int64))


def text_chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words_of_texts(texts: list[str | None]) -> Words:
    """The words of a small list of texts, for tests and small tables."""
    if not texts:
        return words_of(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    ((_, _, data, offsets),) = text_chunks(pa.array(texts, pa.string()), limit=1 << 62)
    return words_of(data, offsets)


def minimisers(grams: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the leftmost least gram of some run of ``window`` valid grams.

    Any ``window`` adjacent grams of one text hold a selected position, and the
    choice depends on the grams alone, so equal passages select equal positions.
    A text of fewer grams than ``window`` selects its least one.
    """
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    out = []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], valid, [False]]).astype(np.int8)))
    key = np.where(valid, grams, np.iinfo(np.uint64).max)
    # In a window that crosses texts the invalid grams between them are larger
    # than any other; such windows are dropped, short texts are done one by one.
    if len(key) >= window:
        best = np.lib.stride_tricks.sliding_window_view(key, window).argmin(axis=1) + np.arange(len(key) - window + 1)
        whole = np.concatenate([[0], np.cumsum(valid)])
        whole = whole[window:] - whole[:-window] == window
        out.append(best[whole])
    for a, b in edges.reshape(-1, 2):
        if b - a < window:
            out.append(np.array([a + int(key[a:b].argmin())]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
