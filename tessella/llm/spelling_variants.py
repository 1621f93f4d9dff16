"""Words that differ by one code point, by rolling-hash deletions.

Words are counted over all texts. Two words differ by a replaced code point if
and only if what is left without the code point at some one position is equal, and by an
inserted one if one of them, without a code point, is the other. The hash of a
word without position i comes from the polynomial hashes of its prefix and its
suffix, so the keys of all words of a batch and all positions are a few NumPy operations on
integers. Keys are dealt by their upper bits and sorted; words that share a key
then meet as strings, which are compared, so that a collision links nothing.

Scale. A word sends one short row of integers for each position and no string;
only words that share a key are joined to their strings. Words with one key
differ by one code point of the alphabet at one place, so a key has at most a few hundred words, and each
returns one row with a count and its best neighbour, never pairs. In a run of
equal code points only the first deletion is a key of insertion, so each pair
meets once. Occurrences are counted within a task before they are shuffled.

Edge cases. A null or empty text has no words. A text of any length is read
whole; a word of any length takes part. Repeated rows count as often as they stand. A null doc_id is
written as nothing before the colon. Neighbours of the same count: the smallest
in code-point order. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, drop_kept, materialise, release
from .wordhash import mix

MIN_LENGTH = 7
MIN_COUNT = 2
#: One run in so many, by its hash, loses a code point.
TYPO_RATE = 31
#: A form has at least so many times the occurrences of its variant.
RATIO = 10

#: A-Z are lower-cased before; the letters from U+00C0 to U+00FF are two bytes in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def read_words(text: str, doc_id: object, least: int = MIN_LENGTH) -> Counter:
    """UTF-8 of the words of a text, with their occurrences."""
    out: Counter = Counter()
    start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode().lower())).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run, start)
        if h % TYPO_RATE == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        if len(run) - run.count(b"\xc3") >= least:
            out[run] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            if text.is_valid:
                held.update(read_words(text.as_py(), doc_id))
            if len(held) > HELD_WORDS:
                yield flush()
    yield flush()


def count_words(documents: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """word and n, for words of at least ``least`` occurrences."""
    found = bound_batches(documents.select("doc_id", "text")).mapInArrow(_count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, key, role) of each word: role 0 a replacement, 1 the longer word of an insertion, 2 the shorter.

    With sums p of c[i] B^i, the word without position i hashes to
    p[i] + (p[end] - p[i + 1]) / B, relative to B^start.
    """
    text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    n = len(text)
    row = np.repeat(np.arange(len(words)), length)
    at = np.arange(n) - start[row]
    letter = mix(text.astype(np.uint64) + _U(1))
    steps = np.full(int(length.max(initial=0)) + 1, _BASE)
    steps[0] = 1
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(letter * np.multiply.accumulate(steps)[at], out=p[1:])
    first, last = p[start], p[start + length]
    prefix, suffix = p[:-1] - first[row], last[row] - p[1:]
    rest = mix(prefix + suffix * _INVERSE + (length[row] - 1).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    whole = mix(last - first + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    replaced = mix(rest + (at.astype(np.uint64) + _U(1)) * _U(0x94D049BB133111EB))
    again = np.zeros(n, bool)
    again[1:] = (text[1:] == text[:-1]) & (row[1:] == row[:-1])
    once = ~again
    rows = np.concatenate([row, row[once], np.arange(len(words))])
    places = np.concatenate([at, at[once], np.full(len(words), -1)])
    keys = np.concatenate([replaced, mix(rest[once] ^ _U(1)), mix(whole ^ _U(1))])
    roles = np.concatenate([np.zeros(n, np.int8), np.full(int(once.sum()), 1, np.int8), np.full(len(words), 2, np.int8)])
    return rows, places, keys.view(np.int64), roles


#: Letters of words whose keys are made at once.
STEP = 200_000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = np.asarray(batch.column("wid")), batch.column("word").to_pylist()
        begin = 0
        while begin < len(words):
            end, letters = begin, 0
            while end < len(words) and (end == begin or letters + len(words[end]) <= STEP):
                letters += len(words[end])
                end += 1
            row, place, key, role = deletion_keys(words[begin:end])
            for a in range(0, len(row), STEP):  # a word may be very long
                part = slice(a, a + STEP)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part]), pa.array(ids[begin:end][row[part]]), pa.array(place[part].astype(np.int32)), pa.array(role[part])], names=["key", "wid", "place", "role"]
                )
            begin = end


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another row has too; the batches are sorted by key."""
    held: pa.RecordBatch | None = None  # the last row so far, and whether it has gone out
    gone = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None and key[0] == held.column("key")[0].as_py():
            if not gone:
                yield held
            keep[0] = True
        held, gone = batch.slice(len(key) - 1, 1), bool(keep[-1])
        yield batch.take(pa.array(np.flatnonzero(keep)))


def _without(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def meet(rows: list[tuple]) -> list[tuple]:
    """rows: (wid, place, role, word, n) of one key. (wid, near words, n and word of the best) of those that have one."""
    out = []
    alike: dict[tuple, list[tuple]] = {}
    for r in rows:
        # Replacements meet at one place, insertions by what is left; other strings have met by a collision.
        alike.setdefault((r[1] if r[2] == 0 else -1, r[2] == 0, _without(r[3], r[1])), []).append(r)
    for (_, replaced, _), members in alike.items():
        if len(members) < 2:
            continue
        if replaced:
            ranked = sorted(members, key=lambda r: (-r[4], r[3]))
            for r in ranked:
                best = ranked[1] if r is ranked[0] else ranked[0]
                out.append((r[0], len(ranked) - 1, best[4], best[3]))
        else:
            short = [r for r in members if r[2] == 2]  # a word is in the table once
            long_ = [r for r in members if r[2] == 1]
            if short and long_:
                best = min(long_, key=lambda r: (-r[4], r[3]))
                out.append((short[0][0], len(long_), best[4], best[3]))
                out += [(r[0], 1, short[0][4], short[0][3]) for r in long_]
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    held: list[tuple] = []
    last = None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [(), (), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=["wid", "near", "best_n", "best"])

    for batch in batches:
        for key, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "wid", "place", "role", "word", "n")]):
            if key != last:
                out += meet(held)
                held, last = [], key
            held.append(tuple(row))
        yield flush()
    out += meet(held)
    yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """wid, n_near, and n and word of the near word of most occurrences; ``words``: a written table of wid, word and n."""
    n_parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    radix = lambda c: F.shiftrightunsigned(F.col(c), 33).cast("int") % n_parts  # noqa: E731  upper bits
    keys = bound_batches(words.select("wid", "word")).mapInArrow(_keys, "key long, wid long, place int, role tinyint")
    shared = materialise(keys.repartitionById(n_parts, radix("key")).sortWithinPartitions("key").mapInArrow(_shared, "key long, wid long, place int, role tinyint"))
    strings = shared.join(words, "wid").select("key", "wid", "place", "role", "word", "n")
    met = strings.repartitionById(n_parts, radix("key")).sortWithinPartitions("key").mapInArrow(_meet, "wid long, near long, best_n long, best string")
    found = met.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b"))
    return found.select("wid", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each row of (word, form). Occurrences grow by RATIO with each step, so paths are short; each round halves them."""
    table = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialise(table.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(table)
        table = new
        if new.where("moved").isEmpty():
            return new.select("word", "root")


def group_variants(documents: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least MIN_COUNT occurrences."""
    words = materialise(count_words(documents).withColumn("wid", F.monotonically_increasing_id()))
    near = near_words(words)
    found = materialise(words.join(near, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best_n", "best"))
    release(words)
    formed = F.col("best_n") >= ratio * F.col("n")
    table = found.select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    ends = roots(table.where("form IS NOT NULL").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
