"""Many terms in many texts: an Aho-Corasick automaton that reads each text once.

The terms of a counted, bounded set are built into one automaton, which is sent to
the executors once; larger sets are taken in blocks. What a text costs depends on
its length and on the terms that it holds, not on the number of terms asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms, and letters of terms, of one automaton; more are taken in blocks. An automaton takes some forty bytes a letter.
BLOCK_TERMS, BLOCK_LETTERS = 200_000, 2_000_000
#: Cells of the table of scores that a task holds at once.
CELLS = 2_000_000


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Terms by their place in the list."""
    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, (i, len(t)))
    if terms:
        out.make_automaton()
    return out


def occurrences(found: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """Of each term in the text its occurrences from the left that don't overlap."""
    counts: dict[int, int] = {}
    ends: dict[int, int] = {}
    if len(found):
        for end, (i, n) in found.iter(text):
            if end - n >= ends.get(i, -1):
                counts[i] = counts.get(i, 0) + 1
                ends[i] = end
    return counts


def blocks_of(terms: DataFrame, limit: int, letters: int) -> list[DataFrame]:
    """Distinct non-empty terms (term), in as many parts by hash as keep each within both limits."""
    distinct = terms.where(F.length("term") > 0).select("term").distinct()
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    parts = max(-(-n // limit), -(-size // letters))
    if parts <= 1:
        return [distinct] if n else []
    block = F.pmod(F.xxhash64("term"), F.lit(2 * parts))  # parts by hash vary in size
    return [distinct.where(block == i) for i in range(2 * parts)]


def find_terms(texts: DataFrame, terms: DataFrame, ident: str, c: str = "text", limit: int = BLOCK_TERMS, letters: int = BLOCK_LETTERS) -> DataFrame:
    """(ident, term, n): how often each text holds each term, without overlaps; nothing where it doesn't.

    Texts and terms are compared as they are. A null text holds nothing. Rows of one
    ident are not added up. Terms are a bounded set: blocks of it are collected, and each block
    reads the texts once.
    """
    spark = texts.sparkSession
    schema = T.StructType([texts.schema[ident], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in blocks_of(terms, limit, letters):
        names = [r.term for r in block.collect()]
        out = out.unionByName(texts.select(ident, c).mapInArrow(_finder(spark, names, ident, c), schema))
    return out


def _finder(spark, names: list[str], ident: str, c: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    sent = spark.sparkContext.broadcast(names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        found = automaton(names)
        for batch in batches:
            rows, which, n = [], [], []
            for i, t in enumerate(batch.column(c)):
                for k, count in occurrences(found, t.as_py() or "").items():
                    rows.append(i)
                    which.append(names[k])
                    n.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(ident).take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(n, pa.int64())], names=[ident, "term", "n"])

    return find


class Questions:
    """Questions as postings: of each term the questions that hold it."""

    def __init__(self, terms: list[list[str]]):
        self.terms = sorted({t for q in terms for t in q if t})
        place = {t: i for i, t in enumerate(self.terms)}
        held: list[list[int]] = [[] for _ in self.terms]
        for q, own in enumerate(terms):
            for t in own:
                if t:
                    held[place[t]].append(q)
        self.postings = [np.array(h, np.int64) for h in held]
        self.sizes = np.array([max(1, len(q)) for q in terms], np.float64)

    def scores(self, counts: dict[int, int]) -> np.ndarray:
        """F8 of a text for every question: min(3, 1 + ln(1 + n)) over the terms found, and three times their share."""
        if not counts:
            return np.zeros(len(self.sizes))
        own = [self.postings[t] for t in counts]
        at = np.concatenate(own)
        part = np.repeat([min(3.0, 1 + math.log1p(n)) for n in counts.values()], [len(p) for p in own])
        n = len(self.sizes)
        return np.bincount(at, part, n) + 3.0 * np.bincount(at, minlength=n) / self.sizes


def score_questions(texts: DataFrame, questions: DataFrame, ident: str, c: str = "text", k: int | None = None, query_id: str = "qid", limit: int = 20_000) -> DataFrame:
    """(query_id, ident, score): F8 of lower-cased texts for questions of (query_id, terms), where it is above zero.

    With ``k`` a task passes on what can be among a question's k best of the texts of one
    batch, ties by a score of nine digits included; the ranking itself is the
    caller's. Questions are a counted set that is sent to all tasks, in blocks of
    about ``limit``, each of which reads the texts once. A null text or a
    question without terms scores nothing.
    """
    spark = texts.sparkSession
    schema = T.StructType([questions.schema[query_id], texts.schema[ident], T.StructField("score", T.DoubleType())])
    n = -(-questions.count() // limit)
    block = F.pmod(F.xxhash64(query_id), F.lit(2 * n))
    out = None
    for part in [questions] if n <= 1 else [questions.where(block == i) for i in range(2 * n)]:
        asked = part.select(query_id, "terms").collect()
        found = texts.select(ident, c).mapInArrow(_scorer(spark, [r[0] for r in asked], [r[1] or [] for r in asked], schema, ident, c, k), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _scorer(spark, ids: list, terms: list[list[str]], schema: T.StructType, ident: str, c: str, k: int | None):
    sent = spark.sparkContext.broadcast((ids, terms))
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}.get(schema[0].dataType.simpleString())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms = sent.value
        asked = Questions(terms)
        found = automaton(asked.terms)
        names = pa.array(ids, kind)
        step = max(1, CELLS // max(1, len(ids)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                table = np.stack([asked.scores(occurrences(found, t.as_py() or "")) for t in batch.column(c)]) if len(ids) else np.zeros((batch.num_rows, 0))
                keep = table > 0
                if k is not None and len(table) > k:
                    near = np.round(table, 9)
                    keep &= near >= np.partition(near, -k, axis=0)[-k] - 1e-9
                row, q = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(ident).take(pa.array(row)), pa.array(table[row, q])], names=schema.names)

    return score
