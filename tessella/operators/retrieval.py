"""Retrieval: exact vector top-k, lexical top-k, structured facts, sources of a chunk.

Queries are a stated, bounded set that every task sees; the corpus is scanned
once and not shuffled. Ranks are limited inside each task before the exchange
(the optimiser's window group limit), so a task passes on k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.constants import MIN_SCORE
from ..functions.text import preview, search_terms, text
from . import nearest, patterns

#: Query rows that are sent to every task at once; larger sets are taken in blocks of about as many.
BROADCAST_QUERIES = 20_000


def in_blocks(queries: DataFrame, query_id: str, answer: Callable[[DataFrame], DataFrame], limit: int = BROADCAST_QUERIES) -> DataFrame:
    """``answer`` of a counted query set that is sent to all tasks, block by block if there are more than ``limit``."""
    n = -(-queries.count() // limit)
    if n <= 1:
        return answer(F.broadcast(queries))
    # Blocks by hash vary in size; twice as many stay below the limit.
    block = F.pmod(F.xxhash64(query_id), F.lit(2 * n))
    return reduce(DataFrame.unionByName, [answer(F.broadcast(queries.where(block == i))) for i in range(2 * n)])


def vector_topk(
    chunks: DataFrame, queries: DataFrame, k: int = 8, min_score: float = MIN_SCORE, vector: str = "embedding", query_id: str = "qid", ident: str = "vec_id"
) -> DataFrame:
    """J1, P2, P5, O1, F10. The k nearest chunks of each query by exact L2 distance; score 1 / (1 + d), rank from 1.

    Rows with a negative score_hint carry no vector and are left out, as are vectors that
    are null or of another length than the query's. Ties go by id,
    which must be unique. A task compares its vectors with all queries of a block by
    matrix products and passes on what can be among the k nearest, with exact distances.
    Only ids and distances are ranked; the rest of the winners' rows is joined to them afterwards.
    """
    if "score_hint" in chunks.columns:
        chunks = chunks.where("score_hint >= 0")
    narrow, rest = chunks.select(ident, vector), [c for c in chunks.columns if c not in (ident, vector)]
    w = Window.partitionBy(query_id).orderBy("distance", ident)

    def answer(q: DataFrame) -> DataFrame:
        ranked = nearest.near_pairs(narrow, q, k, ident, vector, query_id).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ranked = ranked.withColumn("score", scoring.similarity(F.col("distance"))).where(F.col("score") >= min_score)
        return _with_rows(chunks, ranked, rest, ident)

    return in_blocks(queries.select(F.col(query_id), F.col(vector).alias("_q")).where("_q IS NOT NULL"), query_id, answer)


def _with_rows(chunks: DataFrame, ranked: DataFrame, columns: list[str], ident: str) -> DataFrame:
    """The other columns of the chunks that won: k rows for each of a bounded number of queries, so they can be sent to all tasks."""
    return chunks.select(ident, *columns).join(F.broadcast(ranked), ident) if columns else ranked


def source_order(ranked: DataFrame, *keys: str) -> DataFrame:
    """O2. Results by source, not by score."""
    return ranked.orderBy(*keys)


def lexical_topk(chunks: DataFrame, question: str, k: int = 8, min_score: float = MIN_SCORE, order: tuple[str, ...] = ("source_path", "chunk_index"), c: str = "text") -> DataFrame:
    """J2, O3, O4. The first max(40 k, 200) chunks in source order, scored by the question's terms; the best k."""
    head = chunks.orderBy(*order).limit(max(40 * k, 200))
    terms = search_terms(F.lit(question))
    scored = head.withColumn("score", scoring.lexical_score(terms, c)).where(F.col("score") >= min_score)
    return scored.withColumns({"retrieval_mode": F.lit("lexical_fallback"), "text_preview": preview(c, 360)}).orderBy(F.desc("score"), *order).limit(k)


def lexical_scores(chunks: DataFrame, questions: DataFrame, ident: str, c: str = "text", query_id: str = "qid", question: str = "question", k: int | None = None) -> DataFrame:
    """F8, J2 for a set of questions against all chunks: (query_id, ident, score) of the pairs that score above zero.

    The terms of all questions are one automaton, and each text is lower-cased and
    read once. ``k``: only what can be among the k best of a question.
    """
    asked = questions.select(query_id, search_terms(question).alias("terms"))
    return patterns.score_questions(chunks.select(ident, F.lower(text(c)).alias(c)), asked, ident, c, k, query_id, BROADCAST_QUERIES)


def top_lexical(chunks: DataFrame, questions: DataFrame, k: int, ident: str, c: str = "text", query_id: str = "qid", **options) -> DataFrame:
    """The best k chunks of each question over the whole corpus; ties by id, which must be unique. Texts aren't ranked with them."""
    scored = lexical_scores(chunks, questions, ident, c, query_id, k=k, **options)
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), ident)
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rest = [x for x in chunks.columns if x != ident]
    n = questions.limit(BROADCAST_QUERIES + 1).count()
    return chunks.join(F.broadcast(ranked) if n <= BROADCAST_QUERIES else ranked, ident).select(ident, *rest, *[x for x in ranked.columns if x != ident])


def structured_facts(facts: DataFrame, namespace: str, key: str, source: str = "", limit: int = 30) -> DataFrame:
    """P3, O5. Facts of a key, by year and entity; ``source`` is a LIKE pattern inside the path, as in SQL."""
    out = facts.where((F.col("namespace") == namespace) & (F.col("key") == key))
    if source:
        out = out.where(F.col("source_path").like(f"%{source}%"))
    return out.orderBy("year", "entity", "id").limit(limit)


def source_chunks(chunks: DataFrame, namespace: str, url: str = "", path: str = "", limit: int = 50) -> DataFrame:
    """P4, O6. Chunks of one source in order; without url and path there are none."""
    out = chunks.where(F.col("namespace") == namespace)
    if not (url or path):
        return out.limit(0)
    if url:
        out = out.where(F.col("source_url") == url)
    if path:
        out = out.where(F.col("source_path") == path)
    return out.orderBy("chunk_index", "id").limit(limit)


def preview_chunks(chunks: DataFrame, namespace: str, source_type: str = "", limit: int = 20) -> DataFrame:
    """P1, O7, P6."""
    out = chunks.where(F.col("namespace") == namespace)
    if source_type:
        out = out.where(F.col("source_type") == source_type)
    return out.orderBy("source_type", "source_path", "page", "id").limit(limit).withColumn("text_preview", preview("text", 260)).drop("text")


def merge_namespaces(parts: list[DataFrame], score: str = "score", ident: str = "id") -> DataFrame:
    """D1, O8. Results of namespaces in the order given, by score; equal scores keep that order."""
    out = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_ns", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.orderBy(F.desc(score), "_ns", ident).drop("_ns")


def prefer(df: DataFrame, flag: Column, *partition: str) -> DataFrame:
    """P19, J10. Rows with the flag, or all rows of the group if none has it.

    The groups that have it are aggregated apart, a row each, so that a hot group needn't meet in one task.
    """
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    having = flagged.where("_flag").select(*[F.col(p).alias(f"_{i}") for i, p in enumerate(partition)]).distinct().withColumn("_any", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{i}")) for i, p in enumerate(partition)])
    return flagged.join(having, same, "left").where("_flag OR _any IS NULL").select(*df.columns)


def expand_source(chunks: DataFrame, primary: DataFrame, limit: int = 50) -> DataFrame:
    """J6. All chunks of each query's primary source: (qid, namespace, source_url, source_path) joined on the stored columns that are set.

    A source's first ``limit`` are the same for all who ask for it, so they are ranked once a source, by
    places and ids alone, and then meet the queries. Texts are joined to what is left. Ids must be unique.
    """
    p = primary.select("qid", F.col("namespace").alias("_n"), text("source_url").alias("_u"), text("source_path").alias("_p"))
    # By what is set, so that each part joins on equalities alone.
    parts = [("_u <> '' AND _p <> ''", {"_u": "source_url", "_p": "source_path"}), ("_u <> '' AND _p = ''", {"_u": "source_url"}), ("_u = '' AND _p <> ''", {"_p": "source_path"})]

    def firsts(block: DataFrame) -> DataFrame:
        out = []
        for which, on in parts:
            keys = {"_n": "namespace", **on}
            asked = block.where(which)
            w = Window.partitionBy(*keys).orderBy("chunk_index", "id")
            places = chunks.select(*[F.col(c).alias(k) for k, c in keys.items()], "chunk_index", "id").join(F.broadcast(asked.select(*keys).distinct()), list(keys), "left_semi")
            first = places.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r", "chunk_index")
            out.append(first.join(F.broadcast(asked), list(keys)).select("qid", "id"))
        # At most ``limit`` ids a query of the block, so no text is shuffled.
        return chunks.join(F.broadcast(reduce(DataFrame.unionByName, out)), "id").select(*chunks.columns, "qid")

    return in_blocks(p, "qid", firsts)
