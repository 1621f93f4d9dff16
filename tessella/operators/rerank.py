"""Reranking, source expansion and context assembly, for many questions at once (partitioned by qid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent, scoring
from ..functions.constants import CONTEXT_CHARS, SNIPPET_CHARS
from ..functions.text import match_text, text
from ..tables import once
from .cleaning import budget_prefix


def source_key(url: Column, path: Column, kind: Column, page: Column) -> Column:
    """F21."""
    blank = lambda c: F.nullif(text(c), F.lit(""))
    return F.coalesce(blank(url), blank(path), F.concat_ws(":", F.coalesce(blank(kind), F.lit("unknown")), F.coalesce(page, F.lit(0)).cast("string")))


def phrases_of(questions: DataFrame, question: str = "question") -> DataFrame:
    """(qid, _phrases) of questions of one row each: found once a question, not for each of its chunks."""
    return once(questions.select("qid", F.col(question).alias("_q")), _phrases=intent.query_phrases("_q")).drop("_q")


def rerank(df: DataFrame, question: str = "question", order: str = "ord", phrases: DataFrame | None = None, normal: str | None = None) -> DataFrame:
    """C2, J3, J7, A5, F22, F23, O9. Rows of (qid, question, ord, score, text, source columns) with combined and rank.

    Phrase matches raise a chunk, matches of its source raise all chunks of the
    source; a question about one article keeps the best source only. ``phrases``: those of
    ``phrases_of``, where the questions are a table of their own. ``normal``: a column of
    the normalised texts, where texts meet many questions; it is dropped.
    """
    df = once(df, _phrases=intent.query_phrases(question)) if phrases is None else df.join(phrases, "qid")
    df = once(df, _found=scoring.phrase_matches(F.col("_phrases"), "text") if normal is None else scoring.phrases_in(F.col("_phrases"), F.col(normal))).drop(*[normal] if normal else [])
    df = df.withColumns(
        {
            "phrase_score": F.aggregate("_found", F.lit(0.0), lambda a, p: a + scoring.phrase_weight(p)),
            "matches": F.size("_found"),
            "_source": source_key(F.col("source_url"), F.col("source_path"), F.col("source_type"), F.col("page")),
            "_single": intent.prefers_single_article(question),
            "_web": (text("source_type") == "web_page").cast("int"),
        }
    )
    w = Window.partitionBy("qid", "_source")
    df = df.withColumns({"_s": F.sum(F.col("score") + F.col("phrase_score")).over(w), "_m": F.sum("matches").over(w), "_w": F.max("_web").over(w)})
    all_ = Window.partitionBy("qid")
    df = df.withColumn("_anyweb", F.max("_web").over(all_)).where(~F.col("_single") | (F.col("_anyweb") == 0) | (F.col("_web") == 1))
    best = F.max_by("_source", F.struct("_m", "_w", F.round("_s", 9), (-F.col(order)).alias("o"))).over(all_)
    df = df.withColumn("_best", best).where(~F.col("_single") | (F.col("_source") == F.col("_best")))
    bonus = 0.03 * F.least(F.col("_m"), F.lit(3)) + F.when(F.col("_single") & (F.col("_web") == 1), 0.02).otherwise(0.0)
    df = df.withColumn("combined", F.col("score") + F.col("phrase_score") + bonus)
    ranked = Window.partitionBy("qid").orderBy(F.desc(F.round("combined", 9)), F.desc(F.round("phrase_score", 9)), F.desc("matches"), F.desc("score"), order)
    return df.withColumn("rank", F.row_number().over(ranked)).drop("_phrases", "_found", "_source", "_single", "_web", "_s", "_m", "_w", "_anyweb", "_best")


def trim_to_section(c: Column, phrases: Column) -> Column:
    """F24. The numbered section around the first phrase.

    The place of the phrase is taken in the normalised text and compared with
    places in the raw text, as the results to match do.
    """
    norm = match_text(c)
    anchor = F.array_min(F.filter(F.transform(phrases, lambda p: F.when(p != "", F.instr(norm, p) - 1)), lambda x: x >= 0))
    heads = F.split(c, r"(?<!\d)(?=\d+\.)")
    starts = F.transform(heads, lambda h, i: F.aggregate(F.slice(heads, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)))
    marks = F.filter(starts, lambda s: F.substring(c, s + 1, F.lit(12)).rlike(r"^\d+\."))
    first = F.coalesce(F.array_max(F.filter(marks, lambda s: s <= anchor)), F.lit(0))
    end = F.coalesce(F.array_min(F.filter(marks, lambda s: s > anchor)), F.length(c))
    cut = F.trim(F.substring(c, first + 1, end - first))
    return F.when(anchor.isNull() | (cut == ""), c).otherwise(cut)


def best_of(df: DataFrame, score: Column, partition: str, order: str, n: int = 2) -> DataFrame:
    """A25. The first n rows that have the group's greatest score."""
    df = df.withColumn("_s", score)
    w = Window.partitionBy(partition)
    df = df.withColumn("_t", F.max("_s").over(w)).where("_s = _t")
    return df.withColumn("_r", F.row_number().over(w.orderBy(order))).where(F.col("_r") <= n).drop("_s", "_t", "_r")


def context_block() -> Column:
    """F43. One chunk of a prompt's context."""
    named = lambda c: F.nullif(text(c), F.lit(""))
    src = F.coalesce(named("source_url"), named("source_path"), named("source_type"), F.lit("unknown"))
    paged = F.when(F.coalesce(F.col("page"), F.lit(0)) > 0, F.concat(src, F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise(src)
    return F.concat(F.lit("SOURCE: ["), text("namespace"), F.lit("] "), paged, F.lit("\nTEXT:\n"), text("text"))


def assemble_context(df: DataFrame, order: str = "rank", limit: int = CONTEXT_CHARS) -> DataFrame:
    """F43, W8, P29. (qid, context, n_chunks, sufficient): blocks up to the budget."""
    blocks = df.withColumn("_block", context_block())
    # Every block adds two characters after itself, so the budget is compared before they are added.
    kept = budget_prefix(blocks, F.length("_block"), "qid", order, limit)
    joined = kept.groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_block"))), lambda x: x["_block"]), "\n\n---\n\n").alias("context"),
        F.count("*").alias("n_chunks"),
        F.min_by("score", order).alias("top_score"),
    )
    enough = (F.length(F.trim("context")) > 0) & ((F.length("context") >= 900) | (F.col("n_chunks") >= 3) | (F.col("top_score") >= 0.06))
    return joined.withColumn("sufficient", enough)


def snippets_text(df: DataFrame, limit: int = SNIPPET_CHARS) -> DataFrame:
    """C9, W8, S24. (qid, snippets): the first ten search snippets up to the budget."""
    block = F.concat(F.lit("- title: "), text("title"), F.lit("\n  url: "), text("url"), F.lit("\n  content: "), F.trim(text("content")))
    kept = budget_prefix(df.withColumn("_block", block), F.length("_block"), "qid", "ord", limit, gap=1, most=10)
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_block"))), lambda x: x["_block"]), "\n\n").alias("snippets"))
