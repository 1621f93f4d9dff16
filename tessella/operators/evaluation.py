"""Retrieval quality: rows of (qid, rank, text) against patterns of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_relevant, token_overlap
from ..functions.text import eval_tokens


def precision_recall(retrieved: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """A7, A8, J12. One row a question: precision over k, recall within what was retrieved, context precision over what there is.

    A question without results scores 0.
    """
    rows = retrieved.drop("patterns").join(questions.select("qid", "patterns"), "qid").withColumn("_rel", is_relevant(F.col("patterns"), "text"))
    top = F.col("rank") <= k
    counts = rows.groupBy("qid").agg(
        F.count_if(F.col("_rel") & top).alias("relevant_retrieved"), F.count_if(F.col("_rel")).alias("total_relevant"), F.count_if(top).alias("_top")
    )
    out = questions.select("qid").join(counts, "qid", "left").na.fill(0)
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 4))
    return out.select(
        "qid",
        share(F.col("relevant_retrieved"), F.lit(k)).alias("precision_at_k"),
        share(F.col("relevant_retrieved"), F.col("total_relevant")).alias("recall_at_k"),
        share(F.col("relevant_retrieved"), F.col("_top")).alias("context_precision"),
        "relevant_retrieved",
        "total_relevant",
    )


def answer_quality(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """F37, D2, D3. answer_relevance and faithfulness; answers: (qid, question, answer, patterns)."""
    context = retrieved.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(eval_tokens("text")))).alias("_context"))
    expected = F.array_distinct(F.flatten(F.transform("patterns", eval_tokens)))
    rows = answers.join(context, "qid", "left").withColumns({"_a": eval_tokens("answer"), "_e": F.coalesce(expected, F.expr("cast(array() AS array<string>)"))})
    wanted = F.when(F.size("_e") > 0, F.col("_e")).otherwise(eval_tokens("question"))
    ground = F.coalesce("_context", F.expr("cast(array() AS array<string>)"))
    return rows.select("qid", token_overlap(F.col("_a"), wanted).alias("answer_relevance"), token_overlap(ground, F.col("_a")).alias("faithfulness"))


def retrieval_delta(semantic: str = "semantic_precision", structured: str = "structured_precision"):
    """F38."""
    return F.round(F.col(semantic) - F.col(structured), 4)


def eval_summary(rows: DataFrame) -> DataFrame:
    """A6, C14. Means of all measures, 0 for none, and the number of rows."""
    measures = [c for c, t in rows.dtypes if t == "double"]
    return rows.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(f"mean_{c}") for c in measures], F.count("*").alias("rows"))
