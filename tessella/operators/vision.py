"""Metadata of images: captions, types, relevance, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import image_type, keep_image, relevance_terms
from ..functions.text import collapse_space, text
from .cleaning import mark_duplicates


def add_relevance(df: DataFrame, context: str, caption: str, out: str = "relevance_score") -> DataFrame:
    """F11. TF-IDF cosine of a context's first 7000 and a caption's first 600 characters, the two being the corpus.

    Terms are sorted and counted inside the row: a term of both texts weighs 1, of one text ln(1.5) + 1.
    """
    df = df.withColumns({"_a": relevance_terms(text(context), 7000), "_b": relevance_terms(text(caption), 600)})
    both = F.array_intersect("_a", "_b")
    df = df.withColumn("_both", both)

    def counts(c: str) -> Column:
        # Runs of the sorted terms: struct(term, n).
        start = F.struct(F.expr("cast(array() AS array<struct<t:string,n:int>>)").alias("o"), F.lit(None).cast("string").alias("t"), F.lit(0).alias("n"))
        close = lambda a: F.when(a["t"].isNull(), a["o"]).otherwise(F.concat(a["o"], F.array(F.struct(a["t"].alias("t"), a["n"].alias("n")))))
        step = lambda a, t: F.when(a["t"] == t, F.struct(a["o"].alias("o"), a["t"].alias("t"), (a["n"] + 1).alias("n"))).otherwise(F.struct(close(a).alias("o"), t.alias("t"), F.lit(1).alias("n")))
        return F.aggregate(F.array_sort(c), start, step, close)

    df = df.withColumns({"_ca": counts("_a"), "_cb": counts("_b")})
    idf = F.log(F.lit(1.5)) + 1
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.pow(x["n"] * F.when(F.array_contains("_both", x["t"]), 1.0).otherwise(idf), F.lit(2.0))))
    counted = lambda c, t: F.aggregate(F.filter(c, lambda x: x["t"] == t), F.lit(0.0), lambda s, x: s + x["n"])
    dot = F.aggregate("_both", F.lit(0.0), lambda s, t: s + counted(F.col("_ca"), t) * counted(F.col("_cb"), t))
    score = F.when((F.size("_a") == 0) | (F.size("_b") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (norm("_ca") * norm("_cb")))))
    return df.withColumn(out, score).drop("_a", "_b", "_both", "_ca", "_cb")


def fallback_caption(alt: str = "alt_text", title: str = "title_text", nearby: str = "nearby_text") -> Column:
    """P22, F40."""
    return F.substring(collapse_space(F.concat_ws(" ", text(alt), text(title), text(nearby))), 1, 300)


def caption_text() -> Column:
    """F41."""
    line = lambda label, c: F.concat(F.lit(label), text(c))
    return F.concat_ws("\n", line("caption_en: ", "caption_en"), line("caption_th: ", "caption_th"), line("image_type: ", "image_type"), line("source_url: ", "source_url"))


def latest_meta(meta: DataFrame, key: str, order: str) -> DataFrame:
    """J5. One row a key; the last wins."""
    rest = [c for c in meta.columns if c != key]
    return meta.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_m")).select(key, "_m.*")


def join_meta(images: DataFrame, meta: DataFrame, order: str = "ord") -> DataFrame:
    """J5. Download metadata by hash, or else by path, or else none."""
    fields = [c for c in meta.columns if c not in ("sha1", "saved_path", order)]
    by_hash = latest_meta(meta.drop("saved_path"), "sha1", order).select("sha1", F.struct(*fields).alias("_h"))
    by_path = latest_meta(meta.drop("sha1"), "saved_path", order).select(F.col("saved_path").alias("path"), F.struct(*fields).alias("_p"))
    return images.join(by_hash, "sha1", "left").join(by_path, "path", "left").withColumn("_m", F.coalesce("_h", "_p")).select(*images.columns, *[F.col(f"_m.{c}").alias(c) for c in fields])


def understand(images: DataFrame, caption: str = "caption_en") -> DataFrame:
    """C13, A11, J14. Type, relevance, keep flag and duplicates of captioned images; a duplicate takes all of these and the captions of the first."""
    df = images.withColumn("image_type", image_type(caption))
    df = add_relevance(df, "page_context", caption)
    df = df.withColumn("keep_for_rag", keep_image(F.col("relevance_score"), F.col("image_type")))
    marked = mark_duplicates(df, "sha1", "path", "path")
    taken = [c for c in (caption, "caption_th", "image_type", "relevance_score", "keep_for_rag") if c in marked.columns]
    # First rows that have duplicates, one row each, so that a hot one's duplicates can be split.
    first = marked.where(~F.col("is_duplicate")).select(F.col("path").alias("_path"), F.struct(*taken).alias("_of"))
    joined = marked.join(first, F.col("duplicate_of") == F.col("_path"), "left")
    values = {c: F.when(F.col("is_duplicate"), F.col(f"_of.{c}")).otherwise(F.col(c)) for c in taken}
    return joined.withColumns(values).select(*marked.columns)


def caption_totals(df: DataFrame) -> DataFrame:
    """A11."""
    return df.agg(F.count("*").alias("total"), F.count_if(text("caption_en") != "").alias("captioned"), F.count_if(F.col("is_duplicate")).alias("duplicates"), F.count_if(F.col("keep_for_rag")).alias("kept"))


def for_ingest(df: DataFrame) -> DataFrame:
    """P16."""
    return df.where((F.col("type") == "image_understanding") & ~F.coalesce("is_duplicate", F.lit(False)) & F.coalesce("keep_for_rag", F.lit(False)))
