"""Queries of column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import safe_filename, version_hash
from ..operators import chunking, cleaning, evaluation, rerank, vision
from ..sources.readers import table
from .registry import query
from .retrieval_queries import CHUNKS, chunks


@query(
    "file_names",
    r"""WITH t AS (SELECT p_partkey AS id, ' ' || p_name || ' / ' || p_type || ' (' || p_brand || ')' AS x FROM part)
    SELECT id, left(regexp_replace(regexp_replace(x, '[^\p{L}\p{N}._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS name, left(sha1(x), 12) AS version FROM t""",
)
def file_names(spark, sf_dir):
    """Names for files and versions of the descriptions of parts."""
    x = F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), safe_filename(x).alias("name"), version_hash(x).alias("version"))


@query(
    "media_types",
    "SELECT p_partkey AS id, ['.png', '.webp', '.gif', '.svg', '.jpg', '.jpg', '.pdf', ''][p_size % 8 + 1] AS extension FROM part",
)
def media_types(spark, sf_dir):
    """extensions of content types, dealt to parts by their size."""
    types = F.array(*map(F.lit, ("image/PNG", "image/webp", "image/gif; x=1", "image/svg+xml", "image/jpeg", "image/jpg", "application/pdf", "text/html")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), html.extension_of_type(F.get(types, F.col("p_size") % 8)).alias("extension"))


@query(
    "image_sets",
    """SELECT page_id, list_sort([{'s': page_id % 7 * 100.0, 'u': url || '-a.png'}, {'s': page_id % 3 * 200.0, 'u': url || '-b.png'}, {'s': 0.0, 'u': url || '-c.png'}])[-1].u AS best FROM pages""",
)
def image_sets(spark, sf_dir):
    """The candidate of greatest width or density; of equals the greater address."""
    width, density = (F.col("page_id") % 7 * 100).cast("string"), F.format_string("%.2f", F.col("page_id") % 3 * 0.02)
    srcset = F.concat("url", F.lit("-a.png "), width, F.lit("w, "), "url", F.lit("-b.png "), density, F.lit("x, "), "url", F.lit("-c.png"))
    return table(spark, sf_dir, "pages").select("page_id", html.srcset_best(srcset).alias("best"))


@query("redirect_targets", "SELECT page_id, url AS target FROM pages")
def redirect_targets(spark, sf_dir):
    """two thirds of the addresses as redirects of a search host, with and without the host."""
    hop = F.concat(F.lit("/url?sa=t&q="), F.url_encode("url"), F.lit("&ved=1"))
    wrapped = F.when(F.col("page_id") % 3 == 0, hop).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.google.com"), hop)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", html.unwrap_redirect(wrapped).alias("target"))


@query(
    "caption_fallbacks",
    r"""SELECT p_partkey AS id, left(trim(regexp_replace(p_name || ' ' || CASE WHEN p_size % 2 = 0 THEN p_type || '   ' || p_type ELSE '' END || ' ' || repeat(p_brand || chr(10), p_size), '\s+', ' ', 'g')), 300) AS fallback,
      'caption_en: ' || p_name || chr(10) || 'caption_th: ' || chr(10) || 'image_type: photo' || chr(10) || 'source_url: ' || p_brand AS caption FROM part""",
)
def caption_fallbacks(spark, sf_dir):
    """Captions from what stands around an image, and as text."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("alt_text"), F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit("   "), "p_type")).alias("title_text"), F.expr("repeat(concat(p_brand, '\n'), p_size)").alias("nearby_text"),
        F.col("p_name").alias("caption_en"), F.lit(None).cast("string").alias("caption_th"), F.lit("photo").alias("image_type"), F.col("p_brand").alias("source_url"),
    )
    return p.select("id", vision.fallback_caption().alias("fallback"), vision.caption_text().alias("caption"))


@query(
    "source_keys",
    f"""WITH {CHUNKS} SELECT key, count(*) AS chunks FROM (SELECT CASE WHEN id % 3 = 0 THEN source_url WHEN id % 3 = 1 THEN source_path ELSE source_type || ':' || page END AS key FROM chunks) GROUP BY key""",
)
def source_keys(spark, sf_dir):
    """the address, or else the path, or else kind and page."""
    third = F.col("id") % 3
    key = rerank.source_key(F.when(third == 0, F.col("source_url")).otherwise(""), F.when(third <= 1, F.col("source_path")), F.col("source_type"), F.col("page"))
    return chunks(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("chunks"))


@query("retrieval_deltas", "SELECT l_orderkey, l_linenumber, round(l_discount - l_tax, 4) AS delta FROM lineitem")
def retrieval_deltas(spark, sf_dir):
    """discount and tax in the place of two precisions."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", evaluation.retrieval_delta("l_discount", "l_tax").alias("delta"))


@query("merged_chunks", f"WITH {CHUNKS}, u AS (SELECT source_path, page, chunk_index, text FROM chunks UNION SELECT source_path, page, chunk_index, text || '!' FROM chunks WHERE id % 4 = 0) SELECT source_path, count(*) AS chunks, sum(length(text))::BIGINT AS n_chars FROM u GROUP BY source_path")
def merged_chunks(spark, sf_dir):
    """Results of two searches, the second with some texts changed, each chunk once."""
    c = chunks(spark, sf_dir)
    again = c.withColumn("text", F.when(F.col("id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    both = c.withColumn("ord", F.lit(0)).unionByName(again.withColumn("ord", F.lit(1)))
    return cleaning.dedupe_chunks(both).groupBy("source_path").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "inline_sections",
    """SELECT s_suppkey AS id, ['1. Name of ' || s_name || ' here.', '2. Balance of it, 3.5 times', '12. (End) of ' || s_nationkey] AS sections FROM supplier""",
)
def inline_sections(spark, sf_dir):
    """Sections inside a line, each up to the next number that a letter follows."""
    text = F.concat(F.lit("Intro 7  1. Name of "), "s_name", F.lit(" here. 2. Balance\n of it, 3.5 times 12. (End) of "), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), chunking.inline_sections(text).alias("sections"))
