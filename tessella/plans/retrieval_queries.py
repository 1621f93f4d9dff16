"""Queries over stored chunks, vectors and facts: retrieval, reranking, context, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scoring
from ..functions.text import match_text, search_terms
from ..operators import chunking, evaluation, patterns, pivots, rerank, retrieval, store
from ..operators.cleaning import budget_prefix, focus_window
from ..operators.facts import facts_answer, parse_facts
from ..sources.readers import table
from ..tables import once
from .registry import matched, phrases_of, query, quoted


def chunks(spark, sf_dir):
    """Documents in the place of stored chunks."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, "internal").otherwise("external").alias("namespace"),
        F.when(F.col("lang") == "en", "web_page").otherwise("pdf_page").alias("source_type"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com")).alias("source_url"),
        F.concat(F.lit("/data/"), "source", F.lit("/content.txt")).alias("source_path"),
        (F.col("doc_id") % 5).cast("int").alias("page"),
        F.col("doc_id").alias("chunk_index"),
        "text",
    )


CHUNKS = """chunks AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'internal' ELSE 'external' END AS namespace,
  CASE WHEN lang = 'en' THEN 'web_page' ELSE 'pdf_page' END AS source_type, 'https://' || source || '.example.com' AS source_url,
  '/data/' || source || '/content.txt' AS source_path, (doc_id % 5)::INT AS page, doc_id AS chunk_index, text FROM documents)"""
L2 = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    "semantic_topk",
    f"""SELECT vec_id, rank, round(1 / (1 + d), 6) AS score FROM (SELECT e.vec_id, {L2} AS d, row_number() OVER (ORDER BY {L2}, e.vec_id) AS rank
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 8 AND 1 / (1 + d) >= {C.MIN_SCORE}""",
)
def semantic_topk(spark, sf_dir):
    """J1, F10, P2, P5, O1."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("qid"), "embedding")
    out = retrieval.vector_topk(e.drop("label"), q, 8)
    return out.select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "batch_knn",
    f"""SELECT qid, vec_id, rank, round(d, 6) AS distance FROM (SELECT q.vec_id AS qid, e.vec_id, {L2} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2}, e.vec_id) AS rank
      FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 5""",
)
def batch_knn(spark, sf_dir):
    """J1 for a stated set of queries."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    out = retrieval.vector_topk(e, q, 5, 0.0)
    return out.select("qid", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(
    "pivot_knn",
    f"""SELECT qid, vec_id, rank, round(d, 6) AS distance FROM (SELECT q.vec_id AS qid, e.vec_id, {L2} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2}, e.vec_id) AS rank
      FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 5""",
)
def pivot_knn(spark, sf_dir):
    """J1 over an index of all vectors by pivots, for the queries of batch_knn."""
    e = table(spark, sf_dir, "embeddings")
    found, _ = pivots.PivotIndex.build(e).nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 5)
    return found.select("qid", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(
    "adjacent_cosine",
    """SELECT vec_id, round(dot / (sqrt(aa) * sqrt(bb) + 1e-9), 6) AS similarity FROM (SELECT vec_id, list_dot_product(a, b) AS dot, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb
      FROM (SELECT vec_id, embedding::DOUBLE[] AS a, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL)""",
)
def adjacent_cosine(spark, sf_dir):
    """W2, F9."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("_b", F.lag("embedding").over(w)).where("_b IS NOT NULL")
    return e.select("vec_id", F.round(scoring.cosine(F.col("_b"), F.col("embedding")), 6).alias("similarity"))


@query(
    "semantic_gap_chunks",
    f"""WITH s AS (SELECT label, vec_id, repeat('x', (vec_id * 37 % 160)::INT + 20) AS t, embedding::DOUBLE[] AS a, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    i AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9) < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS island FROM s),
    c AS (SELECT label, island, string_agg(t, ' ' ORDER BY vec_id) AS t, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS total FROM i GROUP BY label, island),
    g AS (SELECT *, sum(CASE WHEN length(t) >= {C.MIN_CHUNK_CHARS} THEN 1 ELSE 0 END) OVER w + CASE WHEN first_value(length(t)) OVER w < {C.MIN_CHUNK_CHARS} THEN 1 ELSE 0 END AS g
      FROM c WHERE total > 1 OR length(t) >= {C.MIN_CHUNK_CHARS} WINDOW w AS (PARTITION BY label ORDER BY island))
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY g)::INT AS chunk_index, sum(n)::BIGINT AS n_sentences, string_agg(t, ' ' ORDER BY island) AS text FROM g GROUP BY label, g""",
)
def semantic_gap_chunks(spark, sf_dir):
    """G6, W2, W3, W4, with sentences made up for the vectors."""
    e = table(spark, sf_dir, "embeddings").withColumn("sentence", F.repeat(F.lit("x"), (F.col("vec_id") * 37 % 160).cast("int") + 20))
    return chunking.semantic_chunks(e, "label", "vec_id", threshold=0.3)


QUESTION = "the thereon and with thatou erin"
COUNT = "(length(h) - length(replace(h, t, ''))) / length(t)"


def lexical_sql(hay: str, terms: str) -> str:
    return (
        f"list_sum(list_transform({terms}, lambda t: CASE WHEN contains({hay}, t) THEN least(3.0, 1 + ln(1 + (length({hay}) - length(replace({hay}, t, ''))) / length(t))) ELSE 0.0 END))"
        f" + 3.0 * len(list_filter({terms}, lambda t: contains({hay}, t))) / len({terms})"
    )


TERMS = f"[{quoted(['the', 'thereon', 'and', 'thatou', 'erin'])}]"


@query(
    "lexical_topk",
    f"""WITH {CHUNKS} SELECT id, round(score, 6) AS score, left(text, 360) AS text_preview FROM (SELECT id, source_path, chunk_index, text, {lexical_sql("lower(text)", TERMS)} AS score
      FROM (SELECT * FROM chunks WHERE namespace = 'internal' ORDER BY source_path, page, chunk_index LIMIT 320)) WHERE score >= {C.MIN_SCORE} ORDER BY score DESC, source_path, chunk_index LIMIT 8""",
)
def lexical_topk(spark, sf_dir):
    """J2, F8, O3, O4."""
    found = retrieval.lexical_topk(chunks(spark, sf_dir).where("namespace = 'internal'"), QUESTION, 8, order=("source_path", "page", "chunk_index"))
    return found.select("id", F.round("score", 6).alias("score"), "text_preview")


@query(
    "lexical_batch",
    f"""WITH q AS (SELECT item_id AS qid, list_filter(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]),
      lambda x: NOT list_contains([{quoted(C.SEARCH_STOPWORDS)}], x)) AS terms FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM benchmark))
    SELECT qid, doc_id, rank, round(score, 6) AS score FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM (SELECT qid, doc_id, {lexical_sql("hay", "terms")} AS score FROM q, (SELECT doc_id, lower(text) AS hay FROM documents)) WHERE score > 0) WHERE rank <= 3""",
)
def lexical_batch(spark, sf_dir):
    """Every benchmark item as a question against all documents."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    top = retrieval.top_lexical(table(spark, sf_dir, "documents").select("doc_id", "text"), q, 3, "doc_id")
    return top.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "phrase_counts",
    f"""WITH p AS (SELECT DISTINCT unnest({phrases_of("text")}) AS term FROM benchmark), d AS (SELECT doc_id, {matched("text")} AS hay FROM documents)
    SELECT term, count(*) AS texts, sum((length(hay) - length(replace(hay, term, ''))) / length(term))::BIGINT AS n FROM p JOIN d ON contains(hay, term) GROUP BY term""",
)
def phrase_counts(spark, sf_dir):
    """How many texts hold each phrase of the benchmark's items, and how often."""
    from ..functions import intent

    phrases = table(spark, sf_dir, "benchmark").select(F.explode(intent.query_phrases("text")).alias("term"))
    found = patterns.find_terms(table(spark, sf_dir, "documents").select("doc_id", match_text("text").alias("text")), phrases, "doc_id")
    return found.groupBy("term").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))


@query("chunk_ids", f"WITH {CHUNKS} SELECT id, sha1(namespace || '|' || source_type || '|' || source_url || '|' || source_path || '|' || page || '|' || chunk_index || '|' || text) AS chunk_id FROM chunks")
def chunk_ids(spark, sf_dir):
    """K3."""
    return chunks(spark, sf_dir).select("id", store.chunk_id().alias("chunk_id"))


def facts(spark, sf_dir):
    """Line items as facts: quantity, price and discount of every line."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 2 == 0, "internal").otherwise("external").alias("namespace"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("entity"),
        F.expr("stack(3, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount) AS (key, amount)"),
        F.year("l_shipdate").alias("year"),
        F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string")).alias("source_path"),
        F.col("l_linenumber").alias("page"),
    )
    return rows.withColumns({"value": F.round(F.col("amount") * 100).cast("long").cast("string"), "unit": F.lit("c")}).drop("amount")


FACTS = """facts AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'internal' ELSE 'external' END AS namespace, 'part-' || l_partkey AS entity, k.key AS key, year(l_shipdate)::INT AS year,
  '/orders/' || l_orderkey AS source_path, l_linenumber AS page, round(CASE k.key WHEN 'quantity' THEN l_quantity WHEN 'price' THEN l_extendedprice ELSE l_discount END * 100)::BIGINT::VARCHAR AS value, 'c' AS unit
  FROM lineitem, (VALUES ('quantity'), ('price'), ('discount')) k(key))"""
FACT_ID = "sha1(namespace || '|' || entity || '|' || key || '|' || value || '|' || year || '|' || source_path || '|' || page)"


@query("fact_ids", f"WITH {FACTS} SELECT key, count(*) AS n, count(DISTINCT {FACT_ID}) AS ids, min({FACT_ID}) AS first FROM facts GROUP BY key")
def fact_ids(spark, sf_dir):
    """K4."""
    ids = facts(spark, sf_dir).select("key", F.unhex(store.fact_id()).alias("id"))
    # Ids as bytes, and dealt before they are counted, as hardly any meets its like in a task that reads.
    each = ids.repartition("key", "id").groupBy("key", "id").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.lower(F.hex(F.min("id"))).alias("first"))


@query("structured_facts", f"WITH {FACTS} SELECT {FACT_ID} AS id, entity, value, year FROM facts WHERE namespace = 'internal' AND key = 'price' AND source_path LIKE '%/orders/1%' ORDER BY year, entity, id LIMIT 30")
def structured_facts(spark, sf_dir):
    """P3, O5."""
    rows = facts(spark, sf_dir).withColumn("id", store.fact_id())
    return retrieval.structured_facts(rows, "internal", "price", "/orders/1").select("id", "entity", "value", "year")


@query(
    "facts_answer",
    f"""WITH {FACTS}, r AS (SELECT entity AS qid, *, row_number() OVER (PARTITION BY entity, namespace ORDER BY year, {FACT_ID}) AS r FROM facts WHERE key = 'quantity'),
    f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE namespace WHEN 'internal' THEN 1 ELSE 2 END, r) AS n FROM r WHERE r <= 30)
    SELECT qid, '{C.FACTS_HEADING}' || chr(10) || string_agg('- [' || namespace || '] ' || entity || ' | ' || key || ' = ' || value || ' ' || unit || ' (year=' || year || ') [source: ' || source_path || ' (page ' || page || ')]', chr(10) ORDER BY n) AS answer,
      count(*) AS n_facts FROM f WHERE n <= 25 GROUP BY qid""",
)
def facts_answers(spark, sf_dir):
    """C7, O11, O12, F42."""
    rows = facts(spark, sf_dir).where("key = 'quantity'").withColumns({"id": store.fact_id(), "qid": F.col("entity")})
    return facts_answer(rows)


@query("upsert_chunks", f"WITH {CHUNKS}, old AS (SELECT id, namespace, text FROM chunks WHERE id % 3 <> 2), new AS (SELECT id, 'external' AS namespace, text || '!' AS text FROM chunks WHERE id % 3 <> 1) "
    "SELECT namespace, count(*) AS n, sum(length(text)) AS chars, min(sha1(text)) AS first FROM (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new) GROUP BY namespace")  # fmt: skip
def upsert_chunks(spark, sf_dir):
    """Of all rows a third is kept, a third replaced and a third new."""
    all_ = chunks(spark, sf_dir).select("id", "namespace", "text")
    new = all_.where("id % 3 <> 1").select("id", F.lit("external").alias("namespace"), F.concat("text", F.lit("!")).alias("text"))
    merged = store.merge_by_id(all_.where("id % 3 <> 2"), new)
    return merged.groupBy("namespace").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.sha1("text")).alias("first"))


@query("preview_chunks", f"WITH {CHUNKS} SELECT id, source_path, page, left(text, 260) AS text_preview FROM chunks WHERE namespace = 'internal' AND source_type = 'web_page' ORDER BY source_path, page, id LIMIT 20")
def preview(spark, sf_dir):
    """P1, O7, P6."""
    return retrieval.preview_chunks(chunks(spark, sf_dir), "internal", "web_page").select("id", "source_path", "page", "text_preview")


@query("source_chunks", f"WITH {CHUNKS} SELECT id, chunk_index, sha1(text) AS digest FROM chunks WHERE namespace = 'external' AND source_path = '/data/src3/content.txt' ORDER BY chunk_index LIMIT 50")
def source_chunks(spark, sf_dir):
    """P4, O6."""
    return retrieval.source_chunks(chunks(spark, sf_dir), "external", path="/data/src3/content.txt").select("id", "chunk_index", F.sha1("text").alias("digest"))


@query(
    "expand_source",
    f"""WITH {CHUNKS}, p AS (SELECT id AS qid, namespace, source_url, source_path FROM chunks WHERE id % 50 = 0)
    SELECT qid, id FROM (SELECT qid, c.id, row_number() OVER (PARTITION BY qid ORDER BY c.chunk_index, c.id) AS r FROM chunks c JOIN p USING (namespace, source_url, source_path)) WHERE r <= 50""",
)
def expand_source(spark, sf_dir):
    """J6 for a stated set of primary chunks."""
    c = chunks(spark, sf_dir)
    primary = c.where("id % 50 = 0").select(F.col("id").alias("qid"), "namespace", "source_url", "source_path")
    return retrieval.expand_source(c, primary).select("qid", "id")


@query(
    "documents_summary",
    f"""WITH {CHUNKS}, c AS (SELECT namespace, source_path, source_type, count(*) AS chunk_count, count(DISTINCT CASE WHEN page > 0 THEN page END) AS page_count FROM chunks GROUP BY ALL),
    f AS (SELECT 'internal' AS namespace, '/data/src' || (n_nationkey % 30) || '/content.txt' AS source_path, 'pdf_page' AS source_type, count(*) AS table_row_count FROM nation GROUP BY ALL)
    SELECT namespace, source_path, source_type, coalesce(chunk_count, 0) AS chunk_count, coalesce(page_count, 0) AS page_count, coalesce(table_row_count, 0) AS table_row_count,
      'completed' AS status, split_part(source_path, '/', 3) AS filename, CASE WHEN contains(source_type, 'web') THEN 'WEB_INGEST' ELSE upper(source_type) END AS type
    FROM c FULL JOIN f USING (namespace, source_path, source_type)""",
)
def documents_summary(spark, sf_dir):
    """A1, J4, O13, P26, P27."""
    n = table(spark, sf_dir, "nation")
    f = n.select(F.lit("internal").alias("namespace"), F.concat(F.lit("/data/src"), (F.col("n_nationkey") % 30).cast("string"), F.lit("/content.txt")).alias("source_path"), F.lit("pdf_page").alias("source_type"))
    return store.documents_summary(chunks(spark, sf_dir), f).drop("updated_at")


@query("documents_light", f"WITH {CHUNKS} SELECT namespace, source_path, source_type, count(*) AS chunk_count FROM chunks GROUP BY ALL ORDER BY 1, 2, 3 LIMIT 100")
def documents_light(spark, sf_dir):
    """A2."""
    return store.documents_light(chunks(spark, sf_dir))


@query(
    "merge_namespaces",
    f"""WITH {CHUNKS}, s AS (SELECT id, namespace, length(text) % 7 AS score FROM chunks), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, CASE namespace WHEN 'internal' THEN 0 ELSE 1 END, id) AS place FROM s)
    SELECT id, namespace, score::DOUBLE AS score FROM o WHERE place <= 40""",
)
def merge_namespaces(spark, sf_dir):
    """D1, O8, O17."""
    c = chunks(spark, sf_dir).select("id", "namespace", (F.length("text") % 7).cast("double").alias("score"))
    return retrieval.merge_namespaces([c.where("namespace = 'internal'"), c.where("namespace = 'external'")]).limit(40)


@query(
    "prefer_domain",
    f"""WITH {CHUNKS}, f AS (SELECT id, page, source_url, contains(source_url, 'src7') AND page < 3 AS hit, max((contains(source_url, 'src7') AND page < 3)::INT) OVER (PARTITION BY page) AS any_hit FROM chunks)
    SELECT page, count(*) AS n, count(DISTINCT source_url) AS sources FROM f WHERE hit OR any_hit = 0 GROUP BY page""",
)
def prefer_domain(spark, sf_dir):
    """P19, J10."""
    kept = retrieval.prefer(chunks(spark, sf_dir), F.col("source_url").contains("src7") & (F.col("page") < 3), "page")
    return kept.groupBy("page").agg(F.count("*").alias("n"), F.count_distinct("source_url").alias("sources"))


@query(
    "focus_window",
    """WITH m AS (SELECT source, doc_id, contains(text, 'token =') AS m FROM documents), w AS (SELECT *, max(m::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
      max(m::INT) OVER (PARTITION BY source) AS any_match FROM m) SELECT source, doc_id FROM w WHERE near = 1 OR any_match = 0""",
)
def focus(spark, sf_dir):
    """W6."""
    return focus_window(table(spark, sf_dir, "documents"), F.col("text").contains("token ="), "source", "doc_id").select("source", "doc_id")


@query(
    "context_budget",
    f"""WITH s AS (SELECT source, doc_id, sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id) - 2 > {C.CONTEXT_CHARS} AS over FROM documents),
    t AS (SELECT *, max(over::INT) OVER (PARTITION BY source ORDER BY doc_id) AS stop FROM s) SELECT source, doc_id FROM t WHERE stop = 0""",
)
def context_budget(spark, sf_dir):
    """W8."""
    return budget_prefix(table(spark, sf_dir, "documents"), F.length("text"), "source", "doc_id", C.CONTEXT_CHARS).select("source", "doc_id")


@query(
    "assemble_context",
    f"""WITH {CHUNKS}, b AS (SELECT source_url AS qid, id, 'SOURCE: [' || namespace || '] ' || source_url || CASE WHEN page > 0 THEN ' (page ' || page || ')' ELSE '' END || chr(10) || 'TEXT:' || chr(10) || text AS block, 0.05 AS score FROM chunks),
    s AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY qid ORDER BY id) - 2 > {C.CONTEXT_CHARS} AS over FROM b), t AS (SELECT *, max(over::INT) OVER (PARTITION BY qid ORDER BY id) AS stop FROM s)
    SELECT qid, sha1(c) AS digest, n AS n_chunks, (length(c) >= 900 OR n >= 3) AS sufficient FROM (SELECT qid, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id) AS c, count(*) AS n FROM t WHERE stop = 0 GROUP BY qid)""",
)
def assemble_context(spark, sf_dir):
    """F43, W8, P29."""
    c = chunks(spark, sf_dir).withColumns({"qid": F.col("source_url"), "rank": F.col("id"), "score": F.lit(0.05)})
    return rerank.assemble_context(c).select("qid", F.sha1("context").alias("digest"), "n_chunks", "sufficient")


def questions(spark, sf_dir):
    """Benchmark items as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query(
    "rerank",
    f"""WITH {CHUNKS}, q AS (SELECT item_id AS qid, 'https://src' || item_id % 20 || '.example.com' AS source_url, list_distinct({phrases_of("text")}) AS phrases FROM benchmark),
    f AS (SELECT qid, id, list_filter(phrases, lambda p: contains(hay, p)) AS found FROM q JOIN (SELECT *, {matched("text")} AS hay FROM chunks) USING (source_url)),
    s AS (SELECT qid, id, len(found) AS matches, coalesce(list_sum(list_transform(found, lambda p: CASE WHEN contains(p, ' ') OR length(p) >= 8 THEN 0.14::DOUBLE ELSE 0.06 END)), 0) AS phrase_score FROM f),
    c AS (SELECT *, 0.1::DOUBLE + phrase_score + 0.03::DOUBLE * least(sum(matches) OVER (PARTITION BY qid), 3) AS combined FROM s)
    SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(combined, 9) DESC, round(phrase_score, 9) DESC, matches DESC, id)::INT AS rank, round(combined, 6) AS combined, matches::INT AS matches FROM c""",
)
def rerank_all(spark, sf_dir):
    """No question is about one article, and each meets the chunks of one address."""
    c = once(chunks(spark, sf_dir), normal=match_text("text"))
    asked = questions(spark, sf_dir).withColumn("_s", F.concat(F.lit("https://src"), (F.col("qid") % 20).cast("string"), F.lit(".example.com")))
    rows = c.join(asked, F.col("source_url") == F.col("_s")).withColumns({"score": F.lit(0.1), "ord": F.col("id")})
    return rerank.rerank(rows, phrases=rerank.phrases_of(questions(spark, sf_dir)), normal="normal").select("qid", "id", "rank", F.round("combined", 6).alias("combined"), "matches")


RELEVANT = "contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'thereon') OR contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'apache license')"


@query(
    "precision_recall",
    f"""WITH r AS (SELECT source AS qid, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, ({RELEVANT}) AS rel FROM documents),
    c AS (SELECT qid, count(*) FILTER (rel AND rank <= 5) AS hit, count(*) FILTER (rel) AS total, count(*) FILTER (rank <= 5) AS top FROM r GROUP BY qid)
    SELECT qid, round(hit / 5.0, 4) AS precision_at_k, CASE WHEN total = 0 THEN 0.0 ELSE round(hit / total, 4) END AS recall_at_k, round(hit / top, 4) AS context_precision, hit AS relevant_retrieved, total AS total_relevant FROM c""",
)
def precision_recall(spark, sf_dir):
    """A7, A8, P23, J12."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents")
    w = Window.partitionBy("source").orderBy("doc_id")
    got = d.select(F.col("source").alias("qid"), "text", F.row_number().over(w).alias("rank"))
    asked = d.select(F.col("source").alias("qid")).distinct().withColumn("patterns", F.array(F.lit("Thereon"), F.lit("apache  license")))
    return evaluation.precision_recall(got, asked)


TOKENS = "list_distinct(regexp_extract_all(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), '[\\p{{L}}\\p{{N}}_ก-๙]{{2,}}'))"


@query(
    "answer_quality",
    f"""WITH u AS (SELECT conv_id, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, min_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1),
    c AS (SELECT conv_id, string_agg(text, ' ') AS context FROM conversations WHERE role = 'user' GROUP BY 1),
    t AS (SELECT conv_id AS qid, {TOKENS.format("answer")} AS a, {TOKENS.format("question")} AS q, {TOKENS.format("context")} AS c FROM u JOIN a USING (conv_id) JOIN c USING (conv_id))
    SELECT qid, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(a, q)) / len(q), 4) END AS answer_relevance,
      CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(c, a)) / len(a), 4) END AS faithfulness FROM t""",
)
def answer_quality(spark, sf_dir):
    """F37, D2, D3."""
    t = table(spark, sf_dir, "conversations")
    first = lambda role, name: t.where(F.col("role") == role).groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias(name))
    answers = first("user", "question").join(first("assistant", "answer"), "qid").withColumn("patterns", F.expr("cast(array() AS array<string>)"))
    return evaluation.answer_quality(answers, t.where("role = 'user'").select(F.col("conv_id").alias("qid"), "text"))


@query(
    "eval_summary",
    """SELECT round(coalesce(avg(o_totalprice / 1000000), 0), 4) AS mean_price, round(coalesce(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 0), 4) AS mean_done, count(*) AS rows FROM orders""",
)
def eval_summary(spark, sf_dir):
    """A6, C14."""
    o = table(spark, sf_dir, "orders")
    return evaluation.eval_summary(o.select((F.col("o_totalprice") / 1000000).alias("price"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("done")))


@query(
    "json_facts",
    """SELECT event_id AS doc_id, 0 AS ord, event_type AS entity, 'k' AS key, json_extract_string(props, '$.k') AS value, '' AS unit, user_id::INT AS year, event_type AS evidence_text FROM events WHERE json_extract_string(props, '$.k') <> ''""",
)
def json_facts(spark, sf_dir):
    """Events in the place of an extractor's fenced answers."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    good = F.struct(F.col("event_type").alias("entity"), F.lit("k").alias("key"), F.col("k").alias("value"), F.lit("").alias("unit"), F.col("user_id").cast("string").alias("year"), F.col("event_type").alias("evidence_text"))
    false = F.struct(F.lit("x").alias("entity"), F.lit("k").alias("key"), F.lit("1").alias("value"), F.lit("").alias("unit"), F.lit("1").alias("year"), F.lit("not in the text").alias("evidence_text"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("e").alias("entity_hint"), F.array(good, false).alias("facts"))), F.lit("\n```"))
    rows = e.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("text"), F.lit("h").alias("entity_hint"), answer.alias("answer"))
    return parse_facts(rows)


@query(
    "term_overlap",
    """SELECT doc_id, len(t) AS n FROM (SELECT doc_id, list_filter(['the', 'thereon', 'and', 'thatou', 'erin'], lambda t: contains(lower(text), t)) AS t FROM documents)""",
)
def term_overlap(spark, sf_dir):
    """Terms of a question that a text holds."""
    terms = search_terms(F.lit(QUESTION))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(terms, lambda t: F.lower("text").contains(t))).cast("long").alias("n"))
