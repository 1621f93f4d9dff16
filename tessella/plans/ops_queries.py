"""Queries over pages, images, jobs, runs and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import html, scoring
from ..models import extractive_generator, hash_embedding
from ..operators import cleaning, store, summaries, vision
from ..sources import readers
from ..sources.readers import table
from ..tables import bound_batches, once
from . import answers
from .pipelines import ask, ingest_pages, run_eval
from .registry import query, quoted
from .retrieval_queries import chunks
from .text_queries import blocks

STRIPPED = r"regexp_replace(regexp_replace({}, '<[^>]+>', chr(10), 'g'), '\s*\n\s*', chr(10), 'g')"
ENTITIES = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("page_title", f"SELECT page_id, {ENTITIES.format(r'''regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g')''')} AS title FROM pages")
def page_title(spark, sf_dir):
    """P21."""
    return table(spark, sf_dir, "pages").select("page_id", html.page_title("html").alias("title"))


LINES = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', chr(1), 'g'), chr(1)), lambda x: "
    + ENTITIES.format(r"regexp_replace(x, '^\s+|\s+$', '', 'g')")
    + "), lambda x: x <> '')"
)


@query("page_text", f"SELECT page_id, array_to_string({LINES}, chr(10)) AS article, array_to_string({LINES}, chr(10)) AS main, [] AS outline FROM pages")
def page_text(spark, sf_dir):
    """F36, P20, G11. The pages hold one container and no numbered title; others are tested on fixtures."""
    return table(spark, sf_dir, "pages").select("page_id", html.page_article_text("html").alias("article"), html.page_main_text("html").alias("main"), html.page_outline("html").alias("outline"))


@query(
    "page_content",
)
def page_content(spark, sf_dir):
    """The best candidate of a page's texts."""
    pages = bound_batches(table(spark, sf_dir, "pages")).select("page_id", "html")
    p = once(pages, x=html.page_texts("html")).select("page_id", F.col("x.article").alias("a"), F.col("x.main").alias("m"))
    p = once(p, v=cleaning.normalize_visible_text("m"))
    return p.select("page_id", cleaning.page_content(F.col("a"), F.col("m"), F.col("v")).alias("content"))


@query("page_links")
def page_links(spark, sf_dir):
    """G12, G13, D8, F33. Tested against fixtures."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", html.page_file_links("html", "url").alias("files"), html.page_images("html", "url").alias("images"))


@query("search_targets", "SELECT url, row_number() OVER (ORDER BY page_id)::INT AS rank FROM (SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY page_id) = 1) ORDER BY page_id LIMIT 25")
def search_targets(spark, sf_dir):
    """Pages in the place of search results."""
    p = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("ord"))
    return readers.search_targets(p, 25).select("url", "rank")


@query(
    "duplicate_flags",
    """SELECT doc_id, doc_id <> first AS is_duplicate, CASE WHEN doc_id <> first THEN first END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS first FROM documents)""",
)
def duplicate_flags(spark, sf_dir):
    """W10, D10, J14."""
    return cleaning.mark_duplicates(table(spark, sf_dir, "documents"), F.sha1("text"), "doc_id", "doc_id").select("doc_id", "is_duplicate", "duplicate_of")


@query("dedupe_rows", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) = 1")
def dedupe_rows(spark, sf_dir):
    """The first row of each key."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return cleaning.keep_first(rows, ["l_partkey", "l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_linenumber")


IDF = "(ln(1.5) + 1)"


@query(
    "tfidf_relevance",
    rf"""WITH t AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\p{{L}}\p{{N}}_]{{2,}}') AS a, regexp_extract_all(lower(p_type), '[\p{{L}}\p{{N}}_]{{2,}}') AS b FROM part),
    ca AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(a) AS x FROM t) GROUP BY ALL), cb AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(b) AS x FROM t) GROUP BY ALL),
    j AS (SELECT coalesce(ca.id, cb.id) AS id, coalesce(ca.n, 0) AS p, coalesce(cb.n, 0) AS q, CASE WHEN ca.x IS NOT NULL AND cb.x IS NOT NULL THEN 1.0 ELSE {IDF} END AS w FROM ca FULL JOIN cb ON ca.id = cb.id AND ca.x = cb.x)
    SELECT id, round(least(1.0, sum(p * q * w * w) / (sqrt(sum(p * p * w * w)) * sqrt(sum(q * q * w * w)))), 6) AS relevance FROM j GROUP BY id""",
)
def tfidf_relevance(spark, sf_dir):
    """a part's whole description as context, its type as caption."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("context"), F.col("p_type").alias("caption"))
    return vision.add_relevance(p, "context", "caption").select("id", F.round("relevance_score", 6).alias("relevance"))


def images(spark, sf_dir):
    """Parts as captioned images."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/img/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"),
        F.sha1(F.concat("p_brand", F.col("p_size").cast("string"))).alias("sha1"),
        # A copy of an image has no caption of its own.
        F.when(F.col("p_partkey") % 3 > 0, F.concat_ws(" ", F.lit("a chart of"), "p_name")).otherwise("").alias("caption_en"),
        F.concat_ws(" ", "p_name", "p_type").alias("page_context"),
    )


@query(
    "image_understanding",
    """WITH f AS (SELECT count(*) OVER (PARTITION BY p_brand || p_size) AS n, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand || p_size) AS first, p_partkey % 3 > 0 AS captioned FROM part)
    SELECT sum(n)::BIGINT AS total, sum(n) FILTER (captioned)::BIGINT AS captioned, (sum(n) - count(*))::BIGINT AS duplicates, sum(n) FILTER (captioned)::BIGINT AS kept FROM f WHERE first""",
)
def image_understanding(spark, sf_dir):
    """C13, A11, P15, P16, J14."""
    return vision.caption_totals(vision.understand(images(spark, sf_dir)))


@query(
    "join_image_meta",
    """WITH m AS (SELECT s_suppkey % 25 AS k, max_by(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) SELECT n_nationkey AS id, name FROM nation LEFT JOIN m ON n_nationkey = k""",
)
def join_image_meta(spark, sf_dir):
    """The last metadata row of a hash, or none."""
    img = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.sha1(F.col("n_nationkey").cast("string")).alias("sha1"), F.concat(F.lit("/x/"), F.col("n_nationkey").cast("string")).alias("path"))
    meta = table(spark, sf_dir, "supplier").select(
        F.sha1((F.col("s_suppkey") % 25).cast("string")).alias("sha1"), F.lit(None).cast("string").alias("saved_path"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord")
    )
    return vision.join_meta(img, meta).select("id", "name")


@query("scrape_summary", "SELECT count(*) AS item_count, count(DISTINCT url) AS url_count, sum(page_id % 4)::BIGINT AS downloaded_images, sum(page_id % 3)::BIGINT AS downloaded_files, sum(page_id % 2)::BIGINT AS pdf_extracted FROM pages")
def scrape_summary(spark, sf_dir):
    """A3."""
    p = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 4).alias("downloaded_images"), (F.col("page_id") % 3).alias("downloaded_files"), (F.col("page_id") % 2).alias("pdf_extracted"))
    return summaries.scrape_summary(p)


@query(
    "ocr_summary",
    """SELECT count(DISTINCT source) AS ocr_docs_jsonl, count(*) FILTER (doc_id % 4 <> 0) AS ocr_pages, count(*) FILTER (doc_id % 4 = 0) AS ocr_figures,
      count(*) FILTER (doc_id % 4 <> 0 AND n_chars >= 300) AS ocr_text_layer_pages, count(*) FILTER (doc_id % 4 <> 0 AND n_chars < 300) AS ocr_paddle_pages FROM documents""",
)
def ocr_summary(spark, sf_dir):
    """A4, A9."""
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("file"), F.when(F.col("doc_id") % 4 == 0, "figure").otherwise("page_text").alias("type"), F.when(F.col("n_chars") >= 300, "text_layer").otherwise("paddleocr_en").alias("extract_method")
    )
    return summaries.ocr_summary(d)


@query("site_audit", "SELECT user_id % 10 AS folder, count(*) FILTER (event_type = 'click') AS image_count, count(*) FILTER (event_type = 'view') AS image_meta_count, 0::BIGINT AS understanding_count, count(*) FILTER (event_type NOT IN ('click', 'view')) AS file_count FROM events GROUP BY 1")
def site_audit(spark, sf_dir):
    """A10: event kinds in the place of file kinds."""
    kind = F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "view", "image_meta").otherwise("file")
    return summaries.site_audit(table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("folder"), kind.alias("kind")))


@query("ingest_totals", "SELECT sum(l_linenumber)::BIGINT AS added_chunks, count(*) FILTER (l_returnflag = 'R') AS added_facts, count(*) FILTER (l_quantity < 10) AS skipped FROM lineitem")
def ingest_totals(spark, sf_dir):
    """A12, P17."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("chunks"), (F.col("l_returnflag") == "R").cast("long").alias("facts"), (F.col("l_quantity") < 10).cast("long").alias("skipped")
    )
    return summaries.ingest_totals(rows)


@query("dashboard_totals", "SELECT count(*) AS documents, sum(n)::BIGINT AS chunks, sum(c)::BIGINT AS table_rows FROM (SELECT source, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY source)")
def dashboard_totals(spark, sf_dir):
    """A15."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunk_count"), F.sum("n_chars").alias("table_row_count"))
    return summaries.dashboard_totals(d)


@query("source_coverage", "SELECT source, n AS chunks, round(100.0 * n / max(n) OVER ())::INT AS percent FROM (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 8)")
def source_coverage(spark, sf_dir):
    """A16."""
    return summaries.source_coverage(table(spark, sf_dir, "documents"), "source")


@query("question_history", "SELECT text AS question, count(*) AS times FROM conversations WHERE role = 'user' GROUP BY text ORDER BY times DESC, question LIMIT 10")
def question_history(spark, sf_dir):
    """A17."""
    return summaries.question_history(table(spark, sf_dir, "conversations").where("role = 'user'"), "text")


@query("distinct_warnings", "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def distinct_warnings(spark, sf_dir):
    """A18, D13."""
    return summaries.distinct_in_order(table(spark, sf_dir, "events"), "event_type", "event_id")


def runs(spark, sf_dir):
    """Orders as experiment runs."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("experiment"), F.col("o_orderkey").alias("run_id"), F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_name"), F.unix_timestamp("o_orderdate").alias("start_time"), F.col("o_totalprice").alias("value"), "o_orderstatus"
    )


@query(
    "recent_runs",
    """SELECT experiment, run_id, start_time FROM (SELECT o_orderpriority AS experiment, o_orderkey AS run_id, epoch(o_orderdate)::BIGINT AS start_time FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) <= 12) ORDER BY start_time DESC, run_id LIMIT 20""",
)
def recent_runs(spark, sf_dir):
    """S26, W12, O14."""
    return summaries.recent_runs(runs(spark, sf_dir)).select("experiment", "run_id", "start_time")


@query(
    "latest_metric",
    """SELECT arg_max(value, (day, name = 'F')) AS value FROM (SELECT o_orderdate AS day, o_orderstatus AS name, max(o_totalprice) AS value FROM orders GROUP BY 1, 2) WHERE name IN ('F', 'O')""",
)
def latest_metric(spark, sf_dir):
    """Days as runs, the greatest price of each status as its metrics; the first listed metric of the newest day."""
    m = runs(spark, sf_dir).groupBy("start_time", F.col("o_orderstatus").alias("name")).agg(F.max("value").alias("value"))
    return summaries.latest_metric(m, ("F", "O"))


@query(
    "recent_series",
    """WITH n AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS t, o_totalprice AS y FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8)
    SELECT 'run-' || o_orderkey AS x, y, round(y / max(y) OVER (), 6) AS share, t AS start_time FROM n""",
)
def recent_series(spark, sf_dir):
    """A20, A21."""
    m = runs(spark, sf_dir).withColumn("name", F.lit("price"))
    return summaries.recent_series(m, "price").withColumn("share", F.round("share", 6))


def jobs(spark, sf_dir):
    """Events as job status rows."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("updated_at"))


@query("job_latest_status", f"SELECT user_id AS job_id, max_by(event_type, event_id) AS stage, max(event_id) AS updated_at, max_by(event_type, event_id) IN ({quoted(C.TERMINAL_STAGES)}) AS terminal FROM events GROUP BY user_id")
def job_latest_status(spark, sf_dir):
    """W11, T-1, S27, P30."""
    return summaries.job_status(jobs(spark, sf_dir))


def status_events(spark, sf_dir):
    """Events as status events: a signup begins its user's job anew, and each sets keys of its own besides the stage."""
    e = table(spark, sf_dir, "events")
    extra = F.create_map(F.concat(F.lit("last_"), "event_type"), F.col("props"), F.lit("value"), F.round(F.col("value") * 100).cast("long").cast("string"))
    some = F.map_filter(extra, lambda k, v: (k != "value") | (F.col("event_id") % 3 == 0))
    own_stage = F.when(F.col("event_id") % 50 == 0, F.map_concat(some, F.create_map(F.lit("stage"), F.lit("done")))).otherwise(some)
    return e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string")).alias("message"), F.col("event_id").alias("updated_at"), own_stage.alias("extra"), (F.col("event_type") == "signup").alias("reset"))


@query(
    "job_merged_status",
    f"""WITH e AS (SELECT user_id AS job_id, event_id AS o, event_type AS t, props, value FROM events),
    r AS (SELECT job_id, coalesce(max(o) FILTER (t = 'signup'), -1) AS reset, max(o) AS updated_at FROM e GROUP BY job_id),
    k AS (SELECT job_id, o, 'stage' AS key, CASE WHEN o % 50 = 0 THEN 'done' ELSE t END AS v FROM e UNION ALL SELECT job_id, o, 'message', 'm' || o % 7 FROM e UNION ALL SELECT job_id, o, 'last_' || t, props FROM e
      UNION ALL SELECT job_id, o, 'value', round(value * 100)::BIGINT::VARCHAR FROM e WHERE o % 3 = 0),
    m AS (SELECT job_id, key, arg_max(v, o) AS v FROM k JOIN r USING (job_id) WHERE o >= reset GROUP BY ALL)
    SELECT job_id, updated_at, max(v) FILTER (key = 'stage') AS stage, max(v) FILTER (key = 'stage') IN ({quoted(C.TERMINAL_STAGES)}) AS terminal, string_agg(key || '=' || v, ',' ORDER BY key) AS status FROM m JOIN r USING (job_id) GROUP BY ALL""",
)
def job_merged_status(spark, sf_dir):
    """T-1: every key a job's events have set since it began, each with its latest value."""
    out = summaries.merged_status(status_events(spark, sf_dir))
    shown = F.array_join(F.transform(F.map_entries("status"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("job_id", "updated_at", "stage", "terminal", shown.alias("status"))


@query("job_log_tail", "SELECT user_id AS job_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def job_log_tail(spark, sf_dir):
    """W11, T-2, K11."""
    logs = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("id"))
    return summaries.job_logs(logs, 3).select("job_id", "id")


@query("workflow_steps", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(C.WORKFLOW_STAGES, 1)) + ") t(step, stage)")
def workflow_steps(spark, sf_dir):
    """T-3."""
    return summaries.workflow_steps(spark)


@query("stage_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS stage, count(*) AS events FROM events GROUP BY ALL")
def stage_counts(spark, sf_dir):
    """T-4, T-6: the batch form of the windowed progress counts."""
    from ..streaming.jobs import stage_counts as counts

    return counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"))


@query("metric_cards", "SELECT l_linenumber AS id, printf('%.1f%%', avg(l_discount) * 100) AS percent, printf('%.0f ms', avg(l_quantity)) AS ms FROM lineitem GROUP BY 1")
def metric_cards(spark, sf_dir):
    """F39."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("id")).agg(F.avg("l_discount").alias("d"), F.avg("l_quantity").alias("q"))
    return rows.select("id", summaries.format_metric(F.col("d"), "percent").alias("percent"), summaries.format_metric(F.col("q"), "ms").alias("ms"))


@query("pdf_text", "SELECT source AS path, sha1(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest, count(*) AS pages FROM documents WHERE trim(text) <> '' GROUP BY source")
def pdf_text(spark, sf_dir):
    """Documents as pages of a file per source."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("page"), "text")
    return readers.pdf_text(pages).select("path", F.sha1("text").alias("digest"), "pages")


@query("embed_texts")
def embed_texts(spark, sf_dir):
    """U2, U3. Stand-in vectors of all conversation turns."""
    from ..models import embed_column
    from ..operators.store import zero_vector_fallback

    t = table(spark, sf_dir, "conversations").withColumn("embedding", embed_column(hash_embedding(32), "text"))
    return zero_vector_fallback(t, 32).select("conv_id", "turn", "embedding", "score_hint")


@query("ask")
def ask_all(spark, sf_dir):
    """C1-C9, POST /ask: benchmark items as questions over all documents, a fifth of them for a figure, with stand-in models."""
    return ask(chunks(spark, sf_dir), asked(spark, sf_dir), hash_embedding(32), extractive_generator, k=5, facts=yearly_facts(spark, sf_dir))


def asked(spark, sf_dir):
    """Benchmark items as questions; of every fifth item for revenue."""
    b = table(spark, sf_dir, "benchmark")
    figure = F.when(F.col("item_id") % 5 == 0, F.lit("revenue of ")).otherwise("")
    return b.select(F.col("item_id").alias("qid"), F.concat(figure, "text").alias("question"), F.array("text").alias("patterns"))


def yearly_facts(spark, sf_dir):
    """Yearly sums of the nations' orders as facts."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").cast("long").cast("string").alias("value"))
    fact = sums.select(
        F.when(F.length("n_name") % 2 == 0, "internal").otherwise("external").alias("namespace"), F.col("n_name").alias("entity"), F.lit("revenue").alias("key"), "value", F.lit("USD").alias("unit"),
        "year", F.concat(F.lit("/orders/"), "n_name").alias("source_path"), F.lit(0).alias("page"), F.concat(F.lit("sum of "), "n_name").alias("evidence_text"),
    )
    return fact.withColumn("id", store.fact_id())


@query("ingest_pages")
def ingest_all_pages(spark, sf_dir):
    """Pages to chunks with ids and vectors."""
    out = ingest_pages(table(spark, sf_dir, "pages"), hash_embedding(32))
    return out.select("id", "source_url", "chunk_index", "chunk_total", F.length("text").alias("n_chars"), "score_hint")


@query("run_eval")
def evaluate_all(spark, sf_dir):
    """C14: quality of vector search, facts and answers on the benchmark, with stand-in models."""
    return run_eval(chunks(spark, sf_dir), asked(spark, sf_dir), hash_embedding(32), extractive_generator, k=5, facts=yearly_facts(spark, sf_dir))


@query("vector_similarity", "SELECT vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: x * 0.5))), 6) AS score FROM embeddings")
def vector_similarity(spark, sf_dir):
    """F10."""
    e = table(spark, sf_dir, "embeddings")
    half = F.transform("embedding", lambda x: x.cast("double") * 0.5)
    return e.select("vec_id", F.round(scoring.similarity(scoring.l2_distance(F.col("embedding"), half)), 6).alias("score"))


def numbered_sources(spark, sf_dir, asks="", size=9):
    """Documents as numbered articles: all their lines as sections, numbered anew in each block of ``size``, with a question a block."""
    solid = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\d", ""))), lambda s: s != "")
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(blocks(solid, size)).alias("_b", "_l"))
    text = F.array_join(F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), " ")
    asked = F.concat(F.lit("5 trends of "), F.substring(F.element_at("_l", -1), 1, 40), F.lit(asks))
    # The question is read several times.
    return once(d, qid=F.concat_ws("/", "source", "doc_id", F.col("_b") + 1), source_text=text, question=asked).select("qid", "source_text", "question")


@query("numbered_list_answers")
def numbered_list_answers(spark, sf_dir):
    """C4, A22, D12, F25, F42."""
    return answers.numbered_list_answers(numbered_sources(spark, sf_dir, " 1-5", 5))


@query("focus_answers")
def focus_answers(spark, sf_dir):
    """C6, A23, F28, F29, J11."""
    return answers.focus_answers(numbered_sources(spark, sf_dir, " ตัวเลข"))


@query("article_answers")
def article_answers(spark, sf_dir):
    """C5, A24, G15."""
    return answers.article_answers(numbered_sources(spark, sf_dir))


@query("expand_primary")
def expand_primary(spark, sf_dir):
    """Benchmark items asked of the sources."""
    from .retrieval_queries import questions

    c = chunks(spark, sf_dir)
    asked = questions(spark, sf_dir).withColumn("_s", F.concat(F.lit("https://src"), (F.col("qid") % 20).cast("string"), F.lit(".example.com")))
    first = c.groupBy(F.col("source_url").alias("_s")).agg(F.min_by(F.struct(*c.columns), "id").alias("c"))
    ranked = asked.join(first, "_s").select("qid", "question", "c.*", F.lit(1).alias("rank"), F.lit(0.1).alias("score"))
    return answers.expand_primary(ranked, c)


@query("site_results", "SELECT n_nationkey AS folder, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS captions, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS ocr_pages FROM nation")
def site_results(spark, sf_dir):
    """Nations as scraped sites."""
    items = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder"), F.col("n_name").alias("name"))
    return readers.site_results(items, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("folder")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder")))
