"""Queries over folders as a scraper leaves them, written from the tables with some of each kind broken, and over resumable stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import hash_embedding
from ..operators import cleaning, store, summaries, vision
from ..sources import readers, sinks
from ..sources.readers import table
from ..tables import scratch
from .ingestion import ingest_folder, read_folder
from .pipelines import ingest_texts
from .registry import query
from .stages import Stage, Stages

#: Where ``scraped`` puts the files: those of one document each are packed, as there are as many as suppliers.
PLACES = {"content": "content.parquet", "meta": "meta.parquet", "outline": "outline.parquet", "images": "images", "ocr": "ocr_results/*"}


def scraped(spark, sf_dir: str) -> str:
    """Suppliers as site folders, parts as captioned images, customers as OCR rows."""
    root = scratch(spark)
    k, name = F.col("s_suppkey"), F.col("s_name")
    s = table(spark, sf_dir, "supplier")
    several = F.concat(
        F.lit("Home News\nAn introduction of "), name, F.lit(" for those who ask.\n1. Balance of "), name, F.lit("\nIt stands at "), F.col("s_acctbal").cast("decimal(20,2)").cast("string"), F.lit(" in all, as of now.\n2. Place of "), name, F.lit("\nIt is found in nation "), F.col("s_nationkey").cast("string"), F.lit(", and nowhere else."),
    )
    content = F.when(k % 5 == 0, F.concat(F.lit("Only "), name, F.lit(" is here, without any sections."))).otherwise(several)
    stray = F.concat(content.cast("binary"), F.unhex(F.lit("FF")))

    def put(rows, name, value):
        path = F.concat(F.lit(f"{root}/{name}/k="), k.cast("string"), F.lit(f"/{name}"))
        readers.pack(rows.select(path.alias("path"), value.cast("binary").alias("content")), f"{root}/{name}.parquet")

    put(s, "content", F.when(k % 20 == 0, stray).otherwise(content.cast("binary")))
    meta = F.to_json(F.struct(F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com")).alias("source_url"), F.concat(F.lit("About "), name).alias("title")))
    put(s, "meta", F.when(k % 10 == 0, F.substring(meta, 1, 20)).otherwise(meta))
    outline = F.concat(F.lit('[{"order": 1, "title": "- First of '), name, F.lit('"}, {"order": "2", "title": "Second"}, {"order": 0, "title": "none"}]'))
    put(s.where(k % 2 == 0), "outline", F.when(k % 25 == 0, F.substring(outline, 1, 30)).otherwise(outline))

    p = F.col("p_partkey")
    image = F.to_json(
        F.struct(
            F.lit("image_understanding").alias("type"), F.concat(F.lit("/img/"), p.cast("string")).alias("image_path"), F.col("p_name").alias("caption_en"), F.lit("photo").alias("image_type"), F.lit(0.5).alias("relevance_score"), (p % 2 == 0).alias("keep_for_rag"), (p % 7 == 0).alias("is_duplicate")
        )
    )
    table(spark, sf_dir, "part").select(F.when(p % 50 == 0, F.substring(image, 1, 40)).otherwise(image).alias("value")).write.text(f"{root}/images")

    c = F.col("c_custkey")
    page = F.to_json(F.struct(F.lit("page_text").alias("type"), F.concat(F.lit("/pdf/"), (c % 10).cast("string")).alias("source_pdf"), c.alias("page"), F.concat(F.lit("Customer "), "c_name", F.lit(" of segment "), "c_mktsegment", F.lit(" is on this page.")).alias("text")))
    figure = F.to_json(F.struct(F.lit("figure").alias("type"), F.concat(F.lit("/fig/"), c.cast("string")).alias("image_path"), c.alias("page"), F.when(c % 2 == 0, F.concat(F.lit("A figure of what the customer "), "c_name", F.lit(" has"))).otherwise(" short ").alias("image_ocr")))
    row = F.when(c % 3 == 0, figure).otherwise(page)
    table(spark, sf_dir, "customer").select(F.when(c % 50 == 0, F.substring(row, 1, 25)).otherwise(row).alias("value")).write.text(f"{root}/ocr_results/one")
    return root


SECTIONS = """s AS (SELECT s_suppkey AS k, s_name AS n, s_suppkey % 5 <> 0 AS several, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'https://s' || s_suppkey || '.example.com' END AS url,
      CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'About ' || s_name END AS title, s_acctbal::DECIMAL(20, 2)::VARCHAR AS b, s_nationkey AS c FROM supplier)"""


@query(
    "site_folder_chunks",
    f"""WITH {SECTIONS}
    SELECT 'web_page' AS source_type, url AS source_url, k::VARCHAR AS place, 0 AS page, text FROM (
      SELECT k, url, unnest(CASE WHEN several THEN ['An introduction of ' || n || ' for those who ask.', '1. Balance of ' || n || 'It stands at ' || b || ' in all, as of now.', '2. Place of ' || n || 'It is found in nation ' || c || ', and nowhere else.']
        ELSE ['Only ' || n || ' is here, without any sections.'] END) AS text FROM s)
    UNION ALL SELECT 'web_image_caption', '', '/img/' || p_partkey, 0, 'caption_th: caption_en: ' || p_name || 'image_type: photorelevance_score: 0.5' FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 7 <> 0
    UNION ALL SELECT 'pdf_page', '', '/pdf/' || c_custkey % 10, c_custkey::INT, 'Customer ' || c_name || ' of segment ' || c_mktsegment || ' is on this page.' FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 3 <> 0
    UNION ALL SELECT 'pdf_figure_ocr', '', '/fig/' || c_custkey, c_custkey::INT, 'A figure of what the customer ' || c_name || ' has' FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 3 = 0 AND c_custkey % 2 = 0""",
)
def site_folder_chunks(spark, sf_dir):
    """Pages, captions and OCR results of folders, those that can be read."""
    found = read_folder(spark, scraped(spark, sf_dir), "external", PLACES)
    chunks = ingest_texts(found.texts, hash_embedding(8), 8)
    place = F.when(F.col("source_type") == "web_page", F.regexp_extract("source_path", "/k=([0-9]+)/", 1)).otherwise(F.col("source_path"))
    return chunks.select("source_type", "source_url", place.alias("place"), "page", "text")


@query(
    "site_folder_facts",
    f"""WITH {SECTIONS}, f AS (SELECT k, CASE WHEN title = '' THEN NULL ELSE title END AS entity, unnest(CASE WHEN k % 2 = 0 AND k % 25 <> 0 THEN [{{'y': 1, 't': 'First of ' || n}}, {{'y': 2, 't': 'Second'}}]
      ELSE [{{'y': 1, 't': 'Balance of ' || n}}, {{'y': 2, 't': 'Place of ' || n}}] END) AS x FROM s WHERE several)
    SELECT k::VARCHAR AS place, entity, 'numbered_section_title' AS key, x.t AS value, x.y AS year FROM f""",
)
def site_folder_facts(spark, sf_dir):
    """Titles of outlines, or of the sections where there is none that can be read."""
    facts = read_folder(spark, scraped(spark, sf_dir), "external", PLACES).facts
    named = F.when(F.col("entity").startswith("About "), F.col("entity"))  # others have the name of the file
    return facts.select(F.regexp_extract("source_path", "/k=([0-9]+)/", 1).alias("place"), named.alias("entity"), "key", "value", "year")


@query(
    "site_folder_errors",
    """SELECT 'content' AS kind, 'not UTF-8' AS problem, s_suppkey::VARCHAR AS place, NULL AS record FROM supplier WHERE s_suppkey % 20 = 0
    UNION ALL SELECT 'meta', 'no document of the schema', s_suppkey::VARCHAR, left('{"source_url":"https://s' || s_suppkey, 20) FROM supplier WHERE s_suppkey % 10 = 0
    UNION ALL SELECT 'outline', 'no document of the schema', s_suppkey::VARCHAR, '[{"order": 1, "title": "- First' FROM supplier WHERE s_suppkey % 50 = 0
    UNION ALL SELECT 'images', 'no object of the schema', '', left('{"type":"image_understanding","image_path":"/img/' || p_partkey, 40) FROM part WHERE p_partkey % 50 = 0
    UNION ALL SELECT 'ocr', 'no object of the schema', '', left(CASE WHEN c_custkey % 3 = 0 THEN '{"type":"figure","image_path":"/fig/' ELSE '{"type":"page_text","source_pdf":"/pdf/' END, 25) FROM customer WHERE c_custkey % 50 = 0""".replace("'[{\"order\": 1, \"title\": \"- First'", "left('[{\"order\": 1, \"title\": \"- First of ', 30)"),
)
def site_folder_errors(spark, sf_dir):
    """What can't be read, each file and row for itself."""
    errors = read_folder(spark, scraped(spark, sf_dir), "external", PLACES).errors
    return errors.select("kind", "problem", F.regexp_extract("file", "/k=([0-9]+)/", 1).alias("place"), "record")


@query(
    "external_pipeline",
    """SELECT * FROM (SELECT 'scrape' AS stage, count(DISTINCT split_part(url, '#', 1)) AS rows FROM pages UNION ALL SELECT 'caption', count(*) FROM part UNION ALL SELECT 'ocr', count(*) FROM documents WHERE trim(text) <> '')
    UNION ALL SELECT 'summary', 2 UNION ALL SELECT 'source ingest', (SELECT count(*) FROM part WHERE p_partkey % 3 > 0)""",
)
def external_pipeline(spark, sf_dir):
    """C15, T-4, K8: scrape, captions, OCR, ingestion and summary as stages that resume."""
    run = Stages(spark, scratch(spark), "external")
    tables = run.run(external_stages(), external_sources(spark, sf_dir))
    rows = run.events().where("message = 'done'").select("stage", F.col("extra"))
    counts = rows.select("stage", F.element_at(F.map_values("extra"), 1).cast("long").alias("rows"))
    return counts.where("stage <> 'done'") if tables else counts


def external_sources(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    images = t("part").select(F.concat(F.lit("/img/"), F.col("p_partkey").cast("string")).alias("path"), F.sha1(F.col("p_partkey").cast("string")).alias("sha1"), F.when(F.col("p_partkey") % 3 > 0, F.concat_ws(" ", F.lit("a chart of what is"), "p_name", F.lit("with its figures"))).otherwise("").alias("caption_en"), F.col("p_name").alias("page_context"))
    return {"pages": t("pages"), "images": images, "files": t("documents").select(F.col("source").alias("path"), F.col("doc_id").alias("page"), "text")}


def external_stages() -> list[Stage]:
    """POST /pipeline/external: each stage a table of the ones before it."""

    def scrape(pages):
        return cleaning.dedupe_urls(pages.withColumn("ord", F.col("page_id"))).drop("ord")

    def ocr(files):
        return files.where(F.trim("text") != "").withColumn("extract_method", F.lit("text_layer"))

    def ingest(images):
        kept = images.where("caption_en <> ''").select(F.lit("external").alias("namespace"), F.lit("web_image_caption").alias("source_type"), F.col("path").alias("source_path"), F.lit(0).alias("page"), F.col("caption_en").alias("text"))
        return ingest_texts(kept, hash_embedding(8), 8)

    def summary(items, pages):
        found = summaries.ocr_summary(pages.select(F.col("path").alias("file"), F.lit("page_text").alias("type"), "extract_method")).select(F.lit("ocr").alias("what"), F.col("ocr_pages").alias("n"))
        return items.agg(F.count("*").alias("n")).select(F.lit("pages").alias("what"), "n").unionByName(found)

    return [
        Stage("scrape", ("pages",), scrape),
        Stage("caption", ("images",), vision.understand),
        Stage("ocr", ("files",), ocr),
        Stage("source ingest", ("images",), ingest),
        Stage("summary", ("scrape", "ocr"), summary),
    ]
