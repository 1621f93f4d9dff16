"""Folders that a scraper has left, to chunks, facts and a table of what could not be read.

A site folder holds content.txt, page_meta.json, outline.json and
images_understanding.jsonl; beside the site folders stand the OCR results. All files of a
kind are one scan, told apart by their paths, and the kinds meet by folder, so one
plan ingests any number of folders. A file or row that can't be read costs itself
alone: it is a row of ``errors``, and the rest goes on. Files of one document each may
also be packed, as rows (path, content) of a Parquet table (``readers.pack``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, text
from ..models import Embed, Generate
from ..operators import chunking, cleaning, store, vision
from ..sources import readers
from .pipelines import ingest_facts, ingest_texts

#: Where each kind of file stands below a main folder.
PLACES = {
    "content": "[0-9]*_*/content.txt",
    "meta": "[0-9]*_*/page_meta.json",
    "outline": "[0-9]*_*/outline.json",
    "images": "[0-9]*_*/images_understanding.jsonl",
    "ocr": "ocr_results/*/docs.jsonl",
}
#: Fewest letters of a figure's text.
FIGURE_LETTERS = 10
#: Items of an outline as JSON each, so that an odd one costs itself alone.
OUTLINE_ROWS = "array<string>"
#: The scan's own columns, which a row of a file can't clash with.
FILE, BROKEN = "_file", "_broken"
ERRORS = "kind string, file string, problem string, record string"


@dataclass
class Folder:
    """What a main folder holds: texts with their places, facts of outlines and numbered sections, errors, and figures without text."""

    texts: DataFrame
    facts: DataFrame
    errors: DataFrame
    skipped: DataFrame


@dataclass
class _Errors:
    spark: SparkSession
    parts: list[DataFrame] = field(default_factory=list)

    def add(self, rows: DataFrame, kind: str, problem: Column | str, record: Column) -> None:
        p = F.lit(problem) if isinstance(problem, str) else problem
        self.parts.append(rows.select(F.lit(kind).alias("kind"), F.col(FILE).alias("file"), p.alias("problem"), record.cast("string").alias("record")))

    def all(self) -> DataFrame:
        out = self.spark.createDataFrame([], ERRORS)
        for p in self.parts:
            out = out.unionByName(p)
        return out


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(_file, content) of the files of a pattern, none if there are none; a pattern that ends in ``.parquet`` names packed files."""
    if path.endswith(".parquet"):
        return readers.packed(spark, path).select(F.col("path").alias(FILE), "content")
    try:
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias(FILE), "content")
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], f"{FILE} string, content binary")


def file_texts(spark: SparkSession, path: str, kind: str, errors: _Errors) -> DataFrame:
    """(_file, text): bytes that are no UTF-8 are left out, and told."""
    raw = file_bytes(spark, path)
    whole = F.col("content").cast("string")
    errors.add(raw.where(~F.is_valid_utf8(whole)), kind, "not UTF-8", F.lit(None))
    return raw.select(FILE, F.when(F.is_valid_utf8(whole), whole).otherwise(F.replace(F.make_valid_utf8(whole), F.lit("�"), F.lit(""))).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, kind: str, errors: _Errors) -> DataFrame:
    """Rows of the files' lines and _file; a line that is no object of the schema is an error."""
    try:
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(FILE)).where(strip("value") != "")
    except AnalysisException as e:
        if not _missing(e):
            raise
        raw = spark.createDataFrame([], f"value string, {FILE} string")
    parsed = raw.select("value", FILE, F.from_json("value", f"{schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull() | ~F.ltrim("value").startswith("{")
    errors.add(parsed.where(bad), kind, "no object of the schema", F.col("value"))
    return parsed.where(~bad).select(FILE, "r.*").drop(BROKEN)


def json_documents(spark: SparkSession, path: str, schema: str, kind: str, errors: _Errors) -> DataFrame:
    """(_file, r) of files that hold one document of the schema each; others are errors."""
    opening = "[" if schema.startswith("array") else "{"
    raw = file_texts(spark, path, kind, errors)
    parsed = raw.withColumn("r", F.from_json("text", schema, {"mode": "PERMISSIVE"}))
    # A cut-off document parses to what stood before the cut; try_parse_json takes whole documents alone.
    good = F.col("r").isNotNull() & F.ltrim("text").startswith(opening) & F.expr("try_parse_json(text)").isNotNull()
    good = F.coalesce(good, F.lit(False))
    errors.add(parsed.where(~good), kind, "no document of the schema", F.col("text"))
    return parsed.where(good).select(FILE, "r")


def _folder(file: str = FILE) -> Column:
    return F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)


def read_folder(spark: SparkSession, root: str, namespace: str, places: dict[str, str] | None = None) -> Folder:
    """C11, S6, S7, P16, P17, P21, G8, G10, G11. The texts and facts of a main folder, by the places of its files.

    A page whose text has several numbered sections is a text for each, and has facts
    from its outline, or else from the titles of its sections. Captions that are kept
    are texts, pages and figures of OCR results too; a figure of fewer than
    FIGURE_LETTERS is skipped. Null or missing parts are empty; a folder without
    content.txt has no page; several rows of one page are several texts.
    """
    at = {k: f"{root}/{v}" for k, v in (PLACES | (places or {})).items()}
    errors = _Errors(spark)
    empty = F.lit("")
    content = file_texts(spark, at["content"], "content", errors).withColumn("folder", _folder())
    meta = json_documents(spark, at["meta"], f"struct<{readers.PAGE_META.replace(' string', ':string').replace(' ', '')}>", "meta", errors)
    meta = meta.groupBy(_folder().alias("folder")).agg(F.first("r").alias("m"))
    outline = json_documents(spark, at["outline"], OUTLINE_ROWS, "outline", errors)
    outline = outline.groupBy(_folder().alias("folder")).agg(F.first("r").alias("o"))

    pages = content.join(meta, "folder", "left").join(outline, "folder", "left")
    pages = pages.select(
        F.lit(namespace).alias("namespace"), F.lit("web_page").alias("source_type"), strip(text(F.col("m.source_url"))).alias("source_url"), F.col(FILE).alias("source_path"), F.lit(0).alias("page"),
        strip(text(F.col("m.title"))).alias("title"), "o", cleaning.clean_web_text("text").alias("text"),
    )
    pages = pages.withColumn("sections", chunking.numbered_sections("text"))
    several = F.size("sections") > 1
    keep = ("namespace", "source_type", "source_url", "source_path", "page")
    web = pages.select(*keep, F.explode(F.when(several, F.col("sections")).otherwise(F.array("text"))).alias("text"))

    captions = vision.for_ingest(json_lines(spark, at["images"], readers.IMAGE_UNDERSTANDING, "images", errors))
    line = lambda label, c: F.concat(F.lit(label), c)
    caption = F.concat_ws(
        "\n", line("caption_th: ", strip(text("caption_th"))), line("caption_en: ", strip(text("caption_en"))), line("image_type: ", strip(F.coalesce(F.nullif("image_type", empty), F.lit("other")))), line("relevance_score: ", F.coalesce("relevance_score", F.lit(0.0)).cast("string"))
    )
    images = captions.select(F.lit(namespace).alias("namespace"), F.lit("web_image_caption").alias("source_type"), empty.alias("source_url"), text("image_path").alias("source_path"), F.lit(0).alias("page"), caption.alias("text"))

    ocr = json_lines(spark, at["ocr"], readers.OCR_ROWS, "ocr", errors)
    page = F.coalesce("page", F.lit(0)).alias("page")
    read = ocr.where("type = 'page_text'").select(F.lit(namespace).alias("namespace"), F.lit("pdf_page").alias("source_type"), empty.alias("source_url"), text("source_pdf").alias("source_path"), page, text("text").alias("text"))
    figures = ocr.where("type = 'figure'").withColumn("_t", strip(text("image_ocr")))
    shown = figures.where(F.length("_t") >= FIGURE_LETTERS).select(F.lit(namespace).alias("namespace"), F.lit("pdf_figure_ocr").alias("source_type"), empty.alias("source_url"), text("image_path").alias("source_path"), page, F.col("_t").alias("text"))
    texts = web.unionByName(images).unionByName(read).unionByName(shown)
    return Folder(texts, _facts(pages.where(several)), errors.all(), figures.where(F.length("_t") < FIGURE_LETTERS).select("image_path", page))


def _facts(pages: DataFrame) -> DataFrame:
    """G10. Titles of the outline, or where none is fit those of the sections."""
    basename = F.element_at(F.split("source_path", "/"), -1)
    entity = F.coalesce(F.nullif("title", F.lit("")), basename)
    fit = lambda o, t: (o > 0) & (t != "") & (F.length(t) <= 180)
    from_outline = F.filter(
        F.transform(F.coalesce("o", F.array().cast(OUTLINE_ROWS)), lambda x: F.struct(F.coalesce(F.get_json_object(x, "$.order").try_cast("int"), F.lit(0)).alias("year"), F.regexp_replace(text(F.get_json_object(x, "$.title")), r"^[ \-:\t]+|[ \-:\t]+$", "").alias("value"))),
        lambda x: fit(x["year"], x["value"]),
    )
    from_sections = F.filter(F.transform("sections", lambda s: F.struct(F.coalesce(chunking.section_order(s), F.lit(0)).alias("year"), text(chunking.section_title(s)).alias("value"))), lambda x: fit(x["year"], x["value"]))
    rows = pages.select("namespace", "source_type", "source_path", "page", entity.alias("entity"), F.posexplode(F.when(F.size(from_outline) > 0, from_outline).otherwise(from_sections)).alias("_p", "f"))
    rows = rows.select("namespace", "source_type", "source_path", "page", "entity", F.lit("numbered_section_title").alias("key"), "_p", F.col("f.value").alias("value"), F.lit("").alias("unit"), F.col("f.year").alias("year"), F.col("f.value").alias("evidence_text"))
    first = cleaning.keep_first(rows, ["namespace", "source_path", "year", "value"], ["_p"]).drop("_p")
    return store.with_defaults(first, store.FACTS).withColumn("id", store.fact_id())


def ingest_folder(spark: SparkSession, root: str, namespace: str, embed: Embed, into: store.Store, extract: Generate | None = None, places: dict[str, str] | None = None, dims: int = 32) -> DataFrame:
    """C11, C12, A12. A main folder into a store: its chunks, the facts of its outlines and, with an extractor, of its chunks.

    One row: added_chunks, added_facts, skipped figures, errors. What can't be read is
    counted and told by ``read_folder``; it stops nothing else.
    """
    found = read_folder(spark, root, namespace, places)
    chunks = ingest_texts(found.texts, embed, dims)
    into.upsert_chunks(chunks)
    into.upsert_facts(found.facts)
    added = found.facts.select("id")
    if extract is not None:
        told = ingest_facts(into.chunks().where(F.col("namespace") == namespace), extract)
        into.upsert_facts(told)
        added = added.unionByName(told.select("id"))
    counts = [("added_chunks", chunks.select("id")), ("added_facts", added), ("skipped", found.skipped), ("errors", found.errors)]
    rows = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().pivot("name", [n for n, _ in counts]).agg(F.first("n"))
