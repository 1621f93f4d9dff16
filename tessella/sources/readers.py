"""Sources. Schemas are given, never inferred; a missing path is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import IMAGE_EXTENSIONS

PAGE_META = "source_url string, title string, fetched_at string"
OUTLINE = "order int, title string"
OCR_ROWS = "type string, source_pdf string, pdf_sha1 string, page int, extract_method string, text string, image_path string, image_ocr string, caption_hint string"
IMAGE_DOWNLOADS = "type string, page_url string, page_title string, source_url string, saved_path string, sha1 string, alt_text string, title_text string, nearby_text string, width int, height int, created_at string"
IMAGE_UNDERSTANDING = "type string, image_path string, sha1 string, caption_en string, caption_th string, image_type string, relevance_score double, keep_for_rag boolean, caption_status string, caption_error string, is_duplicate boolean, duplicate_of_sha1 string, model string, translator string, page_url string, source_url string"
EVAL_ROWS = "question string, relevant_chunks array<string>, answer_patterns array<string>"


def _or_empty(spark: SparkSession, schema: str | T.StructType, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3, A9. Lines that don't parse are skipped."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S4, S25. A file of one object or an array; another root gives no rows."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """S5. (path, text), one row a file."""
    schema = "path string, text string"
    return _or_empty(spark, schema, lambda: spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def site_folders(spark: SparkSession, root: str) -> DataFrame:
    """S6. (folder, path, text) of the content files in folders whose names start with a digit and hold an underscore."""
    found = whole_texts(spark, f"{root}/[0-9]*_*/content.txt")
    return found.withColumn("folder", F.element_at(F.split("path", "/"), -2)).orderBy("folder")


def ocr_results(spark: SparkSession, root: str) -> DataFrame:
    """S7, S13. Page and figure rows of all result files, with the file."""
    rows = _or_empty(spark, OCR_ROWS + ", file string", lambda: spark.read.schema(OCR_ROWS).option("mode", "DROPMALFORMED").json(f"{root}/ocr_results/*/docs.jsonl").withColumn("file", F.col("_metadata.file_path")))
    return rows


def files(spark: SparkSession, root: str, extensions: tuple[str, ...], recursive: bool = True, content: bool = False) -> DataFrame:
    """S8, S9, S10, S11. Files below a folder by extension, whatever its case, in order of path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    found = _or_empty(spark, "path string, modificationTime timestamp, length long, content binary", lambda: read.load(root))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    out = found.where(ext.isin(*extensions))
    return (out if content else out.drop("content")).orderBy("path")


def pack(rows: DataFrame, path: str) -> None:
    """Many small files as one table: (path, content binary), dealt to as many tasks as a shuffle has.

    A file each would cost a listing, an open and a commit, most of them on the driver.
    """
    rows.select("path", F.col("content").cast("binary").alias("content")).repartition("path").write.mode("append").parquet(path)


def packed(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files that ``pack`` has written."""
    return _or_empty(spark, "path string, content binary", lambda: spark.read.schema("path string, content binary").parquet(path))


def pdf_files(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    return files(spark, root, (".pdf",), recursive, content)


def image_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    return files(spark, root, IMAGE_EXTENSIONS, True, content)


def data_uri_images(df: DataFrame, url: str = "img_url") -> DataFrame:
    """S23. Content, hash and media type of data: images."""
    body = F.unbase64(F.regexp_extract(url, r"^data:[^,]*;base64,(.*)$", 1))
    return df.where(F.col(url).startswith("data:")).withColumns({"content_type": F.regexp_extract(url, r"^data:([^;,]*)", 1), "content": body, "sha1": F.sha1(body)})


def pdf_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """S12, U5. Text layer of a page, or the longer of its two OCR texts where the layer is shorter than ``least``.

    Rows of (path, page, layer, ocr_a, ocr_b); extraction itself is a model hook.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    a, b = clean("ocr_a"), clean("ocr_b")
    ocr = F.when((F.length(a) < least) & (F.length(b) > F.length(a)), b).otherwise(a)
    method = F.when(F.length(clean("layer")) >= least, "text_layer").when(ocr != "", "ocr").otherwise("none")
    return pages.withColumns({"text": F.when(method == "text_layer", clean("layer")).otherwise(ocr), "extract_method": method})


def pdf_text(pages: DataFrame, most: int | None = None, longest: int | None = None) -> DataFrame:
    """S16, F44. Pages of a file joined by a blank line, empty ones left out; the first pages and characters if limits are given."""
    rows = pages.where(F.trim("text") != "")
    if most is not None:
        rows = rows.where(F.col("page") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    out = rows.groupBy("path").agg(joined.alias("text"), F.count("*").alias("pages"))
    return out if longest is None else out.withColumn("text", F.substring("text", 1, longest))


def page_figures(df: DataFrame, least: int = 10_000, most: int = 10) -> DataFrame:
    """S15, P17. Images of ten kB and more, the first ten of a page; rows of (path, page, image, length)."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "page").orderBy("image")
    return df.where(F.col("length") >= least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def search_targets(df: DataFrame, limit: int) -> DataFrame:
    """S17, D9, W14. Search results outside the search host, each page once, ranked."""
    from pyspark.sql import Window

    from ..operators.cleaning import dedupe_urls

    outside = df.where(~F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).contains("google."))
    return dedupe_urls(outside).orderBy("ord").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("ord")))


def extract_pages(files: DataFrame, extract, schema: str = "page int, layer string, ocr_a string, ocr_b string", name: str = "pages") -> DataFrame:
    """S12, S13, S14, G16, T-6. Pages of binary files through an extractor hook: content in, list of page tuples out.

    A file that fails gives one row without text. The counts are observed under ``name`` while the query runs.
    """
    import pandas as pd

    fields = [f.split()[0] for f in schema.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    found = extract(bytes(content))
                except Exception:  # noqa: BLE001
                    found = [(0, *[None] * (len(fields) - 1))]
                rows += [(path, *r) for r in found]
            yield pd.DataFrame(rows, columns=["path", *fields])

    out = files.select("path", "content").mapInPandas(run, "path string, " + schema)
    return out.observe(name, F.count("*").alias("pages"), F.count_if(F.col("page") == 0).alias("failed"))


def site_results(items: DataFrame, captions: DataFrame, ocr: DataFrame) -> DataFrame:
    """J13. Scraped items with the captions and OCR pages of their folder; a folder without them counts 0."""
    c = captions.groupBy("folder").agg(F.count("*").alias("captions"))
    o = ocr.groupBy("folder").agg(F.count("*").alias("ocr_pages"))
    return items.join(c, "folder", "left").join(o, "folder", "left").na.fill(0, ["captions", "ocr_pages"])
