"""The two stored tables: ids, upsert, summaries of documents.

Tables are Parquet, partitioned by namespace and by a bucket of the id's hash. An
upsert reads and writes only the buckets that the new rows touch. A large one goes
over them in passes; if it breaks off, some buckets have the new rows and some the
old ones, and it can be run again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text
from ..tables import delete, settings

#: Buckets of a namespace. A store keeps the number it was made with.
BUCKETS = 64
#: Tasks that share a bucket of a namespace, a file each.
BUCKET_PARTS = 4
#: Bytes of new rows, as letters of their strings and so many a row, of a pass of an upsert, in whole buckets. Only the rows of one pass are shuffled at a time.
PASS_BYTES, ROW_BYTES = 5 << 30, 64
#: Files that a task of an upsert has open at once; where it has rows for more folders, it sorts them first.
OPEN_FILES = 32
CHUNKS = (
    "id string, namespace string, source_type string, source_url string, source_path string, page int, chunk_index int, chunk_total int, text string, embedding array<float>, score_hint double"
)
FACTS = (
    "id string, namespace string, entity string, key string, value string, unit string, year int, source_type string, source_path string, page int, evidence_text string"
)


def chunk_id() -> Column:
    """K3, T-7. Hash of a chunk's place and text: the same chunk has the same id in every run."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return F.sha1(F.concat_ws("|", text("namespace"), text("source_type"), text("source_url"), text("source_path"), number("page"), number("chunk_index"), text("text")))


def fact_id() -> Column:
    """K4. Hash of a fact without its unit."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return F.sha1(F.concat_ws("|", text("namespace"), text("entity"), text("key"), text("value"), number("year"), text("source_path"), number("page")))


def with_defaults(df: DataFrame, schema: str) -> DataFrame:
    """F51. Missing columns and nulls take the defaults of the stored table; an index of 0 counts as 1."""
    out = {}
    for f in T.StructType.fromDDL(schema).fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif f.name in ("chunk_index", "chunk_total"):
            c = F.coalesce(F.nullif(c.cast("int"), F.lit(0)), F.lit(1))
        elif isinstance(f.dataType, T.IntegerType):
            c = F.coalesce(c.cast("int"), F.lit(0))
        elif isinstance(f.dataType, T.DoubleType):
            c = F.coalesce(c.cast("double"), F.lit(0.0))
        else:
            c = c.cast(f.dataType)
        out[f.name] = c
    return df.select(*[c.alias(n) for n, c in out.items()])


def zero_vector_fallback(df: DataFrame, dims: int) -> DataFrame:
    """U3. A chunk without a vector takes zeros and a negative score_hint, which keeps it out of vector search."""
    if "score_hint" not in df.columns:
        df = df.withColumn("score_hint", F.lit(0.0))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return df.withColumns({"score_hint": F.when(F.col("embedding").isNull(), -1.0).otherwise(F.coalesce("score_hint", F.lit(0.0))), "embedding": F.coalesce("embedding", zero)})


def merge_by_id(existing: DataFrame, new: DataFrame, ident: str = "id") -> DataFrame:
    """K1, K2, J8. New rows replace stored ones of the same id; of several new ones the least by value, column by column, stays."""
    row = F.struct(*new.columns)
    first = new.groupBy(F.col(ident).alias("_id")).agg(F.min(row).alias("_row")).select("_row.*")
    return existing.join(first.select(ident), ident, "left_anti").unionByName(first)


def _part(ident: Column) -> Column:
    """The task of a bucket's tasks that has a row."""
    return F.pmod(F.xxhash64(ident, F.lit(1)), F.lit(BUCKET_PARTS)).cast("int")


def in_passes(touched: list[tuple[str, int, int]]) -> list[dict[str, list[int]]]:
    """Passes over (namespace, bucket, bytes): the buckets of each namespace, a bucket's number in one pass, PASS_BYTES or one number in each."""
    size: dict[int, int] = {}
    spaces: dict[int, list[str]] = {}
    for namespace, bucket, n in touched:
        size[bucket] = size.get(bucket, 0) + n
        spaces.setdefault(bucket, []).append(namespace)
    out: list[dict[str, list[int]]] = []
    held = 0
    for bucket in sorted(size):
        if not out or held + size[bucket] > PASS_BYTES:
            out.append({})
            held = 0
        held += size[bucket]
        for namespace in spaces[bucket]:
            out[-1].setdefault(namespace, []).append(bucket)
    return out


class Store:
    """K1, K2, K5. Chunks and facts below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def init(self) -> None:
        for name, schema in (("chunks", CHUNKS), ("facts", FACTS)):
            self._empty(schema).write.mode("append").partitionBy("namespace", "bucket").parquet(f"{self.path}/{name}")

    def reset(self) -> None:
        for name, schema in (("chunks", CHUNKS), ("facts", FACTS)):
            self._empty(schema).write.mode("overwrite").partitionBy("namespace", "bucket").parquet(f"{self.path}/{name}")

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], f"{schema}, bucket int")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}").select(*T.StructType.fromDDL(schema).names)

    def chunks(self) -> DataFrame:
        """S1."""
        return self._read("chunks", CHUNKS)

    def facts(self) -> DataFrame:
        """S2."""
        return self._read("facts", FACTS)

    def _upsert(self, name: str, new: DataFrame, ident: Column) -> None:
        new = new.drop("id").withColumns({"bucket": F.pmod(F.xxhash64(ident), F.lit(BUCKETS)).cast("int"), "_part": _part(ident)})
        letters = [F.octet_length(f.name) for f in new.schema if isinstance(f.dataType, T.StringType)]
        # At most BUCKETS rows a namespace.
        touched = [tuple(r) for r in new.groupBy("namespace", "bucket").agg(F.sum(reduce(Column.__add__, letters, F.lit(ROW_BYTES))).alias("n")).collect()]
        passes = in_passes(touched)
        if len(passes) < 2:
            for spaces in passes:
                self._merge(name, new, ident, spaces)
            return
        # The new rows by pass, in columns and without their ids; a folder goes as soon as it is merged.
        at = {b: i for i, spaces in enumerate(passes) for buckets in spaces.values() for b in buckets}
        number = F.array(*[F.lit(at.get(b, 0)) for b in range(BUCKETS)])[F.col("bucket")]
        waiting = f"{self.path}/_{name}-{uuid.uuid4().hex}"
        try:
            # A small open file for each pass, so that tasks needn't sort their rows first.
            with settings(new.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": len(passes)}):
                out = new.withColumn("pass", number).write.option("compression", "zstd").option("parquet.block.size", 8 << 20)
                out.partitionBy("pass").parquet(waiting)
            for i, spaces in enumerate(passes):
                self._merge(name, self.spark.read.schema(new.schema).parquet(f"{waiting}/pass={i}"), ident, spaces)
                delete(self.spark, f"{waiting}/pass={i}")
        finally:
            delete(self.spark, waiting)

    def _merge(self, name: str, new: DataFrame, ident: Column, spaces: dict[str, list[int]]) -> None:
        """New rows into these buckets of each namespace, which hold all of them."""
        schema = CHUNKS if name == "chunks" else FACTS
        columns = T.StructType.fromDDL(schema).names
        # Literals, so that other partitions aren't read.
        meets = reduce(lambda a, b: a | b, [(F.col("namespace") == n) & F.col("bucket").isin(b) for n, b in spaces.items()])
        stored = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}").where(meets)
        # One shuffle of both, parted as the folders are. Ids are made behind it, as hashes don't compress; only one that isn't its row's hash is sent.
        keys = ["namespace", "bucket", "_part"]
        old = stored.select(*columns, "bucket", _part(F.col("id")).alias("_part"), F.lit(True).alias("_old")).withColumn("id", F.when(F.col("id") != ident, F.col("id")))
        rows = old.unionByName(new.withColumns({"id": F.lit(None).cast("string"), "_old": F.lit(False)}))
        rows = rows.repartition(*keys).withColumn("id", F.coalesce("id", ident))
        # The least new row of an id, or the stored one; grouped in place, without another shuffle, and sorted by what tells rows apart first.
        rest = [c for c in columns if c not in ("id", "namespace")]
        merged = rows.groupBy("id", *keys).agg(F.min(F.struct("_old", *rest)).alias("_r")).select("id", "namespace", *[F.col(f"_r.{c}").alias(c) for c in rest], "bucket")
        # Folders are replaced when all tasks are done, so what is read stays until then. Shuffled rows go with the write, not when memory runs short.
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": True, "spark.sql.maxConcurrentOutputFileWriters": OPEN_FILES}):
            out = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            out.partitionBy("namespace", "bucket").parquet(f"{self.path}/{name}")

    def upsert_chunks(self, new: DataFrame) -> None:
        self._upsert("chunks", with_defaults(new, CHUNKS), chunk_id())

    def upsert_facts(self, new: DataFrame) -> None:
        self._upsert("facts", with_defaults(new, FACTS), fact_id())


def display_name(path: Column, kind: Column) -> Column:
    """P27. Last part of a path; the folder of content.txt and outline.json; else the type."""
    parts = F.split(F.regexp_replace(text(path), r"[\\/]+$", ""), "/")
    base = F.element_at(parts, -1)
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    named = F.when(F.lower(base).isin("content.txt", "outline.json") & (parent != ""), parent).otherwise(base)
    return F.when(text(path) == "", F.when(text(kind) == "", "unknown").otherwise(text(kind))).otherwise(named)


def type_label(kind: Column) -> Column:
    """P26."""
    k = F.trim(F.lower(text(kind)))
    return F.when(k.contains("internal_pdf"), "INTERNAL_PDF").when(k.contains("web"), "WEB_INGEST").when(k != "", F.upper(k)).otherwise("UNKNOWN")


def documents_summary(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """A1, J4, O13, F47. Chunks, facts and distinct pages of each document; documents may have only one of the two."""
    keys = ["namespace", "source_path", "source_type"]
    fold = lambda df: [text(k).alias(k) for k in keys]
    updated = F.max("updated_at") if "updated_at" in chunks.columns else F.lit("")
    c = chunks.withColumn("_page", F.when(F.col("page") > 0, F.col("page"))).groupBy(*fold(chunks)).agg(
        F.count("*").alias("chunk_count"), F.count_distinct("_page").alias("page_count"), F.coalesce(updated, F.lit("")).alias("updated_at")
    )
    f = facts.groupBy(*fold(facts)).agg(F.count("*").alias("table_row_count"))
    both = c.join(f, keys, "full_outer").na.fill({"chunk_count": 0, "page_count": 0, "table_row_count": 0, "updated_at": ""})
    return both.withColumns(
        {"filename": display_name(F.col("source_path"), F.col("source_type")), "type": type_label(F.col("source_type")), "status": F.lit("completed")}
    ).orderBy(F.desc("updated_at"), F.desc("filename"), *keys)


def documents_light(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """A2. Chunk counts of the first documents by key."""
    keys = ["namespace", "source_path", "source_type"]
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count")).orderBy(*keys).limit(limit)
