"""Summaries of documents, jobs, runs and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LOG_ENTRIES, TERMINAL_STAGES, WORKFLOW_STAGES
from ..functions.text import text


def scrape_summary(items: DataFrame) -> DataFrame:
    """A3."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c)
    return items.agg(F.count("*").alias("item_count"), F.count_distinct("url").alias("url_count"), *map(total, ("downloaded_images", "downloaded_files", "pdf_extracted")))


def ocr_summary(rows: DataFrame) -> DataFrame:
    """A4, A9. Rows of (file, type, extract_method)."""
    page = F.col("type") == "page_text"
    return rows.agg(
        F.count_distinct("file").alias("ocr_docs_jsonl"),
        F.count_if(page).alias("ocr_pages"),
        F.count_if(F.col("type") == "figure").alias("ocr_figures"),
        F.count_if(page & (F.col("extract_method") == "text_layer")).alias("ocr_text_layer_pages"),
        F.count_if(page & F.col("extract_method").startswith("paddleocr")).alias("ocr_paddle_pages"),
    )


def site_audit(files: DataFrame) -> DataFrame:
    """A10. Files of each site folder by kind; rows of (folder, kind)."""
    kinds = ("image", "image_meta", "understanding", "file")
    return files.groupBy("folder").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds])


def ingest_totals(rows: DataFrame) -> DataFrame:
    """A12, P17. Rows of (source, chunks, facts, skipped)."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"added_{c}" if c != "skipped" else c) for c in ("chunks", "facts", "skipped")])


def dashboard_totals(documents: DataFrame) -> DataFrame:
    """A15."""
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("table_row_count"), F.lit(0)).alias("table_rows"))


def source_coverage(chunks: DataFrame, source: Column | str = "source_path", top: int = 8) -> DataFrame:
    """A16. Sources with most chunks, in per cent of the first."""
    s = F.col(source) if isinstance(source, str) else source
    best = chunks.groupBy(s.alias("source")).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "source").limit(top)
    return best.withColumn("percent", F.round(100.0 * F.col("chunks") / F.max("chunks").over(Window.partitionBy())).cast("int"))


def question_history(questions: DataFrame, c: str = "question", top: int = 10) -> DataFrame:
    """A17."""
    return questions.groupBy(F.col(c).alias("question")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "question").limit(top)


def distinct_in_order(rows: DataFrame, c: str, order: str) -> DataFrame:
    """A18, D13. Distinct non-empty values by first appearance."""
    return rows.where(text(c) != "").groupBy(c).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def recent_runs(runs: DataFrame, per_experiment: int = 12, total: int = 20) -> DataFrame:
    """S26, W12, O14. Newest runs of each experiment, then newest of all."""
    w = Window.partitionBy("experiment").orderBy(F.desc("start_time"), "run_id")
    newest = runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_experiment).drop("_r")
    return newest.orderBy(F.desc("start_time"), "run_id").limit(total)


def latest_metric(metrics: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """A19. Value of the first listed metric in the newest run that has any; rows of (run_id, start_time, name, value)."""
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col("name"))
    found = metrics.where(F.col("name").isin(*candidates) & F.col("value").isNotNull())
    return found.agg(F.max_by("value", F.struct(F.col("start_time"), (-place).alias("p"))).alias("value"))


def recent_series(metrics: DataFrame, name: str, runs: int = 8) -> DataFrame:
    """A20, A21. (run_name, y, share) of a metric over the newest runs, oldest first; share of the series' greatest."""
    newest = metrics.select("run_id", "run_name", "start_time").distinct().orderBy(F.desc("start_time"), "run_id").limit(runs)
    series = metrics.where(F.col("name") == name).join(newest.select("run_id"), "run_id", "left_semi")
    top = F.max("value").over(Window.partitionBy())
    return series.select(F.substring("run_name", 1, 18).alias("x"), F.col("value").alias("y"), (F.col("value") / top).alias("share"), "start_time").orderBy("start_time", "x")


def format_metric(value: Column, kind: str = "ratio") -> Column:
    """F39."""
    if kind == "percent":
        shown = F.format_string("%.1f%%", value * 100)
    elif kind == "ms":
        shown = F.format_string("%.0f ms", value)
    else:
        shown = F.format_string("%.3f", value)
    return F.when(value.isNull(), "-").otherwise(shown)


def job_status(events: DataFrame, job_id: str | None = None, job: str = "job_id", ts: str = "updated_at") -> DataFrame:
    """W11, T-1, S27, P30. Newest status of each job; a job that isn't known has the stage not_found."""
    others = [c for c in events.columns if c not in (job, ts)]
    latest = events.groupBy(job).agg(F.max_by(F.struct(*others), ts).alias("_s"), F.max(ts).alias(ts)).select(job, "_s.*", ts)
    if job_id is not None:
        asked = events.sparkSession.createDataFrame([(job_id,)], f"{job} string")
        latest = asked.join(latest.withColumn(job, F.col(job).cast("string")), job, "left").withColumn("stage", F.coalesce("stage", F.lit("not_found")))
    return latest.withColumn("terminal", F.col("stage").isin(*TERMINAL_STAGES))


def status_entries(events: DataFrame, job: str, order: list[str], extra: str, fixed: tuple[str, ...] = ("stage", "message")) -> DataFrame:
    """What each status event sets: job, order, key and value; a key of ``extra`` wins over a fixed one of the same event."""
    own = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*[F.col(c).cast("string") for c in fixed])), lambda k, v: ~F.map_contains_key(F.coalesce(extra, F.create_map().cast("map<string,string>")), k))
    entries = F.concat(F.map_entries(own), F.coalesce(F.map_entries(extra), F.array().cast("array<struct<key:string,value:string>>")))
    return events.select(job, *order, F.inline(entries))


def merged_status(events: DataFrame, job: str = "job_id", order: list[str] | None = None, extra: str = "extra", reset: str = "reset") -> DataFrame:
    """T-1. The status of each job as a map of all keys that its events have set: of each key the latest value.

    ``order`` names the columns that order events (time, then what breaks ties).
    An event whose ``reset`` is true begins the job anew: keys that were set before
    it are gone. Each key's latest value is an aggregate that is partial before the
    shuffle, so a hot job costs a row a key and task; a job's keys then meet.
    Null jobs are a job. A key that is set to null stays, with null.
    """
    order = order or ["updated_at"]
    rank = F.struct(*order)
    latest = status_entries(events, job, order, extra).groupBy(job, "key").agg(F.max_by("value", rank).alias("value"), F.max(rank).alias("_o"))
    # The job itself is a row too, so that resets and times arrive in the same exchange.
    seen = events.groupBy(job).agg(F.max(rank).alias("_o"), F.max(F.when(F.col(reset), rank)).alias("_r"))
    rows = latest.select(job, F.struct("key", "value", "_o").alias("_e"), F.lit(None).cast(seen.schema["_r"].dataType).alias("_r"), "_o").unionByName(seen.select(job, F.lit(None).cast(latest.select(F.struct("key", "value", "_o").alias("e")).schema["e"].dataType).alias("_e"), "_r", "_o"))
    by_job = rows.groupBy(job).agg(F.collect_list("_e").alias("_e"), F.max("_r").alias("_r"), F.max("_o").alias("_o"))
    kept = F.filter("_e", lambda e: F.col("_r").isNull() | (e["_o"] >= F.col("_r")))
    status = F.map_from_entries(F.transform(F.array_sort(kept), lambda e: F.struct(e["key"], e["value"])))
    out = by_job.select(job, status.alias("status"), F.col(f"_o.{order[0]}").alias(order[0]))
    return out.withColumn("stage", F.col("status")["stage"]).withColumn("terminal", F.coalesce(F.col("stage").isin(*TERMINAL_STAGES), F.lit(False)))


def job_logs(logs: DataFrame, tail: int = 200, job: str = "job_id", ts: str = "ts", ident: str = "id") -> DataFrame:
    """W11, T-2, K11. The last entries of each job, of at most LOG_ENTRIES that are kept."""
    w = Window.partitionBy(job).orderBy(F.desc(ts), F.desc(ident))
    return logs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= min(tail, LOG_ENTRIES)).drop("_r")


def workflow_steps(spark) -> DataFrame:
    """T-3. Stages in order."""
    return spark.createDataFrame(list(enumerate(WORKFLOW_STAGES, 1)), "step int, stage string")
