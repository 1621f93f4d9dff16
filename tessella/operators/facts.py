"""Facts: scoring and choice of chunks, parsing of extractor output, answers from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import FACT_CHARS, FACT_CHUNKS, FACT_MIN_CHARS, FACTS_HEADING, NAMESPACES
from ..functions.scoring import fact_chunk_score
from ..functions.text import strip, text

FACT_JSON = "struct<entity_hint:string,facts:array<struct<entity:string,key:string,value:string,unit:string,year:string,evidence_text:string>>>"


def clip(c: Column | str, n: int = FACT_CHARS) -> Column:
    """F14."""
    t = strip(text(c))
    return F.when(F.length(t) <= n, t).otherwise(F.regexp_replace(F.substring(t, 1, n), r"(?U)\s+$", ""))


def top_fact_chunks(df: DataFrame, partition: str, order: str, k: int = FACT_CHUNKS, c: str = "text") -> DataFrame:
    """O10, P18. The k chunks of each document that most look like holding figures; short ones are left out."""
    df = df.withColumn(c, strip(text(c))).where(F.length(c) >= FACT_MIN_CHARS).withColumn("fact_score", fact_chunk_score(c))
    w = Window.partitionBy(partition).orderBy(F.desc(F.round("fact_score", 9)), order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def json_object(c: Column | str) -> Column:
    """F15, F49. The outermost object of a model's answer, without its code fence; null if there is none."""
    s = strip(text(c))
    s = F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(s.startswith("{") & s.endswith("}"), s).otherwise(found), F.lit(""))


def parse_facts(df: DataFrame, answer: str = "answer", source: str = "text", hint: str = "entity_hint", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """F16, P24, G14. Facts of extractor answers: key and value set, evidence found in the source text."""
    parsed = F.from_json(json_object(answer), FACT_JSON)
    rows = df.select(*keep, text(source).alias("_t"), text(hint).alias("_h"), F.posexplode(parsed["facts"]).alias("ord", "f"))
    evidence = F.substring(text(F.col("f.evidence_text")), 1, 250)
    out = rows.select(
        *keep,
        "ord",
        F.coalesce(F.nullif(F.col("f.entity"), F.lit("")), F.col("_h")).alias("entity"),
        strip(text(F.col("f.key"))).alias("key"),
        strip(text(F.col("f.value"))).alias("value"),
        text(F.col("f.unit")).alias("unit"),
        F.coalesce(F.expr("try_cast(f.year AS int)"), F.lit(0)).alias("year"),
        evidence.alias("evidence_text"),
        "_t",
    )
    return out.where((F.col("key") != "") & (F.col("value") != "") & ((F.col("evidence_text") == "") | F.col("_t").contains(F.col("evidence_text")))).drop("_t")


def fact_line() -> Column:
    """F42. One fact as a line of an answer: place, entity, key, value, unit, year and source."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    paged = F.coalesce(F.col("page"), F.lit(0)) != 0
    src = F.when(paged, F.concat(text("source_path"), F.lit(" (page "), number("page"), F.lit(")"))).otherwise(text("source_path"))
    return F.concat(
        F.lit("- ["), text("namespace"), F.lit("] "), text("entity"), F.lit(" | "), text("key"), F.lit(" = "), text("value"), F.lit(" "), text("unit"),
        F.lit(" (year="), number("year"), F.lit(") [source: "), src, F.lit("]"),
    )


def facts_answer(facts: DataFrame, partition: str = "qid", limit: int = 25, per_namespace: int = 30, namespaces: tuple[str, ...] = NAMESPACES) -> DataFrame:
    """C7, O11, O12. One answer a question: (partition, answer, n_facts).

    The first facts of each namespace by year and entity; of these the first
    ``limit`` in the order of the namespaces under a heading, or numbered titles by
    year and value, counted from 1.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, namespaces)), text("namespace")), F.lit(0)), F.lit(len(namespaces) + 1))
    inside = Window.partitionBy(partition, "namespace").orderBy("year", "entity", "id")
    rows = facts.withColumns({"_n": F.row_number().over(inside), "_place": place}).where(F.col("_n") <= per_namespace)
    listed = F.col("key") == "numbered_section_title"
    first = [F.when(listed, F.coalesce(F.col("year"), F.lit(0))), F.when(listed, text("value")), F.col("_place"), F.col("_n")]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(partition).orderBy(*first))).where(F.col("_r") <= limit)
    rows = rows.withColumn("_line", F.when(listed, F.concat(F.col("_r").cast("string"), F.lit(". "), text("value"))).otherwise(fact_line()))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_line"))), lambda x: x["_line"]), "\n")
    out = rows.groupBy(partition).agg(lines.alias("answer"), F.count("*").alias("n_facts"), F.bool_and(listed).alias("_listed"))
    return out.select(partition, F.when(F.col("_listed"), F.col("answer")).otherwise(F.concat(F.lit(FACTS_HEADING + "\n"), "answer")).alias("answer"), "n_facts")
