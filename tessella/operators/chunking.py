"""Generators: sentences, chunks and sections, one row in and many out, without a shuffle.

Sequential packing is a fold over the sentences of one text, so its state is
bounded by that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.constants import CHUNK_CHARS, CHUNK_OVERLAP, EMBED_CHARS, EMBED_OVERLAP, MIN_CHUNK_CHARS, TOPIC_SIMILARITY
from ..functions.text import collapse_space, let, normalize_text, strip, text
from ..tables import once


def no_strings() -> Column:
    return F.expr("cast(array() AS array<string>)")


def _solid(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(c: Column | str) -> Column:
    """G1. Parts after . ! ? and white space, or at line ends."""
    t = F.regexp_replace(text(c), r"\r\n|\r", "\n")
    return _solid(F.split(t, r"(?U)(?<=[.!?])\s+|\n+"))


def sentences_with_thai(c: Column | str) -> Column:
    """G2. Parts after . ! ? and two Thai marks."""
    return _solid(F.split(text(c), r"(?U)(?<=[.!?ฯๆ])\s+"))


def pieces(c: Column, step: int, width: int) -> Column:
    """Substrings of ``width`` characters every ``step``."""
    n = F.greatest(F.ceil(F.length(c) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * step + 1, F.lit(width)))


def char_split(c: Column | str, width: int = EMBED_CHARS, overlap: int = EMBED_OVERLAP) -> Column:
    """G7. A text that fits stays whole; others are cut every width - overlap characters."""
    t = strip(text(c))
    step = width - overlap
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.length(t) - overlap) / step), F.lit(1)).cast("int") - 1), lambda i: strip(F.substring(t, i * step + 1, F.lit(width))))
    return F.when(t == "", no_strings()).when(F.length(t) <= width, F.array(t)).otherwise(F.filter(cut, lambda p: p != ""))


def pack(parts: Column, limit: int, joint: str = " ") -> Column:
    """G3, G5. Greedy packing in order: a part joins the last chunk while that stays within the limit."""
    start = F.struct(no_strings().alias("out"), F.lit("").alias("buf"))

    def step(a: Column, p: Column) -> Column:
        return (
            F.when(a["buf"] == "", F.struct(a["out"].alias("out"), p.alias("buf")))
            .when(F.length(a["buf"]) + len(joint) + F.length(p) <= limit, F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(joint), p).alias("buf")))
            .otherwise(F.struct(F.concat(a["out"], F.array(a["buf"])).alias("out"), p.alias("buf")))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))


def split_long_block(c: Column | str, limit: int = CHUNK_CHARS) -> Column:
    """G3. Sentences are packed; one that is too long by itself is cut, and closes the chunk before it."""
    block = strip(text(c))
    start = F.struct(no_strings().alias("out"), F.lit("").alias("buf"))

    def step(a: Column, s: Column) -> Column:
        flushed = F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))
        return (
            F.when(F.length(s) > limit, F.struct(F.concat(flushed, _solid(pieces(s, limit, limit))).alias("out"), F.lit("").alias("buf")))
            .when(a["buf"] == "", F.struct(a["out"].alias("out"), s.alias("buf")))
            .when(F.length(a["buf"]) + 1 + F.length(s) <= limit, F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(" "), s).alias("buf")))
            .otherwise(F.struct(F.concat(a["out"], F.array(a["buf"])).alias("out"), s.alias("buf")))
        )

    packed = F.aggregate(sentences_with_thai(block), start, step, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))
    return F.when(block == "", no_strings()).when(F.length(block) <= limit, F.array(block)).otherwise(packed)


def with_overlap(chunks: Column, overlap: int = CHUNK_OVERLAP) -> Column:
    """W5. Every chunk but the first opens with the end of the chunk before it."""
    joined = lambda all_, c, i: F.concat(F.right(F.get(all_, i - 1), F.lit(overlap)), F.lit("\n"), c)
    return let(chunks, lambda all_: F.transform(all_, lambda c, i: F.when(i == 0, c).otherwise(strip(joined(all_, c, i)))))


def chunk_text(df: DataFrame, c: str = "text", out: str = "chunks", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, preserve_newlines: bool = False) -> DataFrame:
    """G4. Paragraphs are packed, long ones split by sentence, then overlapped.

    Normalised text has no line end and so one paragraph, unless line ends are preserved.
    """
    df = df.withColumn("_norm", normalize_text(c, preserve_newlines))
    if preserve_newlines:
        start = F.struct(no_strings().alias("out"), F.lit("").alias("buf"))
        flush = lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"])))

        def step(a: Column, p: Column) -> Column:
            return (
                F.when(F.length(p) > size, F.struct(F.concat(flush(a), split_long_block(p, size)).alias("out"), F.lit("").alias("buf")))
                .when(a["buf"] == "", F.struct(a["out"].alias("out"), p.alias("buf")))
                .when(F.length(a["buf"]) + 2 + F.length(p) <= size, F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit("\n\n"), p).alias("buf")))
                .otherwise(F.struct(F.concat(a["out"], F.array(a["buf"])).alias("out"), p.alias("buf")))
            )

        packed = F.aggregate(_solid(F.split("_norm", r"(?U)\n\s*\n")), start, step, flush)
    else:
        packed = split_long_block("_norm", size)
    df = df.withColumn("_packed", packed)
    return df.withColumn(out, with_overlap(F.col("_packed"), overlap) if overlap > 0 else F.col("_packed")).drop("_norm", "_packed")


def merge_short(chunks: Column, least: int = MIN_CHUNK_CHARS) -> Column:
    """W4. A chunk shorter than ``least`` joins the one before it; the first stays."""
    start = F.struct(no_strings().alias("out"), F.lit(None).cast("string").alias("buf"))

    def step(a: Column, p: Column) -> Column:
        return (
            F.when(a["buf"].isNull(), F.struct(a["out"].alias("out"), p.alias("buf")))
            .when(F.length(p) < least, F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(" "), p).alias("buf")))
            .otherwise(F.struct(F.concat(a["out"], F.array(a["buf"])).alias("out"), p.alias("buf")))
        )

    return F.aggregate(chunks, start, step, lambda a: F.when(a["buf"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))


def fallback_chunks(c: Column | str, target: int = CHUNK_CHARS, least: int = MIN_CHUNK_CHARS) -> Column:
    """G5. Sentences packed to a target size, short chunks merged."""
    parts = F.filter(F.transform(sentences(c), collapse_space), lambda p: p != "")
    return merge_short(pack(parts, target), least)


def explode_chunks(df: DataFrame, chunks: Column | str = "chunks", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """W1. One row a chunk with chunk_index from 1 and chunk_total."""
    c = F.col(chunks) if isinstance(chunks, str) else chunks
    rows = once(df, _c=c).select(*keep, F.size("_c").alias("chunk_total"), F.posexplode("_c").alias("_p", "text"))
    return rows.select(*keep, (F.col("_p") + 1).alias("chunk_index"), "chunk_total", "text")


def semantic_chunks(df: DataFrame, key: str, order: str, sentence: str = "sentence", vector: str = "embedding", threshold: float = TOPIC_SIMILARITY, least: int = MIN_CHUNK_CHARS) -> DataFrame:
    """G6, W2, W3, W4. Sentences of a text with their vectors to chunks; a new chunk where neighbours differ.

    One row a chunk: key, chunk_index, n_sentences, text. A single sentence stays only if it is long enough.
    """
    w = Window.partitionBy(key).orderBy(order)
    near = scoring.cosine(F.lag(vector).over(w), F.col(vector))
    rows = df.select(key, order, sentence, vector).withColumn("_sim", near)
    rows = rows.withColumn("_island", F.sum(F.coalesce((F.col("_sim") < threshold).cast("int"), F.lit(0))).over(w))
    islands = rows.groupBy(key, "_island").agg(F.array_sort(F.collect_list(F.struct(order, sentence))).alias("_s"), F.count("*").alias("_n"))
    islands = islands.withColumn("_t", F.array_join(F.transform("_s", lambda s: s[sentence]), " "))
    v = Window.partitionBy(key).orderBy("_island")
    alone = F.sum("_n").over(Window.partitionBy(key)) == 1
    islands = islands.withColumn("_alone", alone).where(~F.col("_alone") | (F.length("_t") >= least))
    islands = islands.withColumn("_group", F.sum((F.length("_t") >= least).cast("int")).over(v) + F.when(F.first(F.length("_t")).over(v) < least, 1).otherwise(0))
    merged = islands.groupBy(key, "_group").agg(F.array_sort(F.collect_list(F.struct("_island", "_t"))).alias("_s"), F.sum("_n").alias("n_sentences"))
    return merged.select(
        key,
        F.row_number().over(Window.partitionBy(key).orderBy("_group")).alias("chunk_index"),
        "n_sentences",
        F.array_join(F.transform("_s", lambda s: s["_t"]), " ").alias("text"),
    )


def numbered_sections(c: Column | str) -> Column:
    """G8. The part before the first numbered line, then "n. body" of each; empty ones go."""
    t = strip(text(c))
    parts = F.split(t, r"(?mU)(?=^\s*\d{1,2}\.\s*)")
    number = lambda p: F.regexp_extract(p, r"(?U)^\s*(\d{1,2})\.\s*", 1)
    body = lambda p: strip(F.regexp_replace(p, r"(?U)^\s*\d{1,2}\.\s*", ""))
    made = F.transform(parts, lambda p: F.when(number(p) == "", strip(p)).when(body(p) == "", "").otherwise(F.concat(number(p), F.lit(". "), body(p))))
    return F.filter(made, lambda p: p != "")


def inline_sections(c: Column | str) -> Column:
    """G9, W7. Parts that open with a number, a dot and a letter, up to the next such place."""
    parts = F.split(collapse_space(c), r"(?<!\d)(?=\d{1,2}\.\s*[\"'“”‘’(\[]?[A-Za-zก-๙])")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike(r"^\d{1,2}\.\s*[\"'“”‘’(\[]?[A-Za-zก-๙]"))


def section_order(section: Column) -> Column:
    return F.regexp_extract(section, r"^(\d{1,2})\.", 1).try_cast("int")


def section_title(section: Column, longest: int = 180) -> Column:
    """G10, P25. First line of a numbered section, or null if it isn't a fit title."""
    title = strip(F.element_at(F.split(F.regexp_replace(section, r"(?U)^\s*\d{1,2}\.\s*", ""), "\n"), 1))
    return F.when((title != "") & (F.length(title) <= longest), title)


def numbered_facts(df: DataFrame, c: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """G10. (entity, key, value, year) rows of numbered titles; year is the number, the first of each stays."""
    rows = df.select(*keep, F.posexplode(numbered_sections(c)).alias("_p", "_s"))
    rows = rows.select(*keep, "_p", section_order(F.col("_s")).alias("year"), section_title(F.col("_s")).alias("value")).where("year > 0 AND value IS NOT NULL")
    w = Window.partitionBy(*keep, "year", F.lower("value")).orderBy("_p")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keep, F.lit("numbered_section_title").alias("key"), "value", "year")
