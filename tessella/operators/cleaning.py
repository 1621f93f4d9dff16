"""Cleaning and deduplication. Line rules are array expressions inside a row; row rules are windows by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    BOILERPLATE_LINES,
    BOILERPLATE_SIGNALS,
    FILE_URL_WORDS,
    IGNORED_IMAGES,
    LATE_WEB_SIGNALS,
)
from ..functions.text import collapse_space, contains_any, let, match_text, nfkc, strip, text

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(c: Column | str) -> Column:
    return F.transform(F.split(text(c), LINE_END), strip)


def is_menu_line(line: Column) -> Column:
    """P7. Blank, or short without figures and punctuation of sentences."""
    s = strip(line)
    return (s == "") | (~s.rlike(r"(?U)\d") & ~s.rlike(r"[.:–()%-]") & (F.length(s) <= 40) & (F.size(F.split(s, r"(?U)\s+")) <= 6))


def clean_web_text(c: Column | str) -> Column:
    """P8, W13. Lines that are no menu."""
    return F.array_join(F.filter(lines(c), lambda x: ~is_menu_line(x)), "\n")


def _line_pattern(words: tuple[str, ...]) -> str:
    # A word that ends in a combining mark is followed by a letter where a boundary is asked for.
    word = r"[\p{L}\p{N}_]"
    ends = "|".join(f"{w}(?={word})" if w[-1] in "ก็่้๊๋์ิีึืุูั" and w[-1] != "ก" else f"{w}(?!{word})" for w in words)
    return rf"(?iu)(?:^|(?<!{word})(?={word})|(?<={word})(?!{word}))(?:{ends})"


def is_boilerplate_line(line: Column) -> Column:
    """P9. A boilerplate word, or six and more words that are mostly short."""
    words = F.split(line, r"(?U)\s+")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 4))
    # The patterns are only tried where a word stands somewhere; letters that they take for i, s and k are replaced first.
    folded = F.lower(F.translate(line, "İıſ\u212a", "iisk"))
    some = let(folded, lambda x: contains_any(x, tuple(w for f in BOILERPLATE_LINES for w in f)))
    known = some & reduce(lambda a, b: a | b, [line.rlike(_line_pattern(f)) for f in BOILERPLATE_LINES])
    return known | ((F.size(words) >= 6) & (short / F.size(words) > 0.65))


def distinct_by(items: Column, key) -> Column:
    """The first item of each key, in order: keys are compared inside the row."""
    keyed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(keyed)
    start = F.struct(F.expr("cast(array() AS array<struct<i:int,x:string>>)").alias("out"), F.lit(None).cast("string").alias("last"))
    step = lambda a, e: F.when(a["last"] == e["k"], a).otherwise(F.struct(F.concat(a["out"], F.array(F.struct(e["i"].alias("i"), e["x"].alias("x")))).alias("out"), e["k"].alias("last")))
    return F.transform(F.array_sort(F.aggregate(ordered, start, step, lambda a: a["out"])), lambda e: e["x"])


def drop_boilerplate_lines(c: Column | str) -> Column:
    """P9, D6. Lines of eight letters and more without boilerplate, each once regardless of case."""
    kept = F.filter(lines(c), lambda x: (F.length(x) >= 8) & ~is_boilerplate_line(x))
    return F.array_join(distinct_by(kept, match_text), "\n")


def normalize_visible_text(c: Column | str, least: int = 10) -> Column:
    """P10, D6. Lines of ten letters and more, each once, case kept."""
    s = F.regexp_replace(strip(text(c)), " ", " ")
    s = F.regexp_replace(nfkc(s), r"(?U)[^\S\r\n]+", " ")
    kept = F.filter(lines(s), lambda x: F.length(x) >= least)
    return F.array_join(distinct_by(kept, collapse_space), "\n")


def is_boilerplate_chunk(c: Column | str, source_type: Column | None = None, chunk_index: Column | None = None) -> Column:
    """P12."""

    def found(t: Column) -> Column:
        out = contains_any(t, BOILERPLATE_SIGNALS)
        if source_type is not None:
            out = out | ((source_type == "web_page") & (F.coalesce(chunk_index, F.lit(0)) >= 12) & contains_any(t, LATE_WEB_SIGNALS))
        return out

    return let(match_text(c), found)  # normalised once, not for each signal


def is_good_image_url(c: Column | str) -> Column:
    """P13."""
    u = strip(F.lower(text(c)))
    return (u != "") & ~contains_any(u, IGNORED_IMAGES)


def looks_like_file_url(c: Column | str) -> Column:
    """P14."""
    return contains_any(F.lower(text(c)), FILE_URL_WORDS)


def keep_downloads(df: DataFrame, limit: int, content_type: str = "content_type", size: str = "size", order: str = "ord") -> DataFrame:
    """S22. Downloads that are no page and have ten KiB at least, the first of them."""
    return df.where(~F.lower(text(content_type)).contains("text/html") & (F.col(size) >= 10240)).orderBy(order).limit(limit)


def best_candidate(*candidates: Column) -> Column:
    """P20. The longest stripped candidate; the first of equals."""
    sized = F.array(*[F.struct(F.length(strip(text(c))).alias("n"), F.lit(-i).alias("o"), text(c).alias("t")) for i, c in enumerate(candidates)])
    return F.array_max(sized)["t"]


def page_content(article: Column, main: Column, visible: Column) -> Column:
    """P20. Best candidate; the visible text where it is under 250 letters; lines dropped if 200 letters stay."""

    def dropped(best: Column) -> Column:
        return let(drop_boilerplate_lines(best), lambda d: F.when(F.length(d) >= 200, d).otherwise(best))

    def chosen(v: Column) -> Column:
        seen = lambda b: F.when((F.length(strip(b)) < 250) & (text(v) != ""), text(v)).otherwise(b)
        return let(let(best_candidate(article, main, v), seen), dropped)

    return let(visible, chosen)  # each step is computed once


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """W9, D4, D5, D7, D8, D9, D10, D12. The first row of each key.

    A minimum by key, so it pre-aggregates before the shuffle and a hot key costs a row a task.
    """
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.select(*named, rank.alias("_o"), F.struct(*df.columns).alias("_row"))
    first = picked.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_o").alias("_row"))
    return first.select("_row.*")


def dedupe_chunks(df: DataFrame, order: str = "ord") -> DataFrame:
    """D5, D14."""
    empty = [F.coalesce(F.col(c), F.lit("")) for c in ("namespace", "source_url", "source_path")]
    number = [F.coalesce(F.col(c), F.lit(0)) for c in ("page", "chunk_index")]
    return keep_first(df, [*empty, *number, "text"], [order])


def dedupe_facts(df: DataFrame, order: str = "ord") -> DataFrame:
    """D4. Keys regardless of case and outer space, with the unit."""
    fold = [strip(F.lower(text(c))) for c in ("entity", "key", "value", "unit")]
    return keep_first(df, [*fold, F.coalesce(F.col("year"), F.lit(0))], [order])


def dedupe_urls(df: DataFrame, url: str = "url", order: str = "ord") -> DataFrame:
    """D8, D9. By the URL without its fragment."""
    return keep_first(df, [F.substring_index(F.col(url), "#", 1)], [order])


def mark_duplicates(df: DataFrame, key: Column | str, order: str, ident: str) -> DataFrame:
    """W10, D10, J14. is_duplicate and duplicate_of, the id of the first row of the key.

    First rows are found by a pre-aggregated minimum and joined back, one row a key, so that a hot key can be split.
    """
    k = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("_k", k)
    first = keyed.groupBy("_k").agg(F.min_by(ident, F.struct(F.col(order).alias("o"), F.col(ident).alias("i"))).alias("_first")).withColumnRenamed("_k", "_fk")
    out = keyed.join(first, F.col("_k").eqNullSafe(F.col("_fk")), "left")
    dup = F.col(ident) != F.col("_first")
    return out.withColumns({"is_duplicate": dup, "duplicate_of": F.when(dup, F.col("_first"))}).drop("_k", "_fk", "_first")


def focus_window(df: DataFrame, match: Column, partition: str, order: str, n: int = 1) -> DataFrame:
    """W6. Rows within n places of a match; all rows of a group without one."""
    w = Window.partitionBy(partition)
    near = F.max("_m").over(w.orderBy(order).rowsBetween(-n, n))
    return df.withColumn("_m", match.cast("int")).withColumns({"_near": near, "_any": F.max("_m").over(w)}).where("_near = 1 OR _any = 0").drop("_m", "_near", "_any")


def budget_prefix(df: DataFrame, size: Column, partition: str, order: str, limit: int, gap: int = 2, most: int | None = None) -> DataFrame:
    """W8. Rows in order up to the first that overflows the budget; later ones aren't considered."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_size", size).withColumn("_n", F.row_number().over(Window.partitionBy(partition).orderBy(order)))
    if most is not None:
        df = df.where(F.col("_n") <= most)
    over = F.sum(F.col("_size") + gap).over(w) - gap > limit
    df = df.withColumn("_over", over.cast("int"))
    return df.withColumn("_stop", F.max("_over").over(w)).where("_stop = 0").drop("_size", "_n", "_over", "_stop")
