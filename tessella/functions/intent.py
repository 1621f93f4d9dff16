"""What a question asks for, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    DETAIL_WORDS,
    KEY_WORDS,
    LIST_REQUESTS,
    LIST_WORDS,
    NUMERIC_WORDS,
    PHRASE_NOISE,
    SINGLE_ARTICLE_WORDS,
    STRUCTURED_SIGNALS,
    SYNONYMS,
    TREND_WORDS,
)
from .text import contains_any, let, match_text, text


def route(c: Column | str) -> Column:
    """F17, C1. structured_rag or semantic_rag."""
    return F.when(contains_any(F.lower(text(c)), STRUCTURED_SIGNALS), "structured_rag").otherwise("semantic_rag")


def fact_key(c: Column | str) -> Column:
    """F18. The fact key a question asks for, or an empty string."""
    q, low = text(c), F.lower(text(c))
    trend = q.contains(TREND_WORDS[0]) | low.contains(TREND_WORDS[1])
    out = F.when(contains_any(q, LIST_WORDS) & trend, "numbered_section_title")
    for key, words in KEY_WORDS:
        out = out.when(contains_any(low, words), key)
    return out.otherwise("")


def preferred_domain(c: Column | str) -> Column:
    """F19."""
    q, low = text(c), F.lower(text(c))
    trend = q.contains(TREND_WORDS[0]) | low.contains(TREND_WORDS[1])
    five = low.contains("5") | q.contains("ห้า")
    eight = low.contains("8") | q.contains("แปด")
    sme = low.contains("sme") | q.contains("เอสเอ็มอี")
    return (
        F.when(five & trend & sme, "ttbbank.com")
        .when(low.contains("ttb") | low.contains("finbiz"), "ttbbank.com")
        .when(eight & trend, "marketingoops.com")
        .otherwise("")
    )


def query_phrases(c: Column | str) -> Column:
    """F20, J9, D13. English phrases of several words, Thai runs, then synonyms; distinct, in order."""
    raw = text(c)
    english = F.regexp_extract_all(raw, F.lit(r"[A-Za-z][A-Za-z0-9&+./:-]*(?:(?U:\s)+[A-Za-z][A-Za-z0-9&+./:-]*)+"), 0)
    english = F.filter(F.transform(english, match_text), lambda p: F.length(p) >= 4)
    thai = F.regexp_replace(raw, r"[\"'‘’“”()\\/_-]", " ")
    for noise in PHRASE_NOISE:
        thai = F.replace(thai, F.lit(noise), F.lit(" "))
    runs = F.filter(F.regexp_extract_all(thai, F.lit("[ก-๙]{4,}"), 0), lambda p: F.length(p) <= 24)

    def added(low: Column) -> Column:
        return F.concat(*[F.when(contains_any(low, triggers), F.array(*map(F.lit, more))).otherwise(F.expr("cast(array() AS array<string>)")) for triggers, more in SYNONYMS])

    return F.array_distinct(F.concat(english, runs, let(match_text(c), added)))


def prefers_single_article(c: Column | str) -> Column:
    """P28."""
    return contains_any(text(c), SINGLE_ARTICLE_WORDS)


def wants_number(c: Column | str) -> Column:
    """P28."""
    q = text(c)
    return contains_any(q, NUMERIC_WORDS) | q.rlike(r"(?U)(?<![\p{L}\p{N}_])20\d{2}(?![\p{L}\p{N}_])")


def requested_list_count(c: Column | str) -> Column:
    """F25. The number in "5 trends", or 0."""
    n = F.regexp_extract(text(c), r"(?i)(\d{1,2})\s*(?:เทรนด์|trends?)", 1)
    return F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(0))


def requests_list(c: Column | str) -> Column:
    """P28. A question for a numbered list of trends."""
    q, low = text(c), F.lower(text(c))
    return (q.contains(TREND_WORDS[0]) | low.contains(TREND_WORDS[1])) & contains_any(q, LIST_REQUESTS)


def requests_detail(c: Column | str) -> Column:
    """P28. A question for a definition or a figure."""
    return contains_any(text(c), DETAIL_WORDS)
