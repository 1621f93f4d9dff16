"""Scores and similarities as Columns, in higher-order functions; no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FACT_KEYWORDS, IMAGE_TYPES, KEPT_IMAGE_TYPES
from .text import contains_any, let, match_text, text


def occurrences(hay: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return (F.length(hay) - F.length(F.replace(hay, term, F.lit("")))) / F.length(term)


def lexical_score(terms: Column, c: Column | str) -> Column:
    """F8. Sum of min(3, 1 + ln(1 + n)) over the terms found, plus three times their share."""
    return let(F.lower(text(c)), lambda hay: lexical_part(terms, hay))


def lexical_part(terms: Column, hay: Column) -> Column:
    """F8 of a text that is lower-cased already."""
    part = lambda t: F.when(hay.contains(t), F.least(F.lit(3.0), 1 + F.log1p(occurrences(hay, t)))).otherwise(0.0)
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + part(t))
    found = F.size(F.filter(terms, lambda t: hay.contains(t)))
    return F.when((F.length(hay) == 0) | (F.size(terms) == 0), 0.0).otherwise(total + 3.0 * found / F.size(terms))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """F9."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def l2_distance(a: Column, b: Column) -> Column:
    """F10."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, v: s + v))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def fact_chunk_score(c: Column | str) -> Column:
    """F13, A13, A14. How likely a chunk holds figures."""
    t = text(c)
    s = F.lower(t)
    n = lambda pattern: F.regexp_count(s, F.lit(pattern))
    keywords = reduce(lambda a, b: a + b, [s.contains(k).cast("int") for k in FACT_KEYWORDS])
    edge, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    return (
        F.least(F.length(t), F.lit(2000)) / 2000.0 * 2.0
        + n(r"(?U)\d") * 0.15
        + n("%|เปอร์เซ็นต์|ร้อยละ") * 2.0
        + n("บาท|ล้าน|พันล้าน|million|billion|usd|thb") * 1.5
        + n(rf"(?U){edge}20\d{{2}}{end}|ปี\s*20\d{{2}}|พ\.ศ\.\s*\d{{4}}") * 2.0
        + keywords * 1.2
    )


def phrase_weight(phrase: Column) -> Column:
    """F22."""
    return F.when(phrase.contains(" ") | (F.length(phrase) >= 8), 0.14).otherwise(0.06)


def phrase_matches(phrases: Column, c: Column | str) -> Column:
    """J3. The phrases a text holds."""
    return let(match_text(c), lambda t: phrases_in(phrases, t))


def phrases_in(phrases: Column, hay: Column) -> Column:
    """J3 of a text that is normalised already."""
    return F.filter(phrases, lambda p: (p != "") & hay.contains(p))


def relevance_terms(c: Column, n: int) -> Column:
    """Terms of the first n characters, repeats kept."""
    return F.regexp_extract_all(F.lower(F.substring(c, 1, n)), F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{2,}"), 0)


def image_type(c: Column | str) -> Column:
    """F12."""
    t = F.lower(text(c))
    out = F
    for name, words in IMAGE_TYPES:
        out = out.when(contains_any(t, words), name)
    return out.otherwise("other")


def keep_image(score: Column, kind: Column) -> Column:
    """P15."""
    return (score >= 0.12) | kind.isin(*KEPT_IMAGE_TYPES)


def is_relevant(patterns: Column, c: Column | str) -> Column:
    """P23. Whether a text holds any of the patterns, both normalised."""
    return let(match_text(c), lambda t: F.exists(patterns, lambda p: t.contains(match_text(p))))


def token_overlap(found: Column, wanted: Column) -> Column:
    """F37. Share of the wanted tokens that were found, four digits."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(found, wanted)) / F.size(wanted), 4))
