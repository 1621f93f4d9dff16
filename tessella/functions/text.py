"""Text functions as Columns. All take and return Columns; null counts as empty."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import BLOCK_KEYWORDS, SEARCH_STOPWORDS

WORD = r"[\p{L}\p{N}_]"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where the optimiser inlines it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility normal form; the one step that Spark has no expression for."""
    return _nfkc(c)


def normalize_text(c: Column | str, preserve_newlines: bool = False) -> Column:
    """F1. Control characters go before white space collapses, line ends with them, unless they are preserved."""
    s = F.regexp_replace(nfkc(text(c)), "\u00a0", " ")
    control = r"[\x00-\x09\x0b-\x1f\x7f-\x9f]" if preserve_newlines else r"[\x00-\x1f\x7f-\x9f]"
    s = F.regexp_replace(s, control, "")
    s = F.regexp_replace(s, r"[\u200b-\u200f\u202a-\u202e\ufeff]", "")
    s = F.regexp_replace(s, r"(?U)[^\S\r\n]+", " ")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def normalize_ocr_text(c: Column | str) -> Column:
    """F2."""
    s = F.regexp_replace(text(c), "\u00a0", " ")
    return strip(F.regexp_replace(F.regexp_replace(s, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def collapse_space(c: Column | str) -> Column:
    """F3, case kept."""
    # Single spaces stay as they are; behind that no other white space is left to trim.
    return F.trim(F.regexp_replace(text(c), r"(?U)\s{2,}|[^\S ]", " "))


def match_text(c: Column | str) -> Column:
    """F3, lower case."""
    return collapse_space(F.lower(text(c)))


def contains_thai(c: Column | str) -> Column:
    """F4."""
    return text(c).rlike(r"[\u0E00-\u0E7F]")


def language_hint(c: Column | str) -> Column:
    """F5. mixed, th, en or unknown."""
    thai, latin = contains_thai(c), text(c).rlike("[A-Za-z]")
    return F.when(thai & latin, "mixed").when(thai, "th").when(latin, "en").otherwise("unknown")


def search_terms(c: Column | str) -> Column:
    """F6, D11. Distinct terms of two or more letters in order, without stop words."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{N}_\u0E00-\u0E7F]{2,}"), 0)
    return F.array_except(found, F.array(*map(F.lit, SEARCH_STOPWORDS)))


def eval_tokens(c: Column | str) -> Column:
    """F7. Distinct tokens of the evaluation measures."""
    return F.array_distinct(F.regexp_extract_all(match_text(c), F.lit(r"[\p{L}\p{N}_ก-๙]{2,}"), 0))


def preview(c: Column | str, n: int, ellipsis: bool = False) -> Column:
    """P6."""
    t = text(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t) if ellipsis else F.substring(t, 1, n)


def is_probably_blocked(c: Column | str) -> Column:
    """P11."""
    t = strip(F.lower(text(c)))
    return contains_any(t, BLOCK_KEYWORDS) | (F.length(t) < 250)


def safe_filename(c: Column | str, n: int = 120) -> Column:
    """F32, F46. Letters, digits, dot, dash and underscore; others become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(text(c), r"[^\p{L}\p{N}._-]+", "_"), r"^_+|_+$", ""), 1, n)


def version_hash(c: Column | str) -> Column:
    """F45. Twelve digits of the SHA-1."""
    return F.substring(F.sha1(text(c)), 1, 12)
