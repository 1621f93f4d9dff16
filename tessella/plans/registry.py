"""Named queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def quoted(words) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(column: str, words) -> str:
    """SQL: the column holds any of the words."""
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def matched(column: str) -> str:
    """SQL: a text in lower case with single spaces, as phrases are looked for in it."""
    return f"trim(regexp_replace(lower({column}), '\\s+', ' ', 'g'))"


def phrases_of(column: str) -> str:
    """SQL: the phrases of a question, repeated ones too: several English words, Thai runs, synonyms."""
    word = "[A-Za-z][A-Za-z0-9&+./:-]*"
    thai = f"""regexp_replace({column}, '["\''‘’“”()\\/_-]', ' ', 'g')""".replace("\''", "''")
    for noise in C.PHRASE_NOISE:
        thai = f"replace({thai}, '{noise}', ' ')"
    more = [f"CASE WHEN {any_of(matched(column), triggers)} THEN [{quoted(words)}] ELSE [] END" for triggers, words in C.SYNONYMS]
    english = f"list_filter(list_transform(regexp_extract_all({column}, '{word}(?:\\s+{word})+'), lambda x: {matched('x')}), lambda x: length(x) >= 4)"
    runs = f"list_filter(regexp_extract_all({thai}, '[ก-๙]{{4,}}'), lambda x: length(x) <= 24)"
    return " || ".join([english, runs, *more])
