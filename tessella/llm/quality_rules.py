"""Line-first cleaning with a document verdict, in built-in expressions only.

Every line is tested against punctuation, navigation and boilerplate rules.
Failing lines are removed; a document that thereby loses more than
``max_loss`` of its words, or that fails the base rules, is not kept.

The plan is one projection over the scan: no shuffle, no join, no Python.

Edge cases: a null text counts as empty. An empty text has no word and fails
the base rules. Lines are split at ``\\n`` alone; lines without a word are
neither removed nor counted. The sentence marks of all scripts count, and a line that holds
a letter of a script without such marks isn't tested for them. Very long texts are judged whole. A text that loses
just ``max_loss`` of its words is kept. Repeated rows are judged each on its own;
an empty table gives no rows. Extra columns pass through; columns whose names
clash with those added are replaced, by ``keep_clean`` no column is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names, text_or_empty, words

# The symbols of the base rule.
SYMBOLS = "#*$%&|<>"

# Phrases of web boilerplate, tested in lines of at most
# ``boilerplate_words`` words.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "forgot your password",
    "log in",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "sign up",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "use of cookies",
    "uses cookies",
)


# Marks that end or part a sentence, by script: Latin, Greek and Cyrillic; Armenian;
# Hebrew; Arabic; Devanagari and its neighbours; Ethiopic; Khmer; Mongolian; Chinese and Japanese.
SENTENCE_MARKS = ".!?:;,…·" "։՝՞" "׃" "،؛؟۔" "।॥" "፣።፤፥" "។៕៖" "᠂᠃" "。、，！？：；．｡､"
# Scripts whose sentences end with a space or a line, so that a line without a mark is no sign.
UNMARKED_SCRIPTS = ("Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Javanese", "Tai_Le", "New_Tai_Lue", "Tai_Tham")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_loss: float = 0.5
    boilerplate_words: int = 20
    max_symbol_share: float = 0.1
    max_shout_share: float = 0.3
    words_per_separator: int = 4
    unpunctuated_words: int = 3


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where the optimiser inlines the result."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_reason(line: Column, line_words: Column, phrases: Column, rules: QualityRules) -> Column:
    """Name of the first rule the line fails, or null; ``phrases``: whether the text may hold any phrase of boilerplate."""
    n_words = F.size(line_words)
    solid = F.length(F.array_join(line_words, ""))
    # Counted only where there is something to count; the cheap tests come first.
    separators = _count(line, r"(?<![^\x20\x09-\x0D])[|»›•·]+(?![^\x20\x09-\x0D])")
    symbols = _count(line, r"[#*$%&|<>~^{}]")
    shouts = F.when(line.contains("!!"), _count(line, r"!!(?![^\x20\x09-\x0D])")).otherwise(0)
    phrase = "(?i)" + r"(?<![\p{L}\p{N}])(?:" + "|".join(BOILERPLATE) + r")(?![\p{L}\p{N}])"
    marked = (
        F.when((separators > 0) & (n_words - separators <= separators * rules.words_per_separator), "navigation")
        .when((symbols > 0) & (symbols > solid * rules.max_symbol_share), "punctuation")
        .when((shouts > 1) & (shouts > n_words * rules.max_shout_share), "punctuation")
    )
    unmarked = "[" + "".join(rf"\p{{Is{s}}}" for s in UNMARKED_SCRIPTS) + "]"
    # Most lines hold a common mark, which a small class finds sooner.
    bare = (n_words >= rules.unpunctuated_words) & ~line.rlike(r"[.!?:;,]") & ~line.rlike(f"[{SENTENCE_MARKS}]")
    plain = F.when(bare & ~line.rlike(unmarked), "punctuation").when(
        phrases & (n_words <= rules.boilerplate_words) & line.rlike(phrase), "boilerplate"
    )
    return F.coalesce(F.when(line.rlike(r"[|»›•·#*$%&<>~^{}]|!!"), marked), plain)


def _parsed(text: str) -> Column:
    """The lines of a text, each with its words: a line end is white space, so the words are those of the text."""
    return F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("w")))


def _total(parsed: str, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(parsed, F.lit(0).cast("long"), lambda a, x: a + of(x))


def _base(parsed: str, text: str) -> dict[str, Column]:
    def hashed(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def ordered(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return F.array_sort(F.array_compact(F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["p"]))))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    # Windows are only sorted where some hash occurs again.
    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(ordered(h), lambda s: _let(repeated(s), covered)))
    n_repeat_words = _let(F.flatten(F.transform(parsed, lambda x: x["w"])), lambda w: _let(hashed(w), counted))
    lines = F.transform(F.filter(parsed, lambda x: F.size(x["w"]) > 0), lambda x: x["line"])
    return {
        "n_words": _total(parsed, lambda x: F.size(x["w"])),
        "word_chars": _total(parsed, lambda x: F.length(F.array_join(x["w"], ""))),
        "n_symbols": F.regexp_count(text_or_empty(text), F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words.cast("long"),
    }


def _without(df: DataFrame, text: str, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names and c.lower() != text.lower()])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "kept", "clean_text", "n_lines", "n_removed_lines", "removed_words")


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated three-word windows are found per text by sorting (hash, position)
    pairs and comparing neighbours, n log n in the words of one text.
    """
    df = _without(df, text, *BASE)
    (parsed,) = free_names(df, "parsed")
    return df.withColumn(parsed, _parsed(text)).withColumns(_base(parsed, text)).drop(parsed)


def apply_quality_rules(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """Add the base statistics, base_failed, kept, clean_text, n_lines, n_removed_lines and removed_words."""
    df = _without(df, text, *ADDED)
    parsed, judged = free_names(df, "parsed", "judged")
    low = F.lower(text_or_empty(text))
    some_phrase = _let(low, lambda t: reduce(lambda a, b: a | b, [t.contains(p) for p in BOILERPLATE]))
    df = df.withColumn(parsed, _parsed(text))
    # Bound, as an inlined test would be made for each line.
    reasons = _let(
        some_phrase,
        lambda some: F.transform(
            parsed, lambda x: F.struct(x["line"].alias("line"), F.size(x["w"]).alias("n"), line_reason(x["line"], x["w"], some, rules).alias("reason"))
        ),
    )
    df = df.withColumns({**_base(parsed, text), judged: reasons})
    bad = F.filter(judged, lambda x: x["reason"].isNotNull())
    good = F.filter(judged, lambda x: x["reason"].isNull())
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < rules.min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent),
            "n_lines": F.size(F.filter(judged, lambda x: x["n"] > 0)).cast("long"),
            "n_removed_lines": F.size(bad).cast("long"),
            "removed_words": F.aggregate(bad, F.lit(0), lambda a, x: a + x["n"]).cast("long"),
            "clean_text": F.array_join(F.transform(good, lambda x: x["line"]), "\n"),
        }
    ).drop(parsed, judged)
    # A filter on kept is pushed below the projections and judges every text twice; keep_clean() holds it back.
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= F.col("n_words") * rules.max_loss))


def keep_clean(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The kept rows of ``df`` with their failing lines removed; n_chars, if there, follows the text."""
    body, kept, row = free_names(df, "body", "kept", "row")
    others = [c for c in df.columns if c.lower() != text.lower()]
    # Columns named as the results are carried as one struct, so that they come back as they were.
    (carried,) = free_names(df, "carried")
    narrow = df.select(F.struct(*others, F.lit(0).alias(row)).alias(carried), F.col(text).alias(body))
    judged = apply_quality_rules(narrow, rules, body)
    # A projection with a row number isn't passed by filters that need it.
    numbered = judged.select(carried, "clean_text", F.col("kept").alias(kept), F.monotonically_increasing_id().alias(row))
    passed = numbered.where(F.col(kept) & (F.col(row) >= 0))
    columns = {c: F.col(carried)[c] for c in others} | {text: F.col("clean_text")}
    if "n_chars" in others:
        columns["n_chars"] = F.length("clean_text").cast("long")
    return passed.select(*[columns[text if c.lower() == text.lower() else c].alias(c) for c in df.columns])
