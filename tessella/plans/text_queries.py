"""Queries over texts: normalisation, terms, sentences, chunks, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import articles, intent, scoring
from ..functions import constants as C
from ..functions import text as X
from ..operators import chunking, cleaning
from ..operators.facts import clip, top_fact_chunks
from ..sources.readers import table
from ..tables import once
from .registry import any_of, phrases_of, query, quoted


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


MATCH = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
SPACE1 = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"


@query(
    "normalize_text",
    r"""SELECT doc_id, sha1(n) AS digest, length(n) AS n FROM (
      SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g'), '\s+', ' ', 'g')) AS n FROM documents)""",
)
def normalize_text(spark, sf_dir):
    """F1."""
    return documents(spark, sf_dir).withColumn("_n", X.normalize_text("text")).select("doc_id", F.sha1("_n").alias("digest"), F.length("_n").cast("long").alias("n"))


@query(
    "ocr_normalize",
    r"""SELECT doc_id, sha1(n) AS digest FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS n FROM documents)""",
)
def ocr_normalize(spark, sf_dir):
    """F2."""
    return documents(spark, sf_dir).select("doc_id", F.sha1(X.normalize_ocr_text("text")).alias("digest"))


@query("match_text", f"SELECT doc_id, sha1({MATCH}) AS digest FROM documents")
def match_text(spark, sf_dir):
    """F3."""
    return documents(spark, sf_dir).select("doc_id", F.sha1(X.match_text("text")).alias("digest"))


@query(
    "lang_hint",
    "SELECT lang, hint, count(*) AS n FROM (SELECT lang, CASE WHEN regexp_matches(text, '[ก-๛]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' "
    "WHEN regexp_matches(text, '[ก-๛]') THEN 'th' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS hint FROM documents) GROUP BY ALL",
)
def lang_hint(spark, sf_dir):
    """F4, F5."""
    return documents(spark, sf_dir).groupBy("lang", X.language_hint("text").alias("hint")).agg(F.count("*").alias("n"))


@query(
    "search_terms",
    rf"""SELECT doc_id, len(t) AS n_terms, sha1(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
      lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), lambda x: NOT list_contains([{quoted(C.SEARCH_STOPWORDS)}], x)) AS t
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_\x{{0E00}}-\x{{0E7F}}]{{2,}}') AS w FROM documents))""",
)
def search_terms(spark, sf_dir):
    """F6, D11."""
    t = X.search_terms("text")
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_terms"), F.sha1(F.array_join("t", " ")).alias("digest"))


@query(
    "eval_tokens",
    rf"SELECT doc_id, len(list_distinct(regexp_extract_all({MATCH}, '[\p{{L}}\p{{N}}_ก-๙]{{2,}}'))) AS n FROM documents",
)
def eval_tokens(spark, sf_dir):
    """F7."""
    return documents(spark, sf_dir).select("doc_id", F.size(X.eval_tokens("text")).cast("long").alias("n"))


SENTENCES = r"regexp_split_to_array(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')"
SENTENCE_ROWS = f"""sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, s FROM (
    SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, trim(unnest(p)) AS s FROM (SELECT doc_id, {SENTENCES} AS p FROM documents)) WHERE s <> '')"""


@query("sentence_split", f"WITH {SENTENCE_ROWS} SELECT doc_id, i AS sentence_index, s AS sentence FROM sent")
def sentence_split(spark, sf_dir):
    """G1, W1."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.sentences("text")).alias("p", "sentence"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("sentence_index"), "sentence")


@query(
    "sentence_split_marks",
    r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?ฯๆ])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents""",
)
def sentence_split_marks(spark, sf_dir):
    """G2."""
    return documents(spark, sf_dir).select("doc_id", F.size(chunking.sentences_with_thai("text")).cast("long").alias("n"))


@query(
    "fallback_chunks",
    f"""WITH RECURSIVE {SENTENCE_ROWS}, norm AS (SELECT doc_id, i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM sent),
    packed AS (
      SELECT doc_id, i, length(s) AS size, 1 AS chunk FROM norm WHERE i = 1
      UNION ALL
      SELECT n.doc_id, n.i, CASE WHEN p.size + 1 + length(n.s) <= {C.CHUNK_CHARS} THEN p.size + 1 + length(n.s) ELSE length(n.s) END,
        CASE WHEN p.size + 1 + length(n.s) <= {C.CHUNK_CHARS} THEN p.chunk ELSE p.chunk + 1 END
      FROM packed p JOIN norm n ON n.doc_id = p.doc_id AND n.i = p.i + 1
    ), chunks AS (
      SELECT doc_id, chunk, string_agg(s, ' ' ORDER BY i) AS t FROM packed JOIN norm USING (doc_id, i) GROUP BY ALL
    ), merged AS (
      SELECT doc_id, chunk, t, sum(CASE WHEN chunk = 1 OR length(t) >= {C.MIN_CHUNK_CHARS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk) AS g FROM chunks
    ) SELECT doc_id, g::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total, string_agg(t, ' ' ORDER BY chunk) AS text FROM merged GROUP BY doc_id, g""",
)
def fallback_chunks(spark, sf_dir):
    """G5, W4, W1."""
    df = documents(spark, sf_dir).withColumn("chunks", chunking.fallback_chunks("text"))
    return chunking.explode_chunks(df).withColumn("chunk_total", F.col("chunk_total").cast("long"))


@query(
    "chunk_text",
    rf"""WITH RECURSIVE norm AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x9f]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
    parts AS (SELECT doc_id, t, CASE WHEN length(t) <= {C.CHUNK_CHARS} THEN [t] ELSE list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?ฯๆ])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(x)), lambda x: x <> '') END AS p FROM norm WHERE t <> ''),
    sent AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM parts),
    packed AS (
      SELECT doc_id, i, 1 AS chunk, length(s) AS size FROM sent WHERE i = 1
      UNION ALL
      SELECT n.doc_id, n.i, CASE WHEN p.size <= {C.CHUNK_CHARS} AND p.size + 1 + length(n.s) <= {C.CHUNK_CHARS} THEN p.chunk ELSE p.chunk + 1 END,
        CASE WHEN p.size <= {C.CHUNK_CHARS} AND p.size + 1 + length(n.s) <= {C.CHUNK_CHARS} THEN p.size + 1 + length(n.s) ELSE length(n.s) END
      FROM packed p JOIN sent n ON n.doc_id = p.doc_id AND n.i = p.i + 1
    ), joined AS (SELECT doc_id, chunk, string_agg(s, ' ' ORDER BY i) AS c FROM packed JOIN sent USING (doc_id, i) GROUP BY ALL),
    cut AS (SELECT doc_id, chunk, k, trim(substring(c, k * {C.CHUNK_CHARS} + 1, {C.CHUNK_CHARS})) AS c FROM (SELECT doc_id, chunk, c, unnest(range(0, greatest(ceil(length(c) / {C.CHUNK_CHARS}.0), 1)::INT)) AS k FROM joined)),
    numbered AS (SELECT doc_id, row_number() OVER w AS i, lag(c) OVER w AS before, c FROM cut WHERE c <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY chunk, k))
    SELECT doc_id, i::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_total, CASE WHEN before IS NULL THEN c ELSE trim(right(before, {C.CHUNK_OVERLAP}) || chr(10) || c) END AS text FROM numbered""",
)
def chunk_text(spark, sf_dir):
    """G3, G4, W5, W1. Packing with overlap."""
    return chunking.explode_chunks(chunking.chunk_text(documents(spark, sf_dir)))


@query(
    "char_split",
    """SELECT doc_id, i + 1 AS chunk_index, regexp_replace(regexp_replace(substring(text, i * 800 + 1, 1000), '^\\s+', ''), '\\s+$', '') AS chunk FROM (
      SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE greatest(ceil((length(text) - 200) / 800.0), 1)::INT END)) AS i
      FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM documents)) WHERE trim(substring(text, i * 800 + 1, 1000)) <> ''""",
)
def char_split(spark, sf_dir):
    """G7 with a width that the test texts exceed."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.char_split("text", 1000, 200)).alias("p", "chunk"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("chunk_index"), "chunk")


def blocks(array, size):
    """An array's items in arrays of ``size``, the last one shorter: section numbers have two digits at most, and begin anew in each."""
    return X.let(array, lambda a: F.transform(F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: (i % size == 0) & (i < F.size(a))), lambda i: F.slice(a, i + 1, size)))


NUMBERED = "array_to_string(list_transform(list_zip(l, range(1, len(l) + 1)), lambda x: x[2] || '. ' || x[1]), chr(10))"


@query(
    "numbered_sections",
    r"""SELECT doc_id, x[2] AS number, trim(x[1]) AS title FROM (SELECT doc_id, unnest(list_zip(l, range(1, len(l) + 1))) AS x FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents)) WHERE length(trim(x[1])) <= 180""",
)
def numbered_sections(spark, sf_dir):
    """G8, G10, P25. The lines of a text, numbered up to 99 in each block, split into their sections again.

    Numbers go on through the blocks.
    """
    solid = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda s: s != "")
    df = documents(spark, sf_dir).select("doc_id", F.posexplode(blocks(solid, 99)).alias("_b", "_l"))
    numbered = df.withColumn("text", F.array_join(F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))
    rows = numbered.select("doc_id", "_b", F.explode(chunking.numbered_sections("text")).alias("s"))
    out = rows.select("doc_id", (F.col("_b") * 99 + chunking.section_order(F.col("s"))).cast("long").alias("number"), chunking.section_title(F.col("s")).alias("title"))
    return out.where("title IS NOT NULL")


@query(
    "menu_lines",
    r"""SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda s: regexp_matches(s, '\d') OR regexp_matches(s, '[.:–()%-]') OR NOT (length(s) <= 40 AND len(regexp_split_to_array(s, '\s+')) <= 6))) AS n_kept
      FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents)""",
)
def menu_lines(spark, sf_dir):
    """P7, P8."""
    solid = F.filter(cleaning.lines("text"), lambda s: s != "")
    kept = F.filter(F.split(cleaning.clean_web_text("text"), "\n"), lambda s: s != "")
    return documents(spark, sf_dir).select("doc_id", F.size(solid).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"))


@query(
    "boilerplate_lines",
    r"""WITH lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, trim(unnest(l)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    kept AS (SELECT doc_id, i, s, lower(regexp_replace(s, '\s+', ' ', 'g')) AS k, regexp_split_to_array(s, '\s+') AS w FROM lines WHERE length(s) >= 8
      AND NOT regexp_matches(s, '(?i)\b(cookie|consent|privacy|terms|subscribe|newsletter|share|follow us|log in|login|sign in|register|advert|advertisement|sponsor)\b')),
    plain AS (SELECT * FROM kept WHERE NOT (len(w) >= 6 AND len(list_filter(w, lambda x: length(x) <= 4)) / len(w) > 0.65)),
    firsts AS (SELECT * FROM plain QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1)
    SELECT d.doc_id, coalesce(string_agg(s, chr(10) ORDER BY i), '') AS text FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id GROUP BY d.doc_id""",
)
def boilerplate_lines(spark, sf_dir):
    """P9, D6."""
    return documents(spark, sf_dir).select("doc_id", cleaning.drop_boilerplate_lines("text").alias("text"))


@query(
    "visible_text",
    r"""WITH lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, trim(unnest(l)) AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '[^\S\n]+', ' ', 'g'), chr(10)) AS l FROM documents)),
    firsts AS (SELECT * FROM lines WHERE length(s) >= 10 QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY i) = 1)
    SELECT d.doc_id, sha1(coalesce(string_agg(s, chr(10) ORDER BY i), '')) AS digest FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id GROUP BY d.doc_id""",
)
def visible_text(spark, sf_dir):
    """P10, D6."""
    return documents(spark, sf_dir).select("doc_id", F.sha1(cleaning.normalize_visible_text("text")).alias("digest"))


@query(
    "text_flags",
    rf"""SELECT doc_id, ({any_of("lower(text)", C.BLOCK_KEYWORDS)} OR length(trim(lower(text))) < 250) AS blocked,
      {any_of(MATCH, C.BOILERPLATE_SIGNALS)} AS boilerplate, left(text, 360) AS preview,
      CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short FROM documents""",
)
def text_flags(spark, sf_dir):
    """P6, P11, P12."""
    return documents(spark, sf_dir).select(
        "doc_id",
        X.is_probably_blocked("text").alias("blocked"),
        cleaning.is_boilerplate_chunk("text").alias("boilerplate"),
        X.preview("text", 360).alias("preview"),
        X.preview("text", 100, True).alias("short"),
    )


@query(
    "url_flags",
    f"""SELECT page_id, {any_of("lower(url)", C.FILE_URL_WORDS)} AS file_url, NOT {any_of("lower(url)", C.IGNORED_IMAGES)} AS good_image,
      split_part(url, '#', 1) AS plain FROM pages""",
)
def url_flags(spark, sf_dir):
    """P13, P14, D9."""
    return table(spark, sf_dir, "pages").select(
        "page_id", cleaning.looks_like_file_url("url").alias("file_url"), cleaning.is_good_image_url("url").alias("good_image"), F.substring_index("url", "#", 1).alias("plain")
    )


FACT_SCORE = (
    r"least(length(text), 2000) / 2000.0 * 2.0 + len(regexp_extract_all(s, '\d')) * 0.15 + len(regexp_extract_all(s, '%|เปอร์เซ็นต์|ร้อยละ')) * 2.0"
    r" + len(regexp_extract_all(s, 'บาท|ล้าน|พันล้าน|million|billion|usd|thb')) * 1.5 + len(regexp_extract_all(s, '\b20\d{2}\b|ปี\s*20\d{2}|พ\.ศ\.\s*\d{4}')) * 2.0 + ("
    + " + ".join(f"contains(s, '{k}')::INT" for k in C.FACT_KEYWORDS)
    + ") * 1.2"
)


@query("fact_chunk_score", f"SELECT doc_id, round({FACT_SCORE}, 6) AS score FROM (SELECT doc_id, text, lower(text) AS s FROM documents)")
def fact_chunk_score(spark, sf_dir):
    """F13, A13, A14."""
    return documents(spark, sf_dir).select("doc_id", F.round(scoring.fact_chunk_score("text"), 6).alias("score"))


@query(
    "fact_top_chunks",
    rf"""SELECT source, doc_id, rank, round(score, 6) AS score, sha1(CASE WHEN length(text) <= {C.FACT_CHARS} THEN text ELSE regexp_replace(left(text, {C.FACT_CHARS}), '\s+$', '') END) AS clipped FROM (
      SELECT source, doc_id, text, score, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM (SELECT source, doc_id, text, {FACT_SCORE} AS score FROM (SELECT source, doc_id, text, lower(text) AS s FROM (
        SELECT source, doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM documents)) WHERE length(text) >= {C.FACT_MIN_CHARS}))
      WHERE rank <= {C.FACT_CHUNKS}""",
)
def fact_top_chunks(spark, sf_dir):
    """O10, P18, F14."""
    top = top_fact_chunks(documents(spark, sf_dir), "source", "doc_id")
    return top.select("source", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("fact_score", 6).alias("score"), F.sha1(clip("text")).alias("clipped"))


KEY_CASES = " ".join(f"WHEN {any_of('q', words)} THEN '{key}'" for key, words in C.KEY_WORDS)


@query(
    "route_questions",
    f"""SELECT conv_id, turn, CASE WHEN {any_of('q', C.STRUCTURED_SIGNALS)} THEN 'structured_rag' ELSE 'semantic_rag' END AS route,
      CASE WHEN {any_of('text', C.LIST_WORDS)} AND {any_of('q', C.TREND_WORDS)} THEN 'numbered_section_title' {KEY_CASES} ELSE '' END AS fact_key,
      {any_of('text', C.NUMERIC_WORDS)} OR regexp_matches(text, '\\b20\\d{{2}}\\b') AS wants_number,
      {any_of('text', C.SINGLE_ARTICLE_WORDS)} AS single_article
      FROM (SELECT conv_id, turn, text, lower(text) AS q FROM conversations WHERE role = 'user')""",
)
def route_questions(spark, sf_dir):
    """F17, F18, P28, C1."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select(
        "conv_id",
        "turn",
        intent.route("text").alias("route"),
        intent.fact_key("text").alias("fact_key"),
        intent.wants_number("text").alias("wants_number"),
        intent.prefers_single_article("text").alias("single_article"),
    )


FIVE_OR_EIGHT = "(contains(low, '{}') OR contains(q, '{}')) AND trend"


@query(
    "query_phrases",
    f"""WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS q, lower(coalesce(text, '')) AS low FROM conversations WHERE role = 'user'),
    p AS (SELECT *, contains(q, '{C.TREND_WORDS[0]}') OR contains(low, '{C.TREND_WORDS[1]}') AS trend, {phrases_of("q")} AS l FROM u)
    SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS phrases,
      CASE WHEN {FIVE_OR_EIGHT.format("5", "ห้า")} AND (contains(low, 'sme') OR contains(q, 'เอสเอ็มอี')) THEN 'ttbbank.com' WHEN contains(low, 'ttb') OR contains(low, 'finbiz') THEN 'ttbbank.com'
        WHEN {FIVE_OR_EIGHT.format("8", "แปด")} THEN 'marketingoops.com' ELSE '' END AS domain,
      coalesce(try_cast(regexp_extract(q, '(?i)(\\d{{1,2}})\\s*(?:เทรนด์|trends?)', 1) AS INT), 0) AS count FROM p""",
)
def query_phrases(spark, sf_dir):
    """F20, J9, F19, F25."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", intent.query_phrases("text").alias("phrases"), intent.preferred_domain("text").alias("domain"), intent.requested_list_count("text").alias("count"))


@query(
    "image_types",
    "SELECT t AS image_type, count(*) AS n, count(*) FILTER (t IN ('chart', 'table', 'document', 'infographic')) AS kept FROM (SELECT CASE "
    + " ".join(f"WHEN {any_of('s', words)} THEN '{name}'" for name, words in C.IMAGE_TYPES)
    + " ELSE 'other' END AS t FROM (SELECT lower(p_type || ' ' || p_name) AS s FROM part)) GROUP BY ALL",
)
def image_types(spark, sf_dir):
    """F12, P15, over captions made of part names."""
    kind = scoring.image_type(F.concat_ws(" ", "p_type", "p_name"))
    rows = table(spark, sf_dir, "part").select(kind.alias("image_type"))
    return rows.groupBy("image_type").agg(F.count("*").alias("n"), F.count_if(scoring.keep_image(F.lit(0.0), F.col("image_type"))).alias("kept"))


def last_place(marker: str) -> str:
    """SQL: characters before the last occurrence in h, or -1."""
    return f"CASE WHEN contains(h, '{marker}') THEN length(h) - strpos(reverse(h), reverse('{marker}')) - length('{marker}') + 1 ELSE -1 END"


@query(
    "truncate_text",
    f"""SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(left(t, CASE WHEN cut >= 121 THEN cut WHEN space >= 121 THEN space ELSE 220 END), '[ ,;:]+$', '') END AS text
      FROM (SELECT doc_id, t, greatest({", ".join(last_place(m) for m in articles.BOUNDARIES)}) AS cut, {last_place(" ")} AS space
        FROM (SELECT doc_id, t, left(t, 220) AS h FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)))""",
)
def truncate_text(spark, sf_dir):
    """F27."""
    return documents(spark, sf_dir).select("doc_id", articles.truncate_at_boundary("text", 220).alias("text"))


@query("trend_profiles")
def trend_profiles(spark, sf_dir):
    """G9, G15, F26, F28, F30, F31 over the lines of texts, numbered anew in blocks of nine; orders go on. Tested on articles."""
    solid = F.filter(F.split("text", "\n"), lambda s: s != "")
    df = documents(spark, sf_dir).select("doc_id", F.posexplode(blocks(solid, 9)).alias("_b", "_l"))
    numbered = F.array_join(F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), " ")
    rows = once(df.select("doc_id", "_b", F.explode(chunking.inline_sections(numbered)).alias("s")), p=articles.profile(F.col("s"))).where("p IS NOT NULL")
    return rows.select("doc_id", (F.col("_b") * 9 + F.col("p.order")).cast("int").alias("order"), "p.title", "p.lead", "p.actions", "p.stats", "p.sources", F.col("p.body").alias("raw"))
