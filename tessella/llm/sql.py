"""DuckDB SQL of the queries that SQL can express, over the registered views."""

from __future__ import annotations

from .decontaminate import AGREEMENT, SPAN
from .embedding_dedup import THRESHOLD as COSINE
from .jaccard_join import THRESHOLD
from .license_scan import TEMPLATES, bigrams_of, decisive_bigrams, excluding_bigrams
from .quality_rules import BOILERPLATE, SENTENCE_MARKS, UNMARKED_SCRIPTS, QualityRules
from .spelling_variants import MIN_COUNT, MIN_LENGTH, RATIO, TYPO_RATE
from .suffix_dedup import MIN_WORDS
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_SPACE = r"[\x20\x09-\x0D]+"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '{_SPACE}'), lambda w: w <> '')"


def quality_rules_sql(source: str = "documents") -> str:
    r = QualityRules()
    phrases = "|".join(BOILERPLATE)
    n_words = rf"len({_words('line')})"
    unmarked = "".join(rf"\p{{{s}}}" for s in UNMARKED_SCRIPTS)
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM {source}
), worded AS (
  SELECT *, {_words("text")} AS w, regexp_split_to_array(text, '\n') AS l FROM base
), grams AS (
  SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT uid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM worded)
), found AS (
  SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS n FROM grams) WHERE n > 1
), repeated AS (
  SELECT uid, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words
  FROM (SELECT uid, i, lead(i) OVER (PARTITION BY uid ORDER BY i) AS nxt FROM found) GROUP BY uid
), lines AS (
  SELECT uid, unnest(l) AS line FROM worded
), counted AS (
  SELECT uid, line, {n_words} AS n,
    len(regexp_replace(line, '{_SPACE}', '', 'g')) AS solid,
    len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: regexp_full_match(x, '[|»›•·]+'))) AS separators,
    len(regexp_extract_all(line, '[#*$%&|<>~^{{}}]')) AS symbols,
    len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x LIKE '%!!')) AS shouts
  FROM lines
), judged AS (
  SELECT uid, n, (
      (separators > 0 AND n - separators <= separators * {r.words_per_separator})
      OR symbols > solid * {r.max_symbol_share}
      OR (shouts > 1 AND shouts > n * {r.max_shout_share})
      OR (n >= {r.unpunctuated_words} AND NOT regexp_matches(line, '[{SENTENCE_MARKS}]') AND NOT regexp_matches(line, '[{unmarked}]'))
      OR (n <= {r.boilerplate_words} AND regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}])({phrases})($|[^\p{{L}}\p{{N}}])'))
    ) AS bad
  FROM counted
), by_line AS (
  SELECT uid, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (bad) AS n_removed_lines,
    coalesce(sum(n) FILTER (bad), 0) AS removed_words
  FROM judged GROUP BY uid
), statistics AS (
  SELECT d.uid, doc_id, len(w) AS n_words,
    len(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) -
      len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM worded d LEFT JOIN repeated r ON d.uid = r.uid
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words) AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words)
    AND removed_words <= n_words * {r.max_loss} AS kept,
  n_lines::BIGINT AS n_lines, n_removed_lines::BIGINT AS n_removed_lines, removed_words::BIGINT AS removed_words
FROM statistics JOIN by_line USING (uid)
"""


def license_scan_sql(threshold: float = 0.8) -> str:
    """All windows of each template's bigrams, rated, and of those that overlap the best."""
    lists = lambda text: ", ".join(f"{[*map(str, f(text))]}::VARCHAR[]" for f in (bigrams_of, decisive_bigrams, excluding_bigrams))
    values = ", ".join(f"({i}, '{name}', {lists(text)})" for i, (name, text) in enumerate(TEMPLATES))
    bound = threshold / (2 - threshold)
    return rf"""
WITH templates(tid, id, b, must, never) AS (VALUES {values}),
docs AS (
  SELECT row_number() OVER () AS uid, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents
), paired AS (SELECT uid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM docs),
places AS (
  SELECT DISTINCT uid, tid, i FROM (SELECT uid, unnest(range(0, len(pairs))) AS i, unnest(pairs) AS b FROM paired) JOIN (SELECT tid, unnest(b) AS b FROM templates) USING (b)
), flagged AS (
  SELECT *, coalesce(lag(i) OVER (PARTITION BY uid, tid ORDER BY i) < i - 1, true) AS begins, coalesce(lead(i) OVER (PARTITION BY uid, tid ORDER BY i) > i + 1, true) AS ends FROM places
), spans AS (
  SELECT x.uid, x.tid, x.i AS a, y.i AS z FROM flagged x JOIN flagged y ON x.uid = y.uid AND x.tid = y.tid AND x.begins AND y.ends AND y.i >= x.i
), windows AS (
  SELECT uid, id, a, z, t.b, must, never, list_distinct(pairs[a + 1:z + 1]) AS p, pairs[greatest(a, 1):z + 2] AS around
  FROM spans JOIN templates t USING (tid) JOIN paired USING (uid)
  WHERE z < a + 2 * ceil(len(t.b) / {bound!r}::DOUBLE) AND z - a + 1 >= len(t.b) * {bound!r}::DOUBLE - 1e-9
), rated AS (
  SELECT uid, id, a, z, 2.0::DOUBLE * len(list_intersect(p, b)) / (len(p) + len(b)) AS dice FROM windows
  WHERE len(list_intersect(p, must)) = len(must) AND len(list_intersect(around, never)) = 0
), ordered AS (
  SELECT uid, list([{{'id': id, 'a': a, 'z': z, 'dice': dice}}] ORDER BY contains(id, ','), dice DESC, a - z, id, a, z) AS all_
  FROM (SELECT DISTINCT * FROM rated WHERE dice >= {threshold}) GROUP BY uid
), kept AS (
  SELECT uid, unnest(list_reduce(all_, lambda acc, m: CASE WHEN len(list_filter(acc, lambda k: m[1].a <= k.z AND k.a <= m[1].z)) > 0 THEN acc ELSE acc || m END)) AS m FROM ordered
), by_doc AS (
  SELECT uid, array_to_string(list_sort(list_distinct(flatten(list(string_split(m.id, ','))))), ',') AS licenses, min(m.id) FILTER (m.dice = top) AS best_license, max(m.dice) AS best_dice
  FROM (SELECT *, max(m.dice) OVER (PARTITION BY uid) AS top FROM kept) GROUP BY uid
)
SELECT doc_id, coalesce(licenses, '') AS licenses, best_license, round(best_dice, 6) AS best_dice
FROM docs LEFT JOIN by_doc USING (uid)
"""


def sharding_sql(n: int = 8, slack: float = 0.1) -> str:
    """CRC-32 byte by byte, sums in the order of (key, id), cuts, and small groups whole."""
    at = lambda x: f"least(floor({x} * {n} / total), {n - 1})::INT"
    return rf"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)
), d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM d),
keyed AS (
  SELECT uid, doc_id, len(b) + 1 AS size, xor(list_reduce(b, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, ('0x' || substr(md5(text), 1, 15))::BIGINT AS k
  FROM bytes, crc
), summed AS (
  SELECT *, sum(size) OVER w - size AS prefix, row_number() OVER w AS place, sum(size) OVER () AS total FROM keyed WINDOW w AS (ORDER BY k, doc_id NULLS FIRST, size, uid)
), cut AS (SELECT *, {at("prefix")} AS s FROM summed),
grouped AS (SELECT *, min(s) OVER g AS lo, max(s) OVER g AS hi, min(prefix) OVER g AS first, sum(size) OVER g AS group_size FROM cut WINDOW g AS (PARTITION BY k)),
placed AS (SELECT *, CASE WHEN lo < hi AND group_size <= {slack} * total / {n} THEN {at("(first + group_size / 2)")} ELSE s END AS shard FROM grouped)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM placed
"""


def suffix_dedup_sql(n: int = MIN_WORDS) -> str:
    """All windows of n words, counted; the union of those that occur twice."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT uid, s, hash(array_to_string(w[s + 1:s + {n}], ' ')) AS h FROM (SELECT uid, w, unnest(range(0, len(w) - {n - 1})) AS s FROM d WHERE len(w) >= {n})
), hits AS (
  SELECT uid, s FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), opened AS (
  SELECT uid, s, CASE WHEN s - lag(s) OVER (PARTITION BY uid ORDER BY s) <= {n} THEN 0 ELSE 1 END AS opens FROM hits
), islands AS (
  SELECT uid, s, sum(opens) OVER (PARTITION BY uid ORDER BY s) AS island FROM opened
)
SELECT doc_id, min(s)::INT AS start, (max(s) + {n})::INT AS "end", any_value(len(w))::INT AS n_words
FROM islands JOIN d USING (uid) GROUP BY uid, doc_id, island
"""


def jaccard_join_sql(threshold: float = THRESHOLD) -> str:
    """All pairs that share a shingle, and the closure of the links."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
sets AS (
  SELECT uid, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), grams AS (SELECT uid, unnest(g) AS x FROM sets),
shared AS (SELECT a.uid AS a, b.uid AS b, count(*) AS n FROM grams a JOIN grams b ON a.x = b.x AND a.uid <> b.uid GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets p ON p.uid = a JOIN sets q ON q.uid = b WHERE n >= {threshold} * (len(p.g) + len(q.g) - n) - 1e-9
), reach(a, b) AS (
  SELECT uid, uid FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), classes AS (SELECT r.a AS uid, min(doc_id) AS class_id FROM reach r JOIN d ON d.uid = r.b GROUP BY r.a)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = d.uid) AS n_links FROM d JOIN classes USING (uid)
"""


def decontamination_sql() -> str:
    """All alignments of texts and items with words enough in common, and their best windows; words without case and punctuation."""
    folded = rf"regexp_replace(lower(x), '[\p{{P}}\p{{Cf}}]', '', 'g')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_words("coalesce(text, '')")} AS w FROM benchmark),
draw AS (SELECT uid, p, {folded} AS x FROM (SELECT uid, unnest(range(0, len(w))) AS p, unnest(w) AS x FROM d)),
dw AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY p) - 1 AS q, p, x FROM draw WHERE x <> ''),
dn AS (SELECT uid, count(*) AS n FROM dw GROUP BY uid),
iraw AS (SELECT iid, p, {folded} AS x FROM (SELECT iid, unnest(range(0, len(w))) AS p, unnest(w) AS x FROM i)),
iw AS (SELECT iid, row_number() OVER (PARTITION BY iid ORDER BY p) - 1 AS q, x FROM iraw WHERE x <> ''),
sized AS (SELECT iid, count(*) AS n, least({SPAN}, count(*)) AS need, ceil({AGREEMENT} * least({SPAN}, count(*)) - 1e-9) AS least_agree FROM iw GROUP BY iid),
equal AS (SELECT uid, iid, dw.q AS q, dw.q - iw.q AS shift FROM dw JOIN iw USING (x)),
aligned AS (
  SELECT uid, iid, shift, greatest(0, shift) AS first, least(dn.n, shift + s.n) AS stop, need, least_agree
  FROM (SELECT uid, iid, shift, count(*) AS c FROM equal GROUP BY ALL) JOIN sized s USING (iid) JOIN dn USING (uid) WHERE c >= least_agree
), starts AS (SELECT *, unnest(range(first, stop - need + 1)) AS start FROM aligned WHERE stop - first >= need),
counted AS (
  SELECT t.uid, t.iid, t.start, t.need, count(*) AS agree FROM starts t JOIN equal e ON e.uid = t.uid AND e.iid = t.iid AND e.shift = t.shift AND e.q >= t.start AND e.q < t.start + t.need
  GROUP BY t.uid, t.iid, t.shift, t.start, t.need, t.least_agree HAVING count(*) >= t.least_agree
), best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY uid, iid ORDER BY agree DESC, start) = 1)
SELECT doc_id, item_id, a.p AS start, z.p + 1 AS "end", agree
FROM best b JOIN d USING (uid) JOIN i USING (iid) JOIN dw a ON a.uid = b.uid AND a.q = b.start JOIN dw z ON z.uid = b.uid AND z.q = b.start + b.need - 1
"""


_WHOLE = "len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def vector_codes_sql() -> str:
    """Every distance of every round; sums are exact, as they stay below 2^53."""
    squared = "list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y)"
    rounds = ""
    for i in range(ROUNDS + 1):
        rounds += f"""
, a{i} AS (
  SELECT uid, p, e, {squared} AS d, x FROM parts JOIN b{i} USING (p) QUALIFY row_number() OVER (PARTITION BY uid, p ORDER BY d, e) = 1
)"""
        if i < ROUNDS:
            rounds += f""", m{i} AS (
  SELECT p, e, list(floor(s / n) ORDER BY k) AS y FROM (SELECT p, e, k, sum(c) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS k FROM a{i}) GROUP BY ALL) GROUP BY ALL
), b{i + 1} AS (SELECT p, e, coalesce(m{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN m{i} USING (p, e))"""
    return rf"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS uid, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM embeddings WHERE {_WHOLE}
), parts AS (
  SELECT uid, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p)
), b0 AS (SELECT p, uid AS e, x AS y FROM parts WHERE uid < {ENTRIES}){rounds},
books AS (SELECT sha256(string_agg(c::BIGINT, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, unnest(y) AS c, unnest(range(len(y))) AS k FROM b{ROUNDS})),
coded AS (SELECT uid, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY uid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (uid), books
"""


def embedding_dedup_sql(threshold: float = COSINE) -> str:
    """All pairs of a label, and the closure of the links."""
    return rf"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS uid, vec_id, label, embedding::DOUBLE[] AS x, label IS NOT NULL AND {_WHOLE} AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS good FROM embeddings
), links AS (
  SELECT a.uid AS a, b.uid AS b FROM v a JOIN v b ON a.label = b.label AND a.uid <> b.uid
  WHERE a.good AND b.good AND CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= {threshold} ELSE false END
), reach(a, b) AS (
  SELECT uid, uid FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (SELECT r.a AS uid, min(vec_id) AS component_id FROM reach r JOIN v ON v.uid = r.b GROUP BY r.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = v.uid) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN components USING (uid)
"""


def spelling_variants_sql() -> str:
    """CRC-32 byte by byte, words without each of their code points joined, and paths of forms."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{upper}', '{lower}') AS run FROM documents
), counted AS (
  SELECT run, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes, count(*) AS n
  FROM runs WHERE len(run) >= {MIN_LENGTH} GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(bytes, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM counted, crc
), typed AS (
  SELECT CASE WHEN h % {TYPO_RATE} = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE len(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), deleted AS (
  SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)
), inserted AS (SELECT DISTINCT d.word AS long, w.word AS short, d.n AS long_n, w.n AS short_n FROM deleted d JOIN words w ON w.word = d.rest),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM deleted a JOIN deleted b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM inserted UNION ALL SELECT short, long, long_n FROM inserted
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS other_n, min(other) FILTER (other_n = top) AS other FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), path(word, goal) AS (
  SELECT word, word FROM formed UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.goal WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.goal AS root, f.n, f.n_near, f.form_n FROM formed f JOIN path p USING (word) JOIN formed ending ON ending.word = p.goal WHERE ending.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": suffix_dedup_sql(),
        "op3_jaccard_join": jaccard_join_sql(),
        "op4_decontamination": decontamination_sql(),
        "op6_sharding": sharding_sql(),
        "op8_quality_rules": quality_rules_sql(),
        "op9_license_scan": license_scan_sql(),
        "op11_vector_codes": vector_codes_sql(),
        "op12_embedding_dedup": embedding_dedup_sql(),
        "op13_spelling_variants": spelling_variants_sql(),
    }
