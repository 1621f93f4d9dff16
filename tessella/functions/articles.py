"""Numbered articles: titles, leads, figures, actions and sources of a section, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space, contains_any, let, match_text, text

# Phrases that end a section, a lead or a list of actions.
SECTION_STOPS = ("แนวทางธุรกิจ", "ทิศทางธุรกิจ", "ที่มา:", "ที่มา", "คอนเทนต์แนะนำ", "ข่าวน่าสนใจ")
LEAD_CUES = ("สัตว์เลี้ยงยังคง", "ประเทศไทยเข้าสู่", "ความต้องการลดคาร์บอน", "AI และ Automation กลายเป็น", "ประชากรไทยกว่า", "ผู้สูงอายุในยุคนี้")
LEAD_STOPS = (
    "รายงานจาก", "คาดการณ์ว่า", "โดยข้อมูลจาก", "International Energy Agency", "Grand View Research", "McKinsey", "Visa", "แนวทางธุรกิจ", "ทิศทางธุรกิจ",
)
LEAD_SOURCES = ("International Energy Agency", "Grand View Research", "McKinsey", "Visa")
ACTION_MARKS = ("แนวทางธุรกิจ", "ทิศทางธุรกิจ")
ACTION_STOPS = ("ปี 2025 จะเป็นปีแห่ง", "ที่มา:", "ที่มา", "คอนเทนต์แนะนำ", "ข่าวน่าสนใจ")
ACTION_VERBS = ("สร้าง", "นำ", "นํา", "พัฒนา", "ส่งเสริม", "ติดตั้ง", "ลงทุน", "ใช้", "วิเคราะห์", "รองรับ")
SOURCES = ("Grand View Research", "International Energy Agency (IEA)", "McKinsey", "Visa", "UN", "Gartner")
OPENING_CUES = (
    "ประเทศไทย", "ความต้องการ", "รายงานจาก", "AI ", "AI และ", "ประชากรไทย", "UN ระบุ", "จากการสำรวจของ Visa", "จากการสํารวจของ Visa", "Visa มีตัวเลข",
    "International Energy Agency", "AI และระบบ Automation จะ", "การเติบโต", "แม้สถานการณ์", "หนึ่งใน", "ในปี", "ปัจจุบัน",
)
TITLE_CUES = (
    "สัตว์เลี้ยงยังคง", "ประเทศไทยเข้าสู่", "ความต้องการลดคาร์บอน", "AI และ Automation กลายเป็น", "UN ระบุ", "จากการสำรวจของ Visa", "จากการสํารวจของ Visa",
    "Visa มีตัวเลข", "AI และระบบ Automation จะ", "ประชากรไทยกว่า", "รายงานจาก", "โดยข้อมูลจาก", "คาดการณ์ว่า", "คาดว่า",
)
OPENING_STOPS = ("แนวทางธุรกิจ", "ทิศทางธุรกิจ", "ดังนั้น", "ล่าสุด")
ITEM_STOPS = ("แนวทางธุรกิจ", "ทิศทางธุรกิจ", "ดังนั้น", "ล่าสุด", "ที่มา:", "ที่มา")
ENGLISH_OPENING = r"^([A-Za-z][A-Za-z0-9&+./:-]*(?:\s+[A-Za-z][A-Za-z0-9&+./:-]*){0,5})\s"
BOUNDARIES = (". ", "? ", "! ", "… ", " ดังนั้น", " โดย", " ซึ่ง", " และ", " รวมถึง")
GROWTH = r"(?i)(?:CAGR\)?|อัตราการเติบโตเฉลี่ยสะสม(?:ต่อปี)?|อัตราเติบโตเฉลี่ยสะสม(?:ต่อปี)?)[^0-9]{0,20}(\d+(?:\.\d+)?)\s*%"
ALIASES = (
    (("pet parent", "สัตว์เลี้ยง"), ("pet parent", "สัตว์เลี้ยง")),
    (("ผู้สูงอายุ", "สูงวัย", "elderly", "senior"), ("ผู้สูงอายุ", "สูงวัย")),
    (("พลังงานสะอาด", "พลังงานหมุนเวียน", "clean energy", "renewable"), ("พลังงานสะอาด", "พลังงานหมุนเวียน")),
    (("ai", "automation", "chatbot", "crm"), ("ai", "automation")),
    (("สังคมไร้เงินสด", "cashless", "cross-border", "การค้าออนไลน์"), ("สังคมไร้เงินสด", "การค้าออนไลน์")),
)


# Text is collapsed before it is cut, so that its only white space is the space and plain trims do. What is read twice
# is bound once (``let``): inlined, each step would multiply the work of those before it.
def _places(t: Column, phrases: tuple[str, ...]) -> Column:
    """Places of the listed phrases that a text holds, in the order of the list."""
    return F.transform(F.filter(F.array(*map(F.lit, phrases)), lambda s: t.contains(s)), lambda s: F.instr(t, s))


def cut_at_first(c: Column, stops: tuple[str, ...]) -> Column:
    """Up to the first listed stop that the text holds after its beginning."""
    cut = lambda t, found: F.when(F.size(found) > 0, F.trim(F.substring(t, F.lit(1), F.get(found, 0) - 1))).otherwise(t)
    return let(c, lambda t: let(F.filter(_places(t, stops), lambda p: p > 1), lambda found: cut(t, found)))


def truncate_at_boundary(c: Column | str, n: int) -> Column:
    """F27. Cut at the last boundary, or else space, that leaves 55 per cent; or else hard."""
    return let(collapse_space(c), lambda t: _truncate(t, n))


def _truncate(t: Column, n: int) -> Column:
    # Offset of the last occurrence: what stands before the tail that the reversed text finds first.
    last = lambda head, marker: F.when(head.contains(marker), n_before(head, marker)).otherwise(-1)
    least = int(n * 0.55)

    def cut(head: Column) -> Column:
        at = let(F.greatest(*[last(head, m) for m in BOUNDARIES]), lambda at: F.when(at >= least, at))
        space = let(last(head, " "), lambda at: F.when(at >= least, at))
        return F.rtrim(F.substring(head, F.lit(1), F.coalesce(at, space, F.lit(n))), F.lit(" ,;:"))

    return F.when(F.length(t) <= n, t).otherwise(let(F.substring(t, 1, n), cut))


def n_before(c: Column, marker: str) -> Column:
    """Characters before the last occurrence of a marker."""
    return F.length(c) - F.length(F.substring_index(c, marker, -1)) - len(marker)


def _unnumbered(section: Column) -> Column:
    return collapse_space(F.regexp_replace(text(section), r"(?U)^\s*\d{1,2}\.\s*", ""))


def section_body(section: Column) -> Column:
    """F28. Text of a numbered section up to its first closing phrase."""
    return cut_at_first(_unnumbered(section), SECTION_STOPS)


def section_lead(section: Column, title: Column) -> Column:
    """F28. Opening statement of a section, from a cue or behind the title to a source or figure."""
    return let(section_body(section), lambda body: _lead(body, title))


def _lead(body: Column, title: Column) -> Column:
    start = F.coalesce(F.array_min(_places(body, LEAD_CUES)) - 1, F.when((title != "") & body.startswith(title), F.length(title)).otherwise(0))
    lead = cut_at_first(_from(body, start + 1), LEAD_STOPS)
    named = lambda x: F.when(contains_any(x, LEAD_SOURCES), F.element_at(F.split(x, rf"(?:{'|'.join(LEAD_SOURCES)})\b"), 1)).otherwise(x)
    return _dashes(let(lead, named))


def _filled(pattern: str, *parts: Column) -> Column:
    """A formatted string, or null if a part is missing."""
    blank = parts[0] == ""
    for p in parts[1:]:
        blank = blank | (p == "")
    return F.when(~blank, F.format_string(pattern, *parts))


def numeric_detail(section: Column) -> Column:
    """F29. The growth rate with its years, or a share with its year; else empty."""
    return let(section_body(section), _numeric)


def _numeric(t: Column) -> Column:
    g = lambda pattern, i=1: F.regexp_extract(t, pattern, i)
    span = r"ตั้งแต่ปี\s*(20\d{2})\s*ถึง\s*(20\d{2})"
    growth = _filled("ตลาดสัตว์เลี้ยงถูกคาดว่าจะเติบโตเฉลี่ยสะสม (CAGR) %s%% ตั้งแต่ปี %s ถึง %s", g(GROWTH), g(span), g(span, 2))
    share = _filled("บทความระบุว่าตัวเลขสำคัญคือ %s%% ภายในปี %s", g(r"(\d+(?:\.\d+)?)\s*%"), g(r"ภายในปี\s*(20\d{2})"))
    return F.coalesce(growth, share, F.lit(""))


def growth_detail(section: Column) -> Column:
    """F29."""
    span = r"ตั้งแต่ปี\s*(20\d{2})\s*ถึง\s*(20\d{2})"
    rate = lambda t: _filled("ตลาดสัตว์เลี้ยงถูกคาดว่าจะเติบโต CAGR %s%% ในช่วง ปี %s ถึง %s", F.regexp_extract(t, GROWTH, 1), F.regexp_extract(t, span, 1), F.regexp_extract(t, span, 2))
    return F.coalesce(let(section_body(section), rate), F.lit(""))


def definition_detail(section: Column) -> Column:
    """F29. The definition of the first pet trend, the longer form first."""
    head = "สัตว์เลี้ยงจะยังคงเป็นส่วนหนึ่งของครอบครัว"
    long = head + r"[^.]*?และมีแนวโน้มที่ครอบครัวจะมีสัตว์เลี้ยงเป็นสมาชิกครอบครัวเพิ่มขึ้นเรื่อย\s*ๆ"
    return _dashes(let(section_body(section), lambda t: F.coalesce(F.nullif(F.regexp_extract(t, long, 0), F.lit("")), F.regexp_extract(t, head + r"[^.]*", 0))))


def business_actions(section: Column) -> Column:
    """F30, D13. Actions behind the first mark, split before verbs; fragments join the action before them."""
    return let(_unnumbered(section), _behind_mark)


def _behind_mark(whole: Column) -> Column:
    behind = F
    for mark in ACTION_MARKS:
        behind = behind.when(whole.contains(mark), _from(whole, F.instr(whole, mark) + len(mark)))
    listed = let(cut_at_first(behind.otherwise(""), ACTION_STOPS), _actions)
    return F.when(contains_any(whole, ACTION_MARKS), listed).otherwise(F.expr("cast(array() AS array<string>)"))


def _actions(listed: Column) -> Column:
    verbs = "|".join(ACTION_VERBS)
    parts = F.split(listed, rf"(?={verbs})")
    parts = F.when(listed.rlike(verbs), F.filter(parts, lambda p: p.rlike(rf"^(?:{verbs})"))).otherwise(F.array(listed))
    parts = F.filter(F.transform(parts, _dashes), lambda p: p != "")
    empty = F.expr("cast(array() AS array<string>)")

    def step(a: Column, p: Column) -> Column:
        joins = (F.size(a) > 0) & ((F.length(p) <= 24) | p.startswith("ใช้งาน") | F.coalesce(F.get(a, F.size(a) - 1).endswith("ที่"), F.lit(False)))
        return F.when(joins, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.get(a, F.size(a) - 1), p)))).otherwise(F.concat(a, F.array(p)))

    return F.array_distinct(F.aggregate(parts, empty, step))


def source_names(section: Column) -> Column:
    """F31."""
    return let(section_body(section), _named)


def _named(body: Column) -> Column:
    return F.filter(F.array(*map(F.lit, SOURCES)), lambda s: body.contains(s))


def stat_points(section: Column) -> Column:
    """F31, D13. Figures of a section as short statements, each once."""
    return let(section_body(section), _points)


def _points(t: Column) -> Column:
    g = lambda pattern, i=1: F.regexp_extract(t, pattern, i)
    span = r"(?i)(?:CAGR\)?|อัตราเติบโตเฉลี่ยสะสม[^0-9]{0,20})(\d+(?:\.\d+)?)\s*%.*?ตั้งแต่ปี\s*(20\d{2})\s*ถึง\s*(20\d{2})"
    share = r"(\d+(?:\.\d+)?)\s*%.*?ภายในปี\s*(20\d{2})"
    people = r"ปี\s*(20\d{2}).*?(\d+(?:\.\d+)?)%\s*ของประชากร"
    # A pattern is tried only where its fixed words stand; behind each figure it reads on to the end for them.
    points = F.array(
        F.when(t.contains("ตั้งแต่ปี"), _filled("CAGR %s%% ช่วง %s-%s", g(span), g(span, 2), g(span, 3))),
        F.when(t.contains("ภายในปี"), _filled("%s%% ภายในปี %s", g(share), g(share, 2))),
        F.when(t.contains("ของประชากร"), _filled("ปี %s ผู้สูงอายุ %s%% ของประชากร", g(people), g(people, 2))),
        F.when(t.contains("ไม่จับเงินสด"), _filled("คนไทยกว่า %s%% ใช้ชีวิตโดยไม่จับเงินสด", g(r"(\d+(?:\.\d+)?)%\s*สามารถใช้ชีวิตโดยไม่จับเงินสด"))),
        F.when(t.contains("เงินสด"), _filled("ไทยคาดเข้าสู่สังคมไร้เงินสดเต็มตัวภายใน %s ปี", g(r"ภายใน\s*(\d+)\s*ปี"))),
        F.when(t.contains("เติบโตต่อเนื่องกว่า"), _filled("Cross-border e-commerce เติบโตต่อเนื่องกว่า %s%%", g(r"เติบโตต่อเนื่องกว่า\s*(\d+(?:\.\d+)?)\s*%"))),
    )
    return F.array_distinct(F.array_compact(points))


def _dashes(c: Column) -> Column:
    return F.trim(c, F.lit(" :-"))


def _first_cue(body: Column, cues: tuple[str, ...]) -> Column:
    """Place of the earliest cue whose first place is behind the seventh letter, or null."""
    return F.array_min(F.filter(_places(body, cues), lambda p: p > 7))


def _from(c: Column, place: Column) -> Column:
    return F.trim(F.substring(c, place, F.length(c)))


def _before(c: Column, place: Column) -> Column:
    return F.trim(F.substring(c, F.lit(1), place - 1))


def numbered_item(section: Column) -> Column:
    """F26. struct(order, title, description) of a numbered section, or null.

    The title is quoted, or ends at a cue, or is the English opening of up to
    six words, or else the first forty letters; the description is what follows,
    up to a closing phrase and a boundary.
    """
    return let(_headed(section), lambda h: F.when(h["title"] != "", F.struct(h["order"].alias("order"), h["title"].alias("title"), _description(h).alias("description"))))


def profile(section: Column) -> Column:
    """G15, F26, F28, F30, F31. struct(order, title, lead, actions, stats, sources, body) of a numbered section, or null."""
    parts = lambda h, whole, body: F.struct(
        h["order"].alias("order"), h["title"].alias("title"), _lead(body, h["title"]).alias("lead"), _behind_mark(whole).alias("actions"),
        _points(body).alias("stats"), _named(body).alias("sources"), body.alias("body"),
    )
    told = lambda h: let(_unnumbered(section), lambda whole: let(cut_at_first(whole, SECTION_STOPS), lambda body: parts(h, whole, body)))
    return let(_headed(section), lambda h: F.when(h["title"] != "", told(h)))


def _headed(section: Column) -> Column:
    """struct(order, title) of a numbered section and what its description is made of; no title where there is no item."""
    body = collapse_space(F.regexp_extract(text(section), r"(?s)^\s*\d{1,2}\.\s*(.+)$", 1))
    order = F.regexp_extract(text(section), r"^\s*(\d{1,2})\.", 1).try_cast("int")
    return let(body, lambda b: let(_opening_end(b), lambda end: let(_dashes(_before(b, end)), lambda opening: let(_quote(b), lambda q: _titled(order, b, end, opening, q)))))


def _opening_end(body: Column) -> Column:
    """Place behind the title by the opening alone."""
    cue = F.coalesce(_first_cue(body, OPENING_CUES), F.lit(41))
    return let(F.regexp_extract(body, ENGLISH_OPENING, 1), lambda english: F.when(english != "", F.length(english) + 1).otherwise(cue))


def _quote(body: Column) -> Column:
    """struct(title, end) of a title in quotes or before a cue; no end where there is neither."""
    quotes = r"^[\"'“”‘’]([^\"“”‘’]+)[\"'“”‘’]\s*"
    at_cue = lambda cue: F.struct(F.when(cue.isNotNull(), _dashes(_before(body, cue))).alias("title"), cue.alias("end"))
    by_cue = let(_first_cue(body, TITLE_CUES), at_cue)
    return let(
        F.regexp_extract(body, quotes, 0),
        lambda quoted: F.when(quoted != "", F.struct(_dashes(F.regexp_extract(body, quotes, 1)).alias("title"), (F.length(quoted) + 1).alias("end"))).otherwise(by_cue),
    )


def _titled(order: Column, body: Column, end: Column, opening: Column, quote: Column) -> Column:
    words = opening.rlike(r"^[A-Za-z][A-Za-z0-9&+./:-]*(?:\s+[A-Za-z][A-Za-z0-9&+./:-]*){1,4}$")
    found = F.coalesce(quote["title"], opening)
    head = F.when(words & found.startswith(opening), opening).otherwise(found)
    return let(
        head,
        lambda head: F.struct(
            order.alias("order"), F.when(order.isNull() | (opening == ""), "").when(head == "", opening).otherwise(head).alias("title"), head.alias("head"),
            body.alias("body"), opening.alias("opening"), end.alias("opening_end"), quote["end"].alias("end"),
        ),
    )


def _description(h: Column) -> Column:
    rest = F.when(h["end"].isNotNull(), _from(h["body"], h["end"])).otherwise(without_head(h["body"], h["opening"]))
    said = let(let(cut_at_first(rest, ITEM_STOPS), lambda r: without_head(r, h["head"])), lambda t: _truncate(t, 240))
    short = let(cut_at_first(_from(h["body"], h["opening_end"]), OPENING_STOPS), lambda t: _truncate(t, 220))
    return let(said, lambda s: F.when(s == "", short).otherwise(s))


def without_head(c: Column, head: Column) -> Column:
    return F.when((head != "") & c.startswith(head), _from(c, F.length(head) + 1)).otherwise(c)


def alias_groups(question: Column) -> Column:
    """The alias groups that a question asks for."""
    groups = lambda q: F.array_compact(F.array(*[F.when(contains_any(q, triggers), F.array(*map(F.lit, aliases))) for triggers, aliases in ALIASES]))
    return let(match_text(question), groups)


def profile_score(groups: Column, profile_text: Column, title: Column, phrases: Column) -> Column:
    """A24. Phrases found in a profile, and three for each of the question's alias groups that the title shares."""
    found = let(match_text(profile_text), lambda hay: F.size(F.filter(phrases, lambda p: (p != "") & hay.contains(p))))
    return found + 3 * let(match_text(title), lambda name: F.size(F.filter(groups, lambda group: F.exists(group, lambda a: name.contains(a)))))
