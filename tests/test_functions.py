"""Rules and their edge cases on small inputs, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import articles, html, intent, scoring
from tessella.functions import constants as C
from tessella.functions import text as X
from tessella.operators import chunking, cleaning, rerank


def one(spark, value, expr, **more):
    row = {"t": value, **more}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(expr.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [("foo\nbar\r\nbaz", "foobarbaz"), ("①ﬁ x", "1fi x"), ("a​b  c", "ab c"), (None, ""), ("", "")],
)
def test_normalize_text(spark, value, wanted):
    assert one(spark, value, X.normalize_text("t")) == wanted


def test_normalize_text_with_line_ends(spark):
    assert one(spark, "a\n\n\n\nb\tc", X.normalize_text("t", True)) == "a\n\nbc"


def test_terms_keep_thai_marks_and_eval_tokens(spark):
    assert one(spark, "ผู้สูงอายุ ok OK", X.search_terms("t")) == ["ผู้สูงอายุ", "ok"]
    assert one(spark, None, X.search_terms("t")) == []
    assert one(spark, "a bc  BC d", X.eval_tokens("t")) == ["bc"]


def test_language_hint(spark):
    for value, wanted in (("abc", "en"), ("ภาษา", "th"), ("ภาษา x", "mixed"), ("123", "unknown"), (None, "unknown")):
        assert one(spark, value, X.language_hint("t")) == wanted


def test_menu_lines(spark):
    for value, wanted in (("Home", True), ("Price: 5", False), ("", True), ("one two three four five six seven", False), ("x" * 41, False)):
        assert one(spark, value, cleaning.is_menu_line(F.col("t"))) is wanted


def test_numbered_sections(spark):
    got = one(spark, "head\n1. A\n3.5 million\n  2. B", chunking.numbered_sections("t"))
    assert got == ["head", "1. A", "3. 5 million", "2. B"]
    assert one(spark, "plain", chunking.numbered_sections("t")) == ["plain"]
    assert one(spark, "", chunking.numbered_sections("t")) == []


def test_inline_sections(spark):
    assert one(spark, "x 1. Alpha beta 2. Gamma 12.5 no", chunking.inline_sections("t")) == ["1. Alpha beta", "2. Gamma 12.5 no"]


def long_block(block, limit):
    """Greedy packing by its rule: sentences in order, an oversize one cut by itself."""
    block = block.strip()
    if len(block) <= limit:
        return [block] if block else []
    out, buf = [], ""
    for s in [x.strip() for x in re.split(r"(?<=[.!?ฯๆ])\s+", block) if x.strip()]:
        if len(s) > limit:
            out += [buf] * bool(buf) + [s[i : i + limit].strip() for i in range(0, len(s), limit)]
            buf = ""
        elif not buf:
            buf = s
        elif len(buf) + 1 + len(s) <= limit:
            buf += " " + s
        else:
            out.append(buf)
            buf = s
    return [x for x in out + [buf] if x]


@pytest.mark.parametrize("value", ["", "a", "One two. Three four! " * 8, "x" * 95 + ". short. " + "y" * 30 + ". z", "no end " * 30])
def test_split_long_block(spark, value):
    assert one(spark, value, chunking.split_long_block("t", 40)) == long_block(value, 40)


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, "Alpha beta. " * 20)], "doc_id int, text string")
    chunks = chunking.chunk_text(df, size=60, overlap=10).first()["chunks"]
    plain = long_block("Alpha beta. " * 20, 60)
    assert chunks[0] == plain[0]
    assert chunks[1] == (plain[0][-10:] + "\n" + plain[1]).strip()
    assert chunking.chunk_text(spark.createDataFrame([(1, None)], "doc_id int, text string")).first()["chunks"] == []


def test_paragraphs_are_packed_when_kept(spark):
    df = spark.createDataFrame([(1, "aa\n\nbb\n\n" + "c" * 9)], "doc_id int, text string")
    assert chunking.chunk_text(df, size=8, overlap=0, preserve_newlines=True).first()["chunks"] == ["aa\n\nbb", "c" * 8, "c"]


@pytest.mark.parametrize(("sizes", "wanted"), [([120, 30, 30, 150], [0, 0, 0, 1]), ([30, 120], [0, 1]), ([30, 30], [0, 0]), ([], [])])
def test_merge_short(spark, sizes, wanted):
    parts = [chr(97 + i) * n for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(parts,)], "t array<string>")
    got = df.select(chunking.merge_short(F.col("t")).alias("o")).first()["o"]
    groups = sorted(set(wanted))
    assert got == [" ".join(p for p, g in zip(parts, wanted) if g == k) for k in groups]


def test_char_split(spark):
    assert one(spark, "abcdefghij", chunking.char_split("t", 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, "abc", chunking.char_split("t", 4, 1)) == ["abc"]
    assert one(spark, None, chunking.char_split("t", 4, 1)) == []


def test_lexical_score(spark):
    terms = F.array(F.lit("ab"), F.lit("zz"))
    import math

    assert one(spark, "ABab ab", scoring.lexical_score(terms, "t")) == pytest.approx(min(3, 1 + math.log1p(3)) + 1.5)
    assert one(spark, "", scoring.lexical_score(terms, "t")) == 0


def test_routes_and_keys(spark):
    assert one(spark, "please listen", intent.route("t")) == "structured_rag"
    assert one(spark, "hello", intent.route("t")) == "semantic_rag"
    assert one(spark, "5 trends มีอะไรบ้าง", intent.fact_key("t")) == "numbered_section_title"
    assert one(spark, "net income?", intent.fact_key("t")) == "profit"
    assert one(spark, None, intent.fact_key("t")) == ""
    assert one(spark, "5 sme trends", intent.preferred_domain("t")) == "ttbbank.com"
    assert one(spark, "top 8 trends", intent.requested_list_count("t")) == 8


def test_query_phrases(spark):
    got = one(spark, "What about pet parent และ สังคมไทย", intent.query_phrases("t"))
    assert got[0] == "what about pet parent"
    assert "สังคมไทย" in got
    assert got[-3:] == ["pet parent", "ตลาดสัตว์เลี้ยง", "สัตว์เลี้ยง"]


def test_boilerplate_words_with_marks_need_a_letter_behind(spark):
    assert one(spark, "ใช้คุกกี้ และ", cleaning.is_boilerplate_line(F.col("t"))) is False
    assert one(spark, "our cookie rules", cleaning.is_boilerplate_line(F.col("t"))) is True


def test_truncate(spark):
    assert one(spark, "One two three. Four five six seven", articles.truncate_at_boundary("t", 20)) == "One two three"
    assert one(spark, "One  two", articles.truncate_at_boundary("t", 20)) == "One two"
    assert one(spark, "x" * 30, articles.truncate_at_boundary("t", 20)) == "x" * 20


def test_articles(spark):
    section = "2. Pet Parent สัตว์เลี้ยงยังคงสำคัญ CAGR 6.5% ตั้งแต่ปี 2024 ถึง 2030 แนวทางธุรกิจ สร้างบริการใหม่สำหรับสัตว์เลี้ยงทั่วประเทศ พัฒนาอาหารสัตว์คุณภาพสูงสำหรับทุกวัย"
    # The figure of a stat follows its name at once, that of a detail within twenty characters.
    assert one(spark, section, articles.stat_points(F.col("t"))) == []
    assert one(spark, section.replace("CAGR ", "CAGR)"), articles.stat_points(F.col("t"))) == ["CAGR 6.5% ช่วง 2024-2030"]
    assert len(one(spark, section, articles.business_actions(F.col("t")))) == 2
    assert "6.5%" in one(spark, section, articles.numeric_detail(F.col("t")))
    item = one(spark, "3. Clean Energy พลังงาน", articles.numbered_item(F.col("t")))
    assert (item["order"], item["title"]) == (3, "Clean Energy")
    quoted = one(spark, "4. “ตลาดใหม่” เติบโตดี ดังนั้น ควรทำ", articles.numbered_item(F.col("t")))
    assert (quoted["title"], quoted["description"]) == ("ตลาดใหม่", "เติบโตดี")
    cued = one(spark, "5. สังคมสูงวัย ประเทศไทยเข้าสู่ยุคใหม่", articles.numbered_item(F.col("t")))
    assert (cued["title"], cued["description"]) == ("สังคมสูงวัย", "ประเทศไทยเข้าสู่ยุคใหม่")
    assert one(spark, "no number", articles.numbered_item(F.col("t"))) is None


def test_trim_to_section(spark):
    phrases = F.array(F.lit("beta"))
    assert one(spark, "1. alpha 2. beta gamma 3. delta", rerank.trim_to_section(F.col("t"), phrases)) == "2. beta gamma"
    assert one(spark, "nothing here", rerank.trim_to_section(F.col("t"), phrases)) == "nothing here"


def test_srcset(spark):
    for value, wanted in (("a.jpg 480w, b.jpg 2x", "b.jpg"), ("a.jpg", "a.jpg"), ("", ""), (None, "")):
        assert one(spark, value, html.srcset_best("t")) == wanted
        assert html.best_of_srcset(value or "") == wanted


PAGE = """<html><head><meta property="og:title" content=" A title "><meta property="og:image" content="/o.png"><title>t</title></head><body><nav>menu</nav>
<article><h2>1. First thing</h2><p>text</p><li>2. Second</li><li>2. second</li><figure><img src="/i.jpg" srcset="s.jpg 2x" alt="al"><figcaption>cap</figcaption></figure>
<div style="background: url('/bg.png')"></div></article><a href="/x.pdf">f</a><a href="/x.pdf#p">g</a><button onclick="go('/download/1')">h</button></body>"""


def test_html():
    assert html.title(PAGE) == "A title"
    assert [x["title"] for x in html.outline(PAGE)] == ["First thing", "Second"]
    assert html.file_links(PAGE, "https://h.org/a/") == ["https://h.org/x.pdf", "https://h.org/x.pdf#p", "https://h.org/download/1"]
    urls = [x["img_url"] for x in html.images(PAGE, "https://h.org/a/")]
    assert urls == ["https://h.org/o.png", "https://h.org/a/s.jpg", "https://h.org/i.jpg", "https://h.org/bg.png"]
    assert "cap" in html.images(PAGE, "https://h.org/a/")[1]["nearby_text"]
    assert html.article_text(PAGE).startswith("1. First thing\ntext")
    assert html.title(None) == "" and html.outline("") == [] and html.article_text(None) == ""


def test_redirects(spark):
    assert one(spark, "/url?sa=t&q=https%3A%2F%2Fa.org%2Fb&x=1", html.unwrap_redirect("t")) == "https://a.org/b"
    assert one(spark, "https://a.org", html.unwrap_redirect("t")) == "https://a.org"


def test_lines_are_told_by_their_patterns_alone(spark):
    """What is tried before the patterns loses no line that they match, whatever its letters."""
    from functools import reduce

    words = [w for f in C.BOILERPLATE_LINES for w in f]
    odd = str.maketrans({"i": "İ", "s": "ſ", "k": "K"})
    lines = [f"a {v} b" for w in words for v in (w, w.upper(), w.title(), w.translate(odd), w.upper().translate(str.maketrans("I", "ı")), f"x{w}x", w[:-1])]
    lines += ["", "plain words", "COOKİE"]
    known = reduce(lambda a, b: a | b, [F.col("x").rlike(cleaning._line_pattern(f)) for f in C.BOILERPLATE_LINES])
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", known.alias("known"), cleaning.is_boilerplate_line(F.col("x")).alias("got")).collect()
    assert all(r.known == r.got for r in rows) and sum(r.known for r in rows) > 3 * len(words)


def test_trees_are_freed_with_their_roots():
    import gc
    import weakref

    gc.disable()
    try:
        root = html.parse("<body><article><p>One <b>two</b></p></article></body>")
        seen = [weakref.ref(n) for n in root.walk()]
        assert seen[-1]().parent.name == "p"
        del root
        assert all(r() is None for r in seen)
    finally:
        gc.enable()


def test_both_texts_of_a_page_are_those_of_two_trees():
    long = "<p>" + "word " * 200 + "</p>"
    pages = [None, "", "<p>only", f"<body><nav>n</nav><article><form>f</form>{long}<div class='cookie-banner'>c</div></article></body>", f"<main><section>{long}<iframe>i</iframe></section><aside>a</aside></main>"]
    assert [html.both_texts(p) for p in pages] == [(html.article_text(p), html.main_text(p)) for p in pages]


def test_page_content_computes_each_step_once(spark):
    p = spark.range(3).selectExpr("concat('a', id) AS a", "concat('m', id) AS m", "concat('v', id) AS v")
    plan = p.select(cleaning.page_content(F.col("a"), F.col("m"), F.reverse("v")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1, plan[:500]
