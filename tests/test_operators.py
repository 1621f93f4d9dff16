"""Operators over small tables: order, ties, budgets, stores, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella import models
from tessella.functions import constants as C
from tessella.functions.constants import LOG_ENTRIES
from tessella.operators import cleaning, evaluation, facts, patterns, rerank, retrieval, store, summaries, vision
from tessella.plans import pipelines
from tessella.sources import readers, sinks
from tessella.streaming import jobs


def test_knn_leaves_out_chunks_without_vectors(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0], 0.0), (2, [0.0, 0.0], -1.0), (3, [3.0, 4.0], 0.0)], "vec_id int, embedding array<float>, score_hint double")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "qid int, embedding array<float>")
    got = retrieval.vector_topk(c, q, 5).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 4)) for r in got] == [(1, 1.0), (3, round(1 / 6, 4))]


def test_sources_without_place_are_empty(spark):
    c = spark.createDataFrame([("a", "n", "u", "p", 1)], "id string, namespace string, source_url string, source_path string, chunk_index int")
    assert retrieval.source_chunks(c, "n").count() == 0
    assert retrieval.source_chunks(c, "n", url="u").count() == 1


def test_namespaces_keep_their_order_on_ties(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.9)], "id string, score double")
    b = spark.createDataFrame([("b", 0.5)], "id string, score double")
    assert [r.id for r in retrieval.merge_namespaces([a, b]).collect()] == ["y", "x", "b"]


def test_prefer_keeps_all_without_a_hit(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q int, s string")
    assert sorted(r.s for r in retrieval.prefer(df, F.col("s") == "a", "q").collect()) == ["a", "c"]


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5000), (1, 2, 4000), (1, 3, 100)], "q int, o int, n int")
    assert [r.o for r in cleaning.budget_prefix(df, F.col("n"), "q", "o", 8500).collect()] == [1]


def test_evaluation_definitions(spark):
    q = spark.createDataFrame([(1, ["rel"]), (2, ["rel"]), (3, ["rel"])], "qid int, patterns array<string>")
    got = spark.createDataFrame([(1, 1, "rel"), (1, 2, "irr"), (1, 3, "rel"), (2, 1, "REL  x")], "qid int, rank int, text string")
    two = {r.qid: r for r in evaluation.precision_recall(got, q, 2).collect()}
    assert (two[1].precision_at_k, two[1].recall_at_k, two[1].context_precision) == (0.5, 0.5, 0.5)
    assert (two[3].precision_at_k, two[3].recall_at_k, two[3].context_precision) == (0, 0, 0)
    five = {r.qid: r for r in evaluation.precision_recall(got, q, 5).collect()}
    assert (five[2].precision_at_k, five[2].recall_at_k, five[2].context_precision) == (0.2, 1.0, 1.0)


def test_rerank_raises_phrases_and_keeps_one_article(spark):
    cols = "qid int, question string, ord int, score double, text string, source_url string, source_path string, source_type string, page int"
    rows = [
        (1, "about pet parent", 1, 0.5, "nothing", "u1", "", "web_page", 0),
        (1, "about pet parent", 2, 0.4, "the pet parent about pet parent", "u2", "", "web_page", 0),
        (2, "ในบทความ about pet parent", 1, 0.9, "x", "u1", "", "pdf", 0),
        (2, "ในบทความ about pet parent", 2, 0.1, "about pet parent", "u2", "", "web_page", 0),
    ]
    got = rerank.rerank(spark.createDataFrame(rows, cols)).orderBy("qid", "rank").collect()
    assert [(r.qid, r.ord) for r in got] == [(1, 2), (1, 1), (2, 2)]
    # Two phrases of eight letters and more, and three hundredths for each match of the source.
    assert got[0].combined == pytest.approx(0.4 + 0.14 * 2 + 0.03 * 2)


def test_fact_parsing(spark):
    answer = '```json\n{"entity_hint":"h","facts":[{"key":"a","value":"1","evidence_text":"seen"},{"key":"b","value":"2","evidence_text":"unseen"},{"key":"","value":"3"}]}\n```'
    df = spark.createDataFrame([(1, answer, "was seen here", "hint"), (2, "no json", "x", "h"), (3, None, None, None)], "doc_id int, answer string, text string, entity_hint string")
    got = facts.parse_facts(df).collect()
    assert [(r.doc_id, r.entity, r.key, r.value, r.year) for r in got] == [(1, "hint", "a", "1", 0)]


def test_facts_that_differ_by_unit(spark):
    rows = [("n", "e", "k", "v", u, 1, "p", 0, i) for i, u in enumerate(["kg", "g", "KG "])]
    df = spark.createDataFrame(rows, "namespace string, entity string, key string, value string, unit string, year int, source_path string, page int, ord int")
    kept = cleaning.dedupe_facts(df)
    assert sorted(r.unit for r in kept.collect()) == ["g", "kg"]
    assert kept.select(store.fact_id()).distinct().count() == 1


def test_store_upsert_is_idempotent(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.init()
    new = spark.createDataFrame([("a", "t1", 0), ("a", "t2", 2), ("b", "t3", 1)], "namespace string, text string, chunk_index int")
    s.upsert_chunks(new)
    s.upsert_chunks(new.where("namespace = 'a'"))
    rows = s.chunks().collect()
    assert len(rows) == 3 and {r.chunk_index for r in rows} == {1, 2}
    s.reset()
    assert s.chunks().count() == 0


def test_documents_summary_has_documents_of_facts_only(spark):
    c = spark.createDataFrame([("n", "/a/site/content.txt", "web_page", 1), ("n", "/a/site/content.txt", "web_page", 1), ("n", "", None, 0)], "namespace string, source_path string, source_type string, page int")
    f = spark.createDataFrame([("n", "/b/x.pdf", "internal_pdf_page")], "namespace string, source_path string, source_type string")
    got = {r.filename: r for r in store.documents_summary(c, f).collect()}
    assert (got["site"].chunk_count, got["site"].page_count, got["site"].type) == (2, 1, "WEB_INGEST")
    assert (got["x.pdf"].chunk_count, got["x.pdf"].table_row_count, got["x.pdf"].type) == (0, 1, "INTERNAL_PDF")
    assert got["unknown"].type == "UNKNOWN"


def test_duplicates_follow_the_first(spark):
    df = spark.createDataFrame([("b", "h"), ("a", "h"), ("c", None), ("d", "k")], "path string, sha1 string")
    got = {r.path: (r.is_duplicate, r.duplicate_of) for r in cleaning.mark_duplicates(df, "sha1", "path", "path").collect()}
    assert got == {"a": (False, None), "b": (True, "a"), "c": (False, None), "d": (False, None)}


def test_image_relevance_and_ingest(spark):
    df = spark.createDataFrame([("a chart of sales", "a chart of sales"), ("x", ""), ("alpha beta", "gamma delta")], "page_context string, caption string")
    scores = [round(r.relevance_score, 6) for r in vision.add_relevance(df, "page_context", "caption").collect()]
    assert scores[0] == 1.0 and scores[1] == 0.0 and scores[2] == 0.0
    rows = spark.createDataFrame([("image_understanding", False, True), ("image_understanding", True, True), ("other", False, True)], "type string, is_duplicate boolean, keep_for_rag boolean")
    assert vision.for_ingest(rows).count() == 1


def test_job_status_of_unknown_jobs(spark):
    events = spark.createDataFrame([("j", "scrape", 1), ("j", "done", 2)], "job_id string, stage string, updated_at int")
    assert summaries.job_status(events, "j").first()["stage"] == "done"
    missing = summaries.job_status(events, "zz").first()
    assert missing["stage"] == "not_found" and missing["terminal"]


def test_readers_skip_what_does_not_parse(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.jsonl").write_text('{"order": 1, "title": "a"}\n\nnot json\n{"order": 2, "title": "b"}\n')
    assert [r.title for r in readers.jsonl(spark, str(tmp_path / "r"), readers.OUTLINE).orderBy("order").collect()] == ["a", "b"]
    assert readers.jsonl(spark, str(tmp_path / "none"), readers.OUTLINE).count() == 0
    (tmp_path / "1_site").mkdir()
    (tmp_path / "1_site/content.txt").write_text("one\ntwo")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/content.txt").write_text("no")
    assert [(r.folder, r.text) for r in readers.site_folders(spark, str(tmp_path)).collect()] == [("1_site", "one\ntwo")]
    (tmp_path / "f").mkdir()
    for n in ("a.PDF", "b.pdf", "c.txt", "d.Png"):
        (tmp_path / "f" / n).write_bytes(b"x")
    assert readers.pdf_files(spark, str(tmp_path / "f")).count() == 2
    assert readers.image_files(spark, str(tmp_path / "f")).count() == 1
    (tmp_path / "e.json").write_text(json.dumps([{"question": "q", "relevant_chunks": ["a"]}]))
    assert readers.json_file(spark, str(tmp_path / "e.json"), readers.EVAL_ROWS).first().relevant_chunks == ["a"]


def test_pdf_text_takes_the_longer_recognition(spark):
    rows = [("p", 1, "layer " * 20, None, None), ("p", 2, "", "short", "longer text"), ("p", 3, None, None, None)]
    pages = readers.pdf_pages(spark.createDataFrame(rows, "path string, page int, layer string, ocr_a string, ocr_b string"))
    assert [r.extract_method for r in pages.orderBy("page").collect()] == ["text_layer", "ocr", "none"]
    assert readers.pdf_text(pages).first().text.endswith("\n\nlonger text")


def test_data_uris(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("https://x",)], "img_url string")
    r = readers.data_uri_images(df).first()
    assert bytes(r.content) == b"hi" and r.content_type == "image/png"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä")], "a int, b string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().b == "ä"
    sinks.write_csv(df, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfa")
    many = spark.range(2500).repartition(7).orderBy("id").withColumn("b", F.when(F.col("id") != 3, "ä"))
    sinks.write_report(many, "T", str(tmp_path / "r"))
    assert sinks.read_report(spark, str(tmp_path / "r")).first().text.split("\n") == ["# T", "", *[f"- id: {i} | b: {'ä' if i != 3 else None}" for i in range(2500)], ""]


def test_models_are_deterministic(spark):
    df = spark.createDataFrame([("hello world",), ("",)], "text string")
    rows = models.with_embeddings(df, models.hash_embedding(8)).collect()
    assert len(rows[0].embedding) == 8 and rows[1].embedding is None
    zero = store.zero_vector_fallback(models.with_embeddings(df, models.hash_embedding(8)), 8).collect()
    assert zero[1].score_hint == -1.0 and zero[1].embedding == [0.0] * 8

    def broken(_):
        raise RuntimeError

    assert df.select(models.call(broken, "text", "?").alias("o")).first().o == "?"

    def picky(inputs):
        return [{"hello world": "hi"}[x] for x in inputs]

    got = {r.text: r.c for r in df.coalesce(1).select("text", models.call_checked(picky, "text").alias("c")).collect()}
    assert got["hello world"].output == "hi" and got["hello world"].error is None
    assert got[""].output is None and got[""].error.startswith("KeyError")


def test_duplicate_images_take_what_the_first_has(spark):
    rows = [("/a", "x", "a chart of sales", "sales chart text"), ("/b", "x", "", "nothing"), ("/c", "y", "", "z"), ("/d", "x", "other words", "z"), ("/e", None, "lone", "z")]
    out = {r.path: r for r in vision.understand(spark.createDataFrame(rows, "path string, sha1 string, caption_en string, page_context string")).collect()}
    for p in ("/b", "/d"):
        assert out[p].is_duplicate and out[p].duplicate_of == "/a"
        assert [out[p][c] for c in ("caption_en", "image_type", "relevance_score", "keep_for_rag")] == [out["/a"][c] for c in ("caption_en", "image_type", "relevance_score", "keep_for_rag")]
    assert out["/a"].caption_en == "a chart of sales" and out["/c"].caption_en == "" and len(out) == 5
    assert vision.caption_totals(spark.createDataFrame(list(out.values()))).first().asDict() == {"total": 5, "captioned": 4, "duplicates": 2, "kept": sum(r.keep_for_rag for r in out.values())}


def test_captions_of_images(spark):
    df = spark.createDataFrame([(" alt ", None, "near\n text " + "x" * 400, "a cap", "ท", "chart", "u")], "alt_text string, title_text string, nearby_text string, caption_en string, caption_th string, image_type string, source_url string")
    r = df.select(vision.fallback_caption().alias("f"), vision.caption_text().alias("c")).first()
    assert r.f.startswith("alt near text xxx") and len(r.f) == 300
    assert r.c == "caption_en: a cap\ncaption_th: ท\nimage_type: chart\nsource_url: u"


def test_merge_takes_the_least_of_several_new_rows(spark):
    old = spark.createDataFrame([(1, "old"), (2, "kept")], "id int, text string")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (3, "z"), (3, None), (1, "c")], "id int, text string").repartition(3)
    assert sorted(store.merge_by_id(old, new).collect(), key=repr) == sorted([(1, "a"), (2, "kept"), (3, None)], key=repr)


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    import os

    s = store.Store(spark, str(tmp_path / "store"))
    s.init()
    chunk = lambda n, i, t: (n, "web_page", "u", "p", 0, i, 9, t)
    schema = "namespace string, source_type string, source_url string, source_path string, page int, chunk_index int, chunk_total int, text string"
    s.upsert_chunks(spark.createDataFrame([chunk(n, i, f"text {i}") for n in ("a", "b") for i in range(1, 200)], schema))
    files = lambda: {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "store/chunks").rglob("*.parquet"))}
    before = files()
    s.upsert_chunks(spark.createDataFrame([chunk("a", 5, "text 5"), chunk("a", 1000, "new")], schema))
    after = files()
    assert s.chunks().count() == 2 * 199 + 1 and len(before.keys() - after.keys()) <= 2 < len(before)
    s.upsert_chunks(spark.createDataFrame([], schema))
    assert files() == after


def test_answer_lines_of_facts(spark):
    rows = [
        (1, "external", "E", "revenue", "9", "", 2020, "/x", 0, "i1"), (1, "internal", "B", "revenue", "5", "USD", 2021, "/y", 3, "i2"), (1, "internal", "A", "revenue", "7", "USD", None, "/y", None, "i3"),
        (2, "internal", "T", "numbered_section_title", "second", "", 2, "/z", 0, "i4"), (2, "external", "T", "numbered_section_title", "first", "", 1, "/z", 0, "i5"),
    ]
    df = spark.createDataFrame(rows, "qid int, namespace string, entity string, key string, value string, unit string, year int, source_path string, page int, id string")
    got = {r.qid: r.answer.split("\n") for r in facts.facts_answer(df).collect()}
    assert got[1][1:] == ["", "- [internal] A | revenue = 7 USD (year=0) [source: /y]", "- [internal] B | revenue = 5 USD (year=2021) [source: /y (page 3)]", "- [external] E | revenue = 9  (year=2020) [source: /x]"]
    assert got[2] == ["1. first", "2. second"]
    many = df.where("id = 'i2'").drop("id").crossJoin(spark.range(40).select(F.format_string("%03d", "id").alias("id")))
    got = facts.facts_answer(many.unionByName(df.where("id = 'i1'"))).first()
    assert got.n_facts == 25 and "[external]" not in got.answer  # thirty of a namespace, then twenty-five of all


def test_questions_are_dispatched(spark):
    """Each kind of question is answered by what is made for it, and only the rest by the generator."""
    article = "1. Pet Parent สัตว์เลี้ยงยังคงเป็นส่วนหนึ่งของครอบครัว แนวทางธุรกิจ สร้างสินค้าให้สัตว์เลี้ยงทุกชนิดในบ้าน 2. Clean Energy ความต้องการลดคาร์บอน 40% ภายในปี 2030 3. Silver Age ผู้สูงอายุในยุคนี้ใช้จ่ายมาก"
    chunks = [(f"c{i}", n, "web_page", f"https://{n}.example.com", f"/{n}/content.txt", 0, i, t) for n, texts in (("internal", [article, "Plain words about the weather in the hills. More of it."]), ("external", ["Trains run late in winter. Snow falls."])) for i, t in enumerate(texts)]
    chunks = [(f"{c[1]}{c[0]}", *c[1:]) for c in chunks]
    c = spark.createDataFrame(chunks, "id string, namespace string, source_type string, source_url string, source_path string, page int, chunk_index int, text string")
    questions = [
        (1, "revenue of the firm"), (2, "3 trends เทรนด์ มีอะไรบ้าง Pet Parent Clean Energy"), (3, "ในบทความ Clean Energy คืออะไร"),
        (4, "Trains run late in winter"), (5, "profit of the firm"), (6, ""),
    ]
    q = spark.createDataFrame(questions, "qid int, question string")
    f = spark.createDataFrame([("internal", "Firm", "revenue", "12", "USD", 2020, "/r", 0, "", "f1")], "namespace string, entity string, key string, value string, unit string, year int, source_path string, page int, evidence_text string, id string")

    def generate(prompts):
        if any("Trains run late" in p.split("\n")[0] for p in prompts):
            return [p.split("\n")[0] for p in prompts]
        raise RuntimeError("no answer")

    raw = spark.createDataFrame([("/internal/content.txt", article)], "path string, text string")
    got = {r.qid: r for r in pipelines.ask(c, q, models.hash_embedding(16), generate, k=3, facts=f, raw=raw).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 6}
    assert (got[1].answered_by, got[1].route) == ("facts", "structured_rag") and got[1].answer.endswith("- [internal] Firm | revenue = 12 USD (year=2020) [source: /r]")
    assert got[2].answered_by == "list" and got[2].answer.startswith("1. Pet Parent")
    assert got[3].answered_by == "article" and "Clean Energy" in got[3].answer
    assert got[4].answered_by in ("generator", "article") and got[4].route == "semantic_rag"
    assert got[5].answered_by in ("generator", "nothing") or got[5].answered_by == "article"
    assert got[6].answered_by == "nothing" and got[6].answer == C.NOTHING_FOUND % "no search"
    results = spark.createDataFrame([(6, 1, "T", "u", "Found text.")], "qid int, ord int, title string, url string, content string")
    got = {r.qid: r for r in pipelines.ask(c, q.where("qid = 6"), models.hash_embedding(16), generate, k=3, search=results).collect()}
    assert got[6].route == C.SEARCH_ROUTE and got[6].answer.startswith(C.SEARCH_WITHOUT_MODEL) and "no answer" in got[6].error


def test_answers_about_an_article(spark):
    text = (
        "1. Pet Parent สัตว์เลี้ยงจะยังคงเป็นส่วนหนึ่งของครอบครัว และมีแนวโน้มดี CAGR 8% ตั้งแต่ปี 2024 ถึง 2030 แนวทางธุรกิจ สร้างสินค้าให้สัตว์เลี้ยงทุกชนิดในบ้านนี้ พัฒนาบริการดูแลสัตว์เลี้ยงที่บ้านทั่วไทย "
        "2. Clean Energy ความต้องการลดคาร์บอน ลดลง 40% ภายในปี 2030 Visa แนวทางธุรกิจ ลงทุนในแผงโซลาร์บนหลังคาบ้านทุกหลัง"
    )
    ask_ = ["แต่ละเทรนด์ มีโอกาส อะไร", "ขอ แนวทางธุรกิจ แบบ bullet", "Clean Energy ควรทำอะไร", "Pet Parent สัตว์เลี้ยง คืออะไร", "ตัวเลข ที่สำคัญ", "บทความ พูดถึง Deep Sea Mining ไหม", "hello"]
    df = spark.createDataFrame([(i, t, text) for i, t in enumerate(ask_)], "qid int, question string, source_text string")
    from tessella.plans import answers

    got = {r.qid: r.answer.split("\n") for r in answers.article_texts(df).collect()}
    assert len(got[0]) == 8 and got[0][0] == "1. Pet Parent" and got[0][3] == got[0][7] == C.RISK and got[0][2].startswith(C.TO_DO + "สร้าง")
    assert got[1][0] == "1. Pet Parent" and got[1].count("2. Clean Energy") == 1 and all(x.startswith("- ") for x in got[1] if "." not in x)
    assert got[2][0] == "Clean Energy" and got[2][1].startswith("- ลงทุน")
    assert got[3][0] == C.PET_PARENT_LINE and "8%" in got[3][1]
    assert any(x.startswith("- Clean Energy: 40% ") for x in got[4]) and any("[source: " in x for x in got[4])
    assert got[5] == [C.NOT_IN_ARTICLE] and 6 not in got


def test_evaluation_of_facts_and_answers(spark):
    c = spark.createDataFrame([(f"c{i}", "internal", "web_page", "u", "/p", 0, i, t) for i, t in enumerate(["revenue was high this year", "cats sleep all day long"])], "id string, namespace string, source_type string, source_url string, source_path string, page int, chunk_index int, text string")
    f = spark.createDataFrame([("internal", "Firm", "revenue", "12", "USD", 2020, "/r", 0, "revenue was 12", "f1"), ("internal", "Firm", "revenue", "13", "USD", 2021, "/r", 0, "", "f2")], "namespace string, entity string, key string, value string, unit string, year int, source_path string, page int, evidence_text string, id string")
    q = spark.createDataFrame([(1, "revenue of the firm", ["revenue was"]), (2, "cats sleep", ["cats"])], "qid int, question string, patterns array<string>")
    rows = {r.qid: r for r in pipelines.run_eval(c, q, models.hash_embedding(16), models.extractive_generator, k=2, facts=f, namespace="internal").collect()}
    assert rows[1].structured_precision_at_k == 0.5 and rows[1].structured_recall_at_k == 1.0 and rows[1].answer_route == "structured_rag"
    assert rows[2].structured_total_relevant == 0 and rows[2].answer_route == "semantic_rag"
    for r in rows.values():
        assert r.retrieval_delta == round(r.precision_at_k - r.structured_precision_at_k, 4)
    means = evaluation.eval_summary(spark.createDataFrame(list(rows.values())).drop("qid")).first()
    assert means.rows == 2 and means.mean_structured_precision_at_k == 0.25


def test_ingest_facts(spark):
    text = "In the last year the company reported well. Revenue was 1,200 and profit is 300 by all accounts that were seen, " * 2
    c = spark.createDataFrame([("n", "web_page", "/p", 0, 1, text)], "namespace string, source_type string, source_path string, page int, chunk_index int, text string")
    got = pipelines.ingest_facts(c, models.pattern_fact_extractor).collect()
    assert sorted((r.key, r.value) for r in got) == [("profit", "300"), ("revenue", "1,200")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "scrape", 1.0), ("a", "done", 2.0), ("b", "ocr", 1.5)]
    spark.createDataFrame(rows, "job_id string, stage string, updated_at double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("job_id string, stage string, updated_at double").parquet(src)
    q = jobs.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.job_id: r.stage for r in spark.table("latest").collect()} == {"a": "done", "b": "ocr"}
    q = jobs.capped_log(stream, "job_id", "updated_at", "stage", cap=1).writeStream.outputMode("update").format("memory").queryName("logs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.job_id, r.entries, r.last_message) for r in spark.table("logs").collect()} == {("a", 1, "done"), ("b", 1, "ocr")}
    assert LOG_ENTRIES == 5000


def counting_hook(folder, fails=()):
    """A coroutine hook that leaves a file for each call, with the calls that were in flight; module state is each worker's own."""

    async def hook(x):
        import asyncio
        import os
        import uuid

        hook.running = getattr(hook, "running", 0) + 1
        (folder / f"{os.getpid()}-{hook.running}-{uuid.uuid4().hex}").write_text(x)
        await asyncio.sleep(0.02 if "slow" not in x else 9)
        hook.running -= 1
        if x in fails:
            raise ValueError(x)
        return x.upper()

    return hook


def test_bounded_calls_keep_order_and_try_again(tmp_path):
    left = {"b": 1, "c": 9}

    async def hook(x):
        import asyncio

        await asyncio.sleep(0.03 * (x == "a"))
        if left.get(x, 0) > 0:
            left[x] -= 1
            raise ValueError(x)
        if x == "slow":
            await asyncio.sleep(9)
        return x.upper()

    got = models.run_bounded(hook, ["a", "b", "c", "slow", "", "a"], models.Bounds(in_flight=2, tries=2, seconds=0.5, pause=0.01))
    assert got == [("A", None), ("B", None), (None, "ValueError: c"), (None, "TimeoutError: "), ("", None), ("A", None)]
    assert models.run_bounded(hook, []) == []


def test_a_hook_is_called_once_a_distinct_text_and_few_times_at_once(spark, tmp_path):
    texts = [f"t{i % 37}" for i in range(500)] + [None, "bad", "bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(6)
    out = models.call_distinct(df, counting_hook(tmp_path, fails=("bad",)), "text", bounds=models.Bounds(in_flight=3, tries=2, pause=0.01))
    for _ in range(2):  # a second reader calls nothing again
        rows = {r.id: (r.output, r.error) for r in out.collect()}
    assert rows == {i: (None, None) if t is None else (None, "ValueError: bad") if t == "bad" else (t.upper(), None) for i, t in enumerate(texts)}
    calls = [p.read_text() for p in tmp_path.iterdir()]
    assert sorted(calls) == sorted([f"t{i}" for i in range(37)] + ["bad"] * 2)
    assert max(int(p.name.split("-")[1]) for p in tmp_path.iterdir()) <= 3
    assert models.call_distinct(df.limit(0), counting_hook(tmp_path), "text").count() == 0


def test_coroutine_hooks_serve_where_batch_hooks_do(spark):
    async def vector(x):
        return [float(len(x)), 1.0] if x else None

    rows = models.with_embeddings(spark.createDataFrame([("ab",), ("",)], "text string"), vector).collect()
    assert [r.embedding for r in rows] == [[2.0, 1.0], None]


@pytest.mark.parametrize("spread,most", [(0.1, 0.3), (30.0, 1.0)])
def test_pivots_find_the_nearest_and_spare_distances(spark, tmp_path, spread, most):
    """Clustered vectors and scattered ones; ties, copies, null vectors, other lengths, more neighbours than vectors."""
    import math

    from tessella.operators.pivots import PivotIndex

    rng = random.Random(15)
    centres = [[rng.gauss(0, 10) for _ in range(5)] for _ in range(8)]
    draw = lambda: [float(round(c + rng.gauss(0, spread), 2)) for c in rng.choice(centres)]
    rows = [(i, draw()) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    asked = [(f"q{i}", rows[i][1] if i % 2 else draw()) for i in range(25)]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([*rows, (2000, None), (2001, [1.0]), (2002, [])], schema).withColumn("cell", F.lit("clash")).repartition(4)
    q = spark.createDataFrame([*asked, ("null", None), ("short", [1.0])], "qid string, embedding array<double>")
    index = PivotIndex.build(df, n=16, path=f"file://{tmp_path}/index")
    assert index.size.sum() == len(rows)
    for k in (1, 7):
        want = {(name, n): (i, round(d, 9)) for name, v in asked for n, (d, i) in enumerate(sorted((math.dist(x, v), i) for i, x in rows)[:k], 1)}
        found, told = index.nearest(q, k)
        assert {(r.qid, r["rank"]): (r.vec_id, round(r.distance, 9)) for r in found.collect()} == want
        computed, pairs = told.first()
        assert pairs == len(asked) * len(rows) and 0 < computed <= most * pairs
    everything, _ = index.nearest(q.limit(3), 10_000)
    assert everything.count() == 3 * len(rows)
    empty = PivotIndex.build(df.limit(0), path=f"file://{tmp_path}/none")
    assert empty.nearest(q, 3)[0].count() == 0 and empty.nearest(q, 3)[1].first() == (0, 0)


def test_nearest_vectors_equal_plain_distances(spark, monkeypatch):
    """Small steps and whole batches; ties, copies, far offsets, null vectors and other lengths."""
    import math

    from tessella.operators import nearest

    rng = random.Random(12)
    draw = lambda: [float(rng.randint(-3, 3)) + 1000 * (rng.random() < 0.1) for _ in range(4)]
    rows = [(i, draw()) for i in range(300)] + [(400, None), (401, [1.0] * 5), (402, [])]
    asked = [(f"q{i}", draw()) for i in range(20)] + [("five", [1.0, 2.0, 3.0, 4.0, 5.0]), ("null", None)]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame(asked, "qid string, embedding array<float>")
    want = {}
    for name, v in asked:
        near = sorted((math.dist(x, v), i) for i, x in rows if v and x and len(x) == len(v))[:7]
        want |= {(name, n): (i, round(d, 9)) for n, (d, i) in enumerate(near, 1)}
    for cells in (2_000_000, 100):
        monkeypatch.setattr(nearest, "CELLS", cells)
        got = retrieval.vector_topk(c, q, 7, min_score=0.0).collect()
        assert {(r.qid, r["rank"]): (r.vec_id, round(r.distance, 9)) for r in got} == want


def test_terms_are_counted_as_python_counts_them(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("aabกé") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(80)] + [(90, None), (91, ""), (3, "aaaa")]
    terms = list({word(rng.randint(1, 4)) for _ in range(60)} | {"aa", "aaa", "", "zz"})
    df = spark.createDataFrame(texts, "doc_id int, text string").withColumn("term", F.lit("x")).repartition(4)
    names = spark.createDataFrame([(t,) for t in [*terms, None, "aa"]], "term string")
    want = sorted((i, t, x.count(t)) for i, x in texts for t in terms if x and t and t in x)
    assert sorted(map(tuple, patterns.find_terms(df, names, "doc_id").collect())) == want and len(want) > 300
    assert sorted(map(tuple, patterns.find_terms(df, names, "doc_id", limit=7).collect())) == want
    assert patterns.find_terms(df, names.limit(0), "doc_id").count() == 0 == patterns.find_terms(df.limit(0), names, "doc_id").count()


def test_lexical_batches_equal_the_column_form(spark, monkeypatch):
    """In one block or several, whole or the best of each batch, ties included."""
    from tessella.functions import scoring
    from tessella.functions.text import search_terms

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 3)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(200, None), (201, "")], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", " ".join(word().upper() for _ in range(rng.randint(1, 6)))) for i in range(40)] + [("none", ""), ("null", None)], "qid string, question string")
    plain = docs.crossJoin(asked.select("qid", search_terms("question").alias("t"))).select("qid", "doc_id", F.round(scoring.lexical_score(F.col("t"), "text"), 9).alias("s")).where("s > 0").collect()
    want = {(r.qid, r.doc_id): r.s for r in plain}
    rounded = lambda df: {(r.qid, r.doc_id): round(r.score, 9) for r in df.collect()}
    assert rounded(retrieval.lexical_scores(docs, asked, "doc_id")) == want and len(want) > 1000
    best = {}
    for q, i in sorted(want, key=lambda p: (-want[p], p[1])):
        best.setdefault(q, []).append(i)
    for limit, cells in ((20_000, 2_000_000), (9, 100)):
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", limit)
        monkeypatch.setattr(patterns, "CELLS", cells)
        top = retrieval.top_lexical(docs, asked, 4, "doc_id").collect()
        assert {(r.qid, r["rank"]): r.doc_id for r in top} == {(q, n): i for q, ids in best.items() for n, i in enumerate(ids[:4], 1)}


def run_stream(frame, checkpoint):
    """The query and the rows of what it had not read before."""
    out = []
    q = frame.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, out


STATUS = "job_id string, seq long, updated_at double, stage string, message string, extra map<string,string>, reset boolean"


def merged_plainly(rows):
    """The job table as one process would hold it: a dictionary a job, updated in order of time."""
    held = {}
    for job, _, at, stage, message, extra, reset in sorted(rows, key=lambda r: (r[2], r[1])):
        if reset:
            held[job] = {}
        held.setdefault(job, {}).update({"stage": stage, "message": message} | (extra or {}))
    return held


def status_rows(n=400, jobs_=9, seed=3):
    rng = random.Random(seed)
    key = lambda: rng.choice(("pages", "files", "stage", "folder", "kind"))
    return [
        (rng.choice([f"j{k}" for k in range(jobs_)] + ["hot"] * jobs_), i, float(rng.randint(0, n // 3)), rng.choice(("scrape", "ocr", "done")), rng.choice(("", None, "m")), rng.choice((None, {}, {key(): str(i)}, {key(): None})), rng.random() < 0.05)
        for i in range(n)
    ]


def test_merged_status_keeps_keys_that_were_set_earlier(spark):
    rows = status_rows()
    df = spark.createDataFrame(rows, STATUS).repartition(4)
    out = summaries.merged_status(df, order=["updated_at", "seq"]).collect()
    assert {r.job_id: r.status for r in out} == merged_plainly(rows)
    assert all(r.stage == r.status["stage"] and r.updated_at == max(x[2] for x in rows if x[0] == r.job_id) for r in out)
    assert summaries.merged_status(df.limit(0)).count() == 0
    one = spark.createDataFrame([("j", 1, 1.0, "scrape", "", {"a": "1"}, True), ("j", 2, 2.0, "ocr", "", None, None), (None, 3, 1.0, None, None, {"stage": "done"}, False)], STATUS)
    assert {r.job_id: (r.status, r.terminal) for r in summaries.merged_status(one).collect()} == {"j": ({"stage": "ocr", "message": "", "a": "1"}, False), None: ({"stage": "done", "message": None}, True)}


def test_merged_status_of_a_stream_equals_the_batch(spark, tmp_path):
    """Three batches, with events that come late and resets between them."""
    rows = status_rows(300)
    random.Random(1).shuffle(rows)
    src = str(tmp_path / "in")
    out = {}
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], STATUS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(STATUS).parquet(src)
        out |= {r.job_id: r.status for r in run_stream(jobs.merged_status(stream), str(tmp_path / "c"))[1]}
        assert out == merged_plainly(rows[: (k + 1) * 100])
    batch = summaries.merged_status(spark.createDataFrame(rows, STATUS), order=["updated_at", "seq"]).collect()
    assert out == {r.job_id: r.status for r in batch}


def test_log_ring_writes_new_entries_alone(spark, tmp_path):
    schema = "job_id string, ts double, message string, level string"
    src, check = str(tmp_path / "in"), str(tmp_path / "c")
    logs = {}
    for k, per_job in enumerate((30, 1, 0, 25)):
        rows = [(f"j{j}", float(100 * k + i), f"{k}/{i}", "INFO") for j in range(200 if k != 1 else 20) for i in range(per_job)] + [("late", 5.0 - k, f"late{k}", None)]
        for job, _, message, _ in rows:
            logs.setdefault(job, []).append(message)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q, rows_out = run_stream(jobs.capped_log(stream, "job_id", "ts", "message", cap=20, level="level"), check)
        told = {r.job_id: (r.appended, r.entries, r.last_message) for r in rows_out}
        assert told == {j: (sum(r[0] == j for r in rows), min(20, len(logs[j])), logs[j][-1]) for j in {r[0] for r in rows}}
        changed = sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"])
        assert changed <= sum(min(20, n) + 2 for n, *_ in told.values())
    got = {}
    for r in jobs.log_entries(spark, check, tail=7, cap=20).orderBy("place").collect():
        got.setdefault(r.job_id, []).append(r.message)
    assert got == {j: m[-7:] for j, m in logs.items()}


def test_stream_into_the_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.init()
    src = str(tmp_path / "in")
    spark.createDataFrame([("n", "t1", 1), ("n", "t2", 2)], "namespace string, text string, chunk_index int").write.parquet(src)
    for k in (1, 2):  # the same files again change nothing
        q = jobs.ingest_stream(spark, src, "namespace string, text string, chunk_index int", s, lambda b: b, str(tmp_path / f"c{k}"))
        q.awaitTermination()
    assert s.chunks().count() == 2


def test_answers_from_numbered_sources(spark):
    from tessella.plans import answers

    text = "Intro 1. Pet Parent สัตว์เลี้ยงยังคงสำคัญมาก 2. Clean Energy ลดคาร์บอน 2. Clean Power ลดคาร์บอนให้ได้มากกว่าเดิม 3. Other thing นี้"
    df = spark.createDataFrame([(1, "3 trends มีอะไรบ้าง", text), (2, "about clean energy เท่าไร", text), (3, "9 trends", "1. One สอง")], "qid int, question string, source_text string")
    lists = {r.qid: r for r in answers.numbered_list_answers(df).collect()}
    assert lists[1].n_items == 3 and "2. Clean Power: ลดคาร์บอนให้ได้มากกว่าเดิม" in lists[1].answer.split("\n")
    assert 3 not in lists
    focus = {r.qid: r.answer for r in answers.focus_answers(df).collect()}
    assert focus.keys() == {2} and focus[2].startswith("บทความระบุว่า Clean Power คือ")  # as many phrases, more text
    best = {r.qid: r for r in answers.article_answers(df).collect()}
    assert best[2].title == "Clean Energy" and best[2].match_score == 1


def test_a_table_function_reads_files(spark):
    """Laterally and in SQL; a file that fails halfway keeps what came before, and costs no other."""
    from tessella.sources import page_tables

    def extract(content):
        for n, t in enumerate(content.decode().split("|"), 1):
            if t == "bad":
                raise ValueError("no page")
            yield n, t

    files = spark.createDataFrame([("a", bytearray(b"x|y")), ("b", bytearray(b"z|bad|w")), ("c", None), ("d", bytearray(b"\xff"))], "path string, content binary").withColumn("page", F.lit("clash"))
    want = {("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, "z", None), ("b", None, None, "ValueError: no page")}
    rows = page_tables.page_rows(files, extract, "n int, t string").collect()
    assert {tuple(r) for r in rows if r.path != "d"} == want and [r.problem.split(":")[0] for r in rows if r.path == "d"] == ["UnicodeDecodeError"]
    spark.udtf.register("pages_of", page_tables.page_table(extract, "n int, t string"))
    sql = spark.sql("SELECT f.path, p.* FROM {files} f, LATERAL pages_of(f.path, f.content) p WHERE f.path <> 'd'", files=files)
    assert {tuple(r) for r in sql.collect()} == want
    with pytest.raises(Exception, match="path string, content binary"):
        spark.sql("SELECT * FROM pages_of(1, 'x')").collect()
    assert page_tables.page_rows(files.limit(0), extract, "n int, t string").count() == 0


def test_pages_of_files(spark, tmp_path):
    for n, b in (("a.pdf", b"one|two"), ("b.pdf", b"bad")):
        (tmp_path / n).write_bytes(b)

    def extract(content):
        if content == b"bad":
            raise ValueError
        return [(i, t.decode(), None, None) for i, t in enumerate(content.split(b"|"), 1)]

    rows = readers.extract_pages(readers.pdf_files(spark, str(tmp_path), content=True), extract).orderBy("path", "page").collect()
    assert [(r.path[-5:], r.page, r.layer) for r in rows] == [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("b.pdf", 0, None)]
