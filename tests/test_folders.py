"""Folders as a scraper leaves them, and stages that resume."""

import json

import pytest
from pyspark.sql import functions as F

from tessella import models
from tessella.operators import store, summaries
from tessella.plans import file_queries, folder_queries, ingestion, stages
from tessella.plans.stages import Stage, Stages
from tessella.sources import readers


@pytest.fixture()
def folder(tmp_path):
    def put(name, text):
        p = tmp_path / "main" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("1_one/content.txt", "Home\nAn introduction of some length, with a stop.\n1. First part\nIt says a thing or two, at length.\n2. Second part\nIt says some more, at the same length.")
    put("1_one/page_meta.json", json.dumps({"source_url": " https://one.example.com ", "title": "One", "more": [1]}))
    put("1_one/outline.json", json.dumps([{"order": 1, "title": "- First title:"}, {"order": "2", "title": "Second title"}, {"order": "x", "title": "no"}, {"order": 3, "title": ""}, "no object"]))
    put("1_one/images_understanding.jsonl", "\n".join([
        json.dumps({"type": "image_understanding", "image_path": "/i/1", "caption_en": "a chart of sales by year", "keep_for_rag": True, "relevance_score": 0.25}),
        "not json", json.dumps({"type": "image_understanding", "image_path": "/i/2", "caption_en": "dropped one here", "keep_for_rag": False}), "", '{"type": "cut', "[1, 2]",
        json.dumps({"type": "image_understanding", "image_path": "/i/3", "keep_for_rag": True, "is_duplicate": True}),
    ]))
    put("2_two/content.txt", b"Only text here, \xffwithout any meta and without sections.")
    put("2_two/outline.json", "[{")
    put("3_three/page_meta.json", "[]")
    put("other/content.txt", "This is no site folder, as its name has no number.")
    put("ocr_results/a/docs.jsonl", "\n".join([
        json.dumps({"type": "page_text", "source_pdf": "/p.pdf", "page": 2, "text": "The second page of a file, with a number of words."}),
        json.dumps({"type": "figure", "image_path": "/f/1", "page": 2, "image_ocr": "  short  "}), json.dumps({"type": "figure", "image_path": "/f/2", "image_ocr": "A figure whose text is long enough to stay."}), '{"page": "x"}', "null",
    ]))
    return f"file://{tmp_path}/main"


def test_a_folder_is_read_whole_and_its_faults_are_told(spark, folder):
    found = ingestion.read_folder(spark, folder, "external")
    texts = {(r.source_type, r.source_url, r.source_path.rsplit("/", 2)[-2], r.page, r.text) for r in found.texts.collect()}
    assert texts == {
        ("web_page", "https://one.example.com", "1_one", 0, "An introduction of some length, with a stop."),
        ("web_page", "https://one.example.com", "1_one", 0, "1. First part\nIt says a thing or two, at length."),
        ("web_page", "https://one.example.com", "1_one", 0, "2. Second part\nIt says some more, at the same length."),
        ("web_page", "", "2_two", 0, "Only text here, without any meta and without sections."),
        ("web_image_caption", "", "i", 0, "caption_th: \ncaption_en: a chart of sales by year\nimage_type: other\nrelevance_score: 0.25"),
        ("pdf_page", "", "", 2, "The second page of a file, with a number of words."),
        ("pdf_figure_ocr", "", "f", 0, "A figure whose text is long enough to stay."),
    }
    assert {(r.entity, r.year, r.value) for r in found.facts.collect()} == {("One", 1, "First title"), ("One", 2, "Second title")}
    errors = sorted((r.kind, r.file.rsplit("/", 2)[-2], r.problem, r.record) for r in found.errors.collect())
    assert errors == sorted([
        ("content", "2_two", "not UTF-8", None), ("outline", "2_two", "no document of the schema", "[{"), ("meta", "3_three", "no document of the schema", "[]"),
        *[("images", "1_one", "no object of the schema", x) for x in ("not json", '{"type": "cut', "[1, 2]")], *[("ocr", "a", "no object of the schema", x) for x in ('{"page": "x"}', "null")],
    ], key=lambda e: (e[0], e[1], e[2], e[3] or ""))
    assert [r.image_path for r in found.skipped.collect()] == ["/f/1"]


def test_packed_files_are_read_as_files_are(spark, folder, tmp_path):
    for kind in ("content", "meta", "outline"):
        readers.pack(spark.read.format("binaryFile").load(f"{folder}/{ingestion.PLACES[kind]}"), f"{folder}/{kind}.parquet")
    packed = ingestion.read_folder(spark, folder, "external", {k: f"{k}.parquet" for k in ("content", "meta", "outline")})
    plain = ingestion.read_folder(spark, folder, "external")
    for name in ("texts", "facts", "errors", "skipped"):
        a, b = ([tuple(r) for r in getattr(x, name).collect()] for x in (packed, plain))
        assert sorted(a, key=repr) == sorted(b, key=repr) and a, name
    nothing = ingestion.read_folder(spark, f"file://{tmp_path}/none", "external", {"content": "content.parquet"})
    assert nothing.texts.count() == 0


def _suppliers(spark, sf_dir, tmp_path, rows):
    for name in ("part", "customer"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").limit(1).drop("s_suppkey")
    s.crossJoin(spark.range(1, rows + 1, 1, 2).withColumnRenamed("id", "s_suppkey")).write.parquet(f"file://{tmp_path}/supplier.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("module, name", [(folder_queries, "scraped"), (file_queries, "pdf_folder")])
def test_folders_of_queries_are_no_file_a_supplier(spark, sf_dir, tmp_path, monkeypatch, module, name):
    monkeypatch.setattr(module, "scratch", lambda _: f"file://{tmp_path}/scratch")
    getattr(module, name)(spark, _suppliers(spark, sf_dir, tmp_path, 300))
    assert 0 < len(list((tmp_path / "scratch").rglob("part-*"))) < 60


def test_a_folder_goes_into_a_store(spark, folder, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.init()
    for _ in range(2):  # the second time changes nothing
        row = ingestion.ingest_folder(spark, folder, "external", models.hash_embedding(8), s, models.pattern_fact_extractor).first()
        assert (row.added_chunks, row.added_facts, row.skipped, row.errors) == (7, 2, 1, 8)
        assert s.chunks().count() == 7 and s.facts().count() == 2
    nothing = ingestion.read_folder(spark, f"file://{tmp_path}/none", "external")
    assert nothing.texts.count() == nothing.facts.count() == nothing.errors.count() == 0


class Broken(Exception):
    pass


def test_a_rerun_goes_on_behind_the_last_finished_stage(spark, tmp_path):
    calls = []

    def step(name, fails=()):
        def run(*tables):
            calls.append(name)
            if len([c for c in calls if c == name]) in fails:
                raise Broken(name)
            return tables[0].withColumn(name, F.lit(len(calls)))

        return run

    plan = [Stage("a", ("src",), step("a")), Stage("b", ("a",), step("b", fails=(1,))), Stage("c", ("a", "b"), step("c"))]
    src = spark.range(5).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    job = Stages(spark, f"file://{tmp_path}/job", "j1")
    with pytest.raises(stages.StageFailed) as e:
        job.run(plan, {"src": src})
    assert isinstance(e.value.__cause__, Broken) and calls == ["a", "b"]
    status = summaries.merged_status(job.events(), order=["updated_at", "seq"]).first()
    assert (status.stage, status.status["failed_stage"], status.status["a_rows"], status.terminal) == ("error", "b", "5", True)

    out = Stages(spark, f"file://{tmp_path}/job", "j1").run(plan, {"src": src.repartition(3)})  # other order, same rows
    assert calls == ["a", "b", "b", "c"] and out["c"].columns == ["id", "m", "a", "c"]
    status = summaries.merged_status(job.events(), order=["updated_at", "seq"]).first()
    assert status.stage == "done" and status.status["c_rows"] == "5" and "failed_stage" not in status.status
    report = "".join(p.read_text() for p in sorted((tmp_path / "job/report").glob("part*")))
    assert report.startswith("# j1\n") and "- stage: a | rows: 5 | reused: true\n" in report and "- stage: c | rows: 5 | reused: false\n" in report

    job.run([plan[0], Stage("b", ("a",), step("b"), version="2"), plan[2]], {"src": src})
    assert calls == ["a", "b", "b", "c", "b", "c"]
    job.run(plan, {"src": src.where("id < 3")})
    assert calls[-3:] == ["a", "b", "c"] and len(calls) == 9


def test_an_output_without_its_marker_is_made_again(spark, tmp_path):
    made = []
    plan = [Stage("a", ("src",), lambda df: (made.append(1), df)[1])]
    job = Stages(spark, f"file://{tmp_path}/job", "j")
    job.run(plan, {"src": spark.range(3)})
    for p in (tmp_path / "job/stages").glob("a-*.committed/_SUCCESS"):
        p.unlink()
    assert job.run(plan, {"src": spark.range(3)})["a"].count() == 3 and len(made) == 2


def test_stages_of_the_external_pipeline_resume(spark, sf_dir, tmp_path):
    job = Stages(spark, f"file://{tmp_path}/job", "external")
    sources = folder_queries.external_sources(spark, sf_dir)
    first = {k: v.count() for k, v in job.run(folder_queries.external_stages(), sources).items()}
    again = {k: v.count() for k, v in job.run(folder_queries.external_stages(), sources).items()}
    assert first == again
    assert job.events().where("message = 'reused'").count() == 5
