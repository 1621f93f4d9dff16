"""Physical plans: what is shuffled, limited and read."""

import pytest
from pyspark.sql import functions as F

from tessella import catalog

QUERIES = catalog.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sentence_split", "fallback_chunks", "menu_lines", "text_flags", "fact_chunk_score", "search_terms", "route_questions", "char_split", "boilerplate_lines"])
def test_text_rules_do_not_shuffle_or_leave_the_jvm(spark, sf_dir, name):
    p = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in p and "Python" not in p


@pytest.mark.parametrize("name", ["semantic_topk", "batch_knn", "lexical_batch"])
def test_ranks_are_limited_before_the_exchange(spark, sf_dir, name):
    p = plan(QUERIES[name](spark, sf_dir))
    assert "WindowGroupLimit" in p and "SortMergeJoin" not in p


@pytest.mark.parametrize("name", ["dedupe_rows", "job_latest_status", "distinct_warnings"])
def test_first_and_latest_rows_aggregate_before_the_exchange(spark, sf_dir, name):
    p = plan(QUERIES[name](spark, sf_dir))
    assert "partial_m" in p and "Window" not in p


def test_scans_read_what_they_need(spark, sf_dir):
    p = plan(QUERIES["eval_summary"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in p
    p = plan(QUERIES["route_questions"](spark, sf_dir))
    assert "EqualTo(role,user)" in p


def test_previews_take_the_top_rows(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["preview_chunks"](spark, sf_dir))


def test_ids_are_dealt_as_bytes_before_they_are_counted(spark, sf_dir):
    p = plan(QUERIES["fact_ids"](spark, sf_dir))
    assert "REPARTITION_BY_COL" in p and "unhex(sha1" in p


def test_an_upsert_writes_its_rows_once(spark, tmp_path, monkeypatch):
    from tessella import tables
    from tessella.operators import store

    def refused(_):
        raise AssertionError("an upsert has no intermediate table")

    monkeypatch.setattr(tables, "scratch", refused)
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.init()
    facts = spark.range(2000).selectExpr("'a' AS namespace", "concat('e', id) AS entity", "'k' AS key", "cast(id AS string) AS value", "'u' AS unit")
    s.upsert_facts(facts.where("value < 1000"))
    # Old ones, two with one id of which the least stays, and an id from before.
    s.upsert_facts(facts.unionByName(facts.withColumn("unit", F.lit("t")).where("value = '7'")).where("value <> '8'"))
    got = {r.entity: (r.value, r.unit, r.id) for r in s.facts().collect()}
    assert s.facts().count() == len(got) == 2000 and got["e7"][:2] == ("7", "t") and got["e8"][:2] == ("8", "u")
    want = s.facts().withColumn("i", store.fact_id())
    assert want.where("i <> id").count() == 0
    files = list((tmp_path / "store/facts/namespace=a").rglob("part-*"))
    assert len(files) <= store.BUCKETS * store.BUCKET_PARTS


def test_a_large_upsert_goes_in_passes_and_leaves_no_shuffled_rows(spark, tmp_path, monkeypatch):
    import time

    from tessella.operators import store

    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = [files.apply(i) for i in range(files.size())]
        return {f.getPath(): f.length() for f in found if f.getName().startswith("shuffle_")}

    def left(before):
        """Bytes that stay; files are deleted behind the write, so a few seconds are given."""
        for _ in range(50):
            n = sum(size for path, size in kept().items() if path not in before)
            if n < 500_000:
                break
            time.sleep(0.2)
        return n

    s = store.Store(spark, f"file://{tmp_path}/store")
    s.init()
    facts = spark.range(40000).selectExpr("if(id % 2 = 0, 'a', 'b') AS namespace", "concat('e', id) AS entity", "'k' AS key", "cast(id AS string) AS value", "'u' AS unit", "sha2(cast(id AS string), 256) AS evidence_text")
    before = kept()
    s.upsert_facts(facts.where("value % 3 = 0"))
    assert left(before) < 500_000  # the rows shuffled take more than a million bytes
    monkeypatch.setattr(store, "PASS_BYTES", 2_000_000)
    took = []
    merge = store.Store._merge
    monkeypatch.setattr(store.Store, "_merge", lambda self, name, new, ident, spaces: took.append((new.count(), spaces)) or merge(self, name, new, ident, spaces))
    before = kept()
    new = facts.unionByName(facts.withColumn("unit", F.lit("t")).where("value % 5 = 0")).where("value % 7 <> 0 OR value % 3 <> 0")
    s.upsert_facts(new)
    assert 3 <= len(took) <= 8 and max(n for n, _ in took) < 20000 and sum(n for n, _ in took) == new.count()
    assert sorted(b for _, spaces in took for b in spaces["a"]) == list(range(store.BUCKETS))
    assert left(before) < 500_000
    unit = F.when((F.expr("value % 5 = 0")) & (F.expr("value % 7 <> 0 OR value % 3 <> 0")), "t").otherwise("u")
    want = store.with_defaults(facts.withColumn("unit", unit), store.FACTS).withColumn("id", store.fact_id())
    assert s.facts().count() == 40000 and s.facts().exceptAll(want).count() == 0
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["chunks", "facts"]


def test_a_source_is_ranked_once_for_all_who_ask(spark):
    from tessella.operators import retrieval

    c = spark.range(60).selectExpr("id", "'a' AS namespace", "'u' AS source_url", "concat('p', id % 2) AS source_path", "60 - id AS chunk_index", "'t' AS text")
    ask = spark.createDataFrame([(1, "a", "u", "p0"), (2, "a", "u", "p0"), (3, "a", "u", ""), (4, "a", None, "p1"), (5, "b", "u", "p0"), (6, "a", "", "")], "qid long, namespace string, source_url string, source_path string")
    out = retrieval.expand_source(c, ask, 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.qid, set()).add((r.id, r.text))
    t = lambda *ids: {(i, "t") for i in ids}
    assert got == {1: t(58, 56, 54), 2: t(58, 56, 54), 3: t(59, 58, 57), 4: t(59, 57, 55)}
    assert "hashpartitioning(qid" not in plan(out)


def test_profiles_compute_what_they_read_twice_once(spark, sf_dir):
    from tessella.functions import articles

    steps = QUERIES["trend_profiles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("regexp_") < 60 and steps.count("instr(") < 20
    section = "2.\tPet Parent  สัตว์เลี้ยงยังคงสำคัญ　CAGR)6.5% ตั้งแต่ปี 2024 ถึง 2030 Visa แนวทางธุรกิจ สร้างบริการใหม่สำหรับสัตว์เลี้ยงทั่วประเทศ \n พัฒนาอาหารสัตว์คุณภาพสูงสำหรับทุกวัย ที่มา: x"
    p = spark.createDataFrame([(section,)], "t string").select(articles.profile(F.col("t")).alias("p")).first().p
    assert (p.order, p.title, p.lead) == (2, "Pet Parent", "สัตว์เลี้ยงยังคงสำคัญ CAGR)6.5% ตั้งแต่ปี 2024 ถึง 2030")
    assert (p.stats, p.sources, len(p.actions), p.body[-4:]) == (["CAGR 6.5% ช่วง 2024-2030"], ["Visa"], 2, "Visa")


def test_lists_of_a_source_are_made_in_its_row(spark, sf_dir):
    """For each number the longest description, then title, of what isn't a copy of an earlier title."""
    from tessella.plans import answers

    p = plan(QUERIES["numbered_list_answers"](spark, sf_dir))
    assert "Exchange" not in p and "Window" not in p
    text = "1. One ก 1. ONE กกก 2. Two กก 2. Twin กก 2. Twins กก 3. “a” ข 9. Nine ค"
    df = spark.createDataFrame([(1, "3 trends 1-5", text), (2, "trends 1-5", text), (3, "trends 1-5", "none"), (4, "12 trends", text), (5, "trends 1-5", None)], "qid int, question string, source_text string")
    got = {r.qid: (r.answer.split("\n"), r.n_items) for r in answers.numbered_list_answers(df).collect()}
    three = ["1. One: ก", "2. Twins: กก", "3. a: ข"]
    assert got == {1: (three, 3), 2: ([*three, "9. Nine: ค"], 4)}
    assert {(r.qid, r.order, r.title) for r in answers.numbered_items(df.where("qid = 2")).collect()} == {(2, 1, "One"), (2, 2, "Twins"), (2, 3, "a"), (2, 9, "Nine")}


def test_profiles_of_a_source_are_compared_in_its_row(spark, sf_dir):
    from tessella.plans import answers

    assert "Exchange" not in plan(QUERIES["article_answers"](spark, sf_dir))
    text = "1. Pet Parent ลดคาร์บอน 2. Pet Parent ที่สอง 3. Other นี้"
    df = spark.createDataFrame([(1, "about pet parent", text), (2, "about nothing", text), (3, "about pet parent", "none")], "qid int, question string, source_text string")
    assert [(r.qid, r.title, r.lead, r.match_score) for r in answers.article_answers(df).collect()] == [(1, "Pet Parent", "ลดคาร์บอน", 4)]
    assert {(r.qid, r.order, r.score) for r in answers.trend_profiles(df).collect()} == {(1, 1, 4), (1, 2, 4), (1, 3, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)}
    assert "Exchange" not in plan(answers.article_texts(df))
