"""Every query of the library: against its SQL, or at least that it runs whole."""

import pytest
from compare import connect, oracle_rows, rows_of

from tessella import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf_dir, name):
    names, got = rows_of(QUERIES[name](spark, sf_dir))
    wanted_names, wanted = oracle_rows(con, SQL[name])
    assert names == wanted_names
    assert got == wanted


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8


def test_search_terms_of_whole_texts(spark, tmp_path):
    import hashlib
    import re

    from tessella.functions.constants import SEARCH_STOPWORDS

    texts = {1: "word " * 600 + "late Term and ends with café", 2: " ".join(f"w{i}" for i in range(3000)), 3: "short one", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in texts.items():
        terms = [w for w in dict.fromkeys(re.findall(r"\w{2,}", (t or "").lower())) if w not in SEARCH_STOPWORDS]
        want[i] = (len(terms), hashlib.sha1(" ".join(terms).encode()).hexdigest())
    got = {r.doc_id: (r.n_terms, r.digest) for r in QUERIES["search_terms"](spark, str(tmp_path)).collect()}
    assert got == want


def test_numbered_queries_use_every_line(spark, tmp_path):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    lines = {d: [f"Line {word(d)} {word(i)} สัตว์ end" for i in range(n)] for d, n in ((1, 250), (2, 9), (3, 99), (4, 100), (5, 3), (6, 0))}
    rows = [(d, "\n".join(x), "s", "en") for d, x in lines.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    want = {(d, i): s for d, x in lines.items() for i, s in enumerate(x, 1)}
    assert {(r.doc_id, r.number): r.title for r in run("numbered_sections")} == want
    profiles = run("trend_profiles")
    assert len(profiles) == len(want) and {(r.doc_id, r.order) for r in profiles} == want.keys()
    lists = run("numbered_list_answers")
    assert sorted(r.qid for r in lists) == sorted(f"s/{d}/{b + 1}" for d, x in lines.items() for b in range(-(-len(x) // 5)) if len(x) - 5 * b >= 3)
    text = "\n".join(r.answer for r in lists)
    assert all(word(i) in text for i in range(250))
    for name in ("focus_answers", "article_answers"):
        assert {r.qid for r in run(name)} == {f"s/{d}/{b + 1}" for d, x in lines.items() for b in range(-(-len(x) // 9))}, name
