"""Native operators stay native: no Python in their plans, and shuffles only where they are due."""

import pytest

from tessella.llm import queries

QUERIES = queries.queries()


@pytest.mark.parametrize("name", ["op6_sharding", "op8_quality_rules", "op9_license_scan"])
def test_native(spark, sf_dir, name):
    p = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    if name != "op6_sharding":
        assert "Exchange" not in p


@pytest.mark.parametrize("name", ["op5_html_extraction", "op7_sentencepiece"])
def test_scans_do_not_shuffle(spark, sf_dir, name):
    p = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "MapInArrow" in p
