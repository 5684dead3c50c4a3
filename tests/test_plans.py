"""The plans are the ones meant for a large cluster."""

import re

import pytest

from parchmill.operators import convert as C
from parchmill.operators import extract as X
from parchmill.operators import results as RS
from parchmill.plans.queries import registered, simple_results

PAGES = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_shuffle_pages_only(spark, no_broadcast):
    text = plan(C.documents(spark.read.parquet(f"{PAGES}/pages.parquet"), "2026-01-03 16:47:00"))
    exchanges = re.findall(r"Exchange (\w+)\((\w+)#", text)
    # The same exchange twice: its second reader takes the files of the first.
    assert set(exchanges) == {("hashpartitioning", "page_id")} and len(exchanges) <= 2
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_exchange_is_shared(spark, no_broadcast):
    df = C.documents(spark.read.parquet(f"{PAGES}/pages.parquet"), "2026-01-03 16:47:00")
    df.write.format("noop").mode("overwrite").save()
    rows = df._jdf.queryExecution()
    rows.toRdd().count()
    assert "ReusedExchange" in rows.executedPlan().toString()


@pytest.mark.parametrize("name", ["documents", "main_content", "store_lookup", "batch_duplicates", "toon_document", "toon_table", "page_files"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(registered()[name](spark, PAGES))
    for banned in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition, REPARTITION"):
        assert banned not in text


def test_columns_are_pruned(spark):
    text = plan(X.tag_tokens(spark.read.parquet(f"{PAGES}/pages.parquet")).select("page_id", "pos"))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text
    counted = plan(RS.select_fields(simple_results(spark, PAGES), "cached"))
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", counted).group(1)


def test_statistics_aggregate_before_the_shuffle(spark):
    text = plan(registered()["batch_stats_by_host"](spark, PAGES))
    assert "partial_count" in text and text.count("Exchange hashpartitioning") == 1
