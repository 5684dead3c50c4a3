"""Registered queries against their SQL, the pipeline against a brute-force one, and the plans' shape."""

import collections
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from parchmill.llm import exact, jaccard, mixing, oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations", "benchmark")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return db


def test_one_query_per_operator():
    names = [re.match(r"op(\d+)_", q)[1] for q in queries.registered()]
    assert sorted(names, key=int) == ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13"]
    assert {*queries.registered(), "pipeline"} <= set(entry.queries())
    assert set(oracle.registered()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.registered()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.registered()[name](spark, DATA).toPandas()
    want = duck.execute(oracle.registered()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op3_pii_surrogates", "op5_mix_sources", "op9_exact_dedup"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.registered()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]

    known = stages["language ID"](spark, docs, DATA)
    assert known.columns == columns
    gone = {r.doc_id for r in docs.select("doc_id", "text").collect()} - {r.doc_id for r in known.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(not any(map(str.isalpha, texts[i] or "")) for i in gone)

    single = stages["exact dedup"](spark, docs, DATA)
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(first.values())

    apart = stages["n-gram Jaccard join"](spark, docs, DATA)
    decided = jaccard.similar_documents(docs, 5, 80).collect()
    assert sorted(r.doc_id for r in apart.collect()) == sorted(r.doc_id for r in decided if r.doc_id == r.component_id)

    mixed = stages["mixing sources to target weights"](spark, docs, DATA)
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect()}
    assert mixed.columns == columns and {i: n for i, n in taken.items() if n} == dict(words)

    again = stages["mixing sources to target weights"](spark, docs.repartition(7), DATA)
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, mixed.collect()))

    packed = stages["packing"](spark, mixed, DATA)
    assert {r.doc_id for r in packed.collect()} == set(words)


def test_pipeline_keeps_one_row_of_each_text(spark):
    rows = [(1, "a  b"), (1, "a b"), (None, "a b"), (None, "c"), (None, "c "), (None, "c\t"), (2, "d"), (2, "d"), (3, "d"), (2, "e"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(corpus_pipeline.STAGES)["exact dedup"](spark, docs, DATA).collect()
    assert sorted((str(r.doc_id), (r.text or "").replace("  ", " ").replace("\t", " ")) for r in got) == [
        ("1", "a b"), ("2", "d"), ("2", "e"), ("4", ""), ("None", "c"), ("None", "c ")
    ]


def test_pipeline_runs_over_empty_and_whole_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_filter_is_never_wrong_when_full(spark, monkeypatch):
    from parchmill.llm import bitmaps

    monkeypatch.setattr(bitmaps, "MOST_BITS", bitmaps.PIECE_BITS)
    docs = spark.range(60_000).selectExpr("id as doc_id", "concat('t', id % 50000) as text")
    got = exact.mark_duplicates(docs)
    assert got.filter("kept").count() == 50_000 and got.filter("group_size = 2").count() == 20_000
