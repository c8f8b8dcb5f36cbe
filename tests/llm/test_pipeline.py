from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tallyfold.llm import language_id
from tallyfold.llm.queries import QUERIES, SQL
from tests.llm.conftest import SMALL


def test_every_operator_is_registered():
    names = contract.queries()
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected = connection.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(expected.fetchall())


def test_stages_take_effect(spark, small, tmp_path):
    docs, sizes = small["documents"], []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SMALL)
        if at < 4:
            assert made.schema == docs.schema
        made.write.parquet(f"file://{tmp_path}/{at}")
        docs = spark.read.parquet(f"file://{tmp_path}/{at}")
        sizes.append(docs.count())
    total = small["documents"].count()
    predicted = language_id.languages(small["documents"])
    assert sizes[0] == total - predicted.where("lang_pred = 'und'").count()
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    kept = {r.doc_id for r in spark.read.parquet(f"file://{tmp_path}/3").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() == sizes[4]


def test_odd_and_empty_inputs(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMALL)
            assert at == 4 or docs.columns == odd_docs.columns
        assert docs.count() >= 0
