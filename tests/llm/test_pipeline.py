"""The pipeline at sf0.001 against plain versions of its filters, and the oracles of the queries."""

import re

import duckdb
import pytest
import zstandard

import corpus_pipeline
from dwell.llm import compression_rules, pareto_mix, queries, scratch
from tests.llm.test_corpus_operators import plain_components

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    documents = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    packer = zstandard.ZstdCompressor(level=compression_rules.LEVEL)
    good = [(i, r["text"]) for i, r in sorted(documents.items()) if compression_rules.judge(r["text"].encode(), packer)[6]]
    one = {i for i, _, c in plain_components(good, 5) if i == c}
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    clean = {i for i in one if not any(plain(item) in plain(documents[i]["text"]) for item in items)}
    out = corpus_pipeline.run(spark, SF).collect()
    copies = {r["doc_id"]: r["copies"] for r in pareto_mix.pareto_mix(
        spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id in ({','.join(map(str, clean))})")).collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, n in copies.items() for _ in range(n))
    assert {r["shard"] for r in out} == set(range(8)) and all(r["text"] == documents[r["doc_id"]]["text"] for r in out)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    from tools.check_oracles import rows_of
    scratch.folder(spark)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(con.execute(queries.ORACLES[name]).fetchdf())
