"""Every query of the subpackage at the smallest scale; those with SQL against it."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skyhive.llm import queries
from skyhive.registry.check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_matches_sql(llm_spark, name):
    text, _, same = compare(llm_spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert same, text


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_against_its_parts(llm_spark):
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(llm_spark, docs, SF).cache()
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}, name
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and len(now) == len(set(now))
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](llm_spark, docs, SF)
    rows = {tuple(r) for r in packed.select("doc_id", "start", "length", "ids_crc32").collect()}
    whole = {tuple(r) for r in corpus_pipeline.run(llm_spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert rows == whole and {r[0] for r in rows} == ids
