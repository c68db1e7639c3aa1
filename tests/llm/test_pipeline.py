"""The registered queries and the pipeline on the smallest tables."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from marketpulse.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name])
    assert ok, note


def test_registered():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            texts = [r["text"] for r in docs.collect()]
            assert 0 < len(texts) <= count
            count = len(texts)
            if k == 1:
                assert len({"".join(t.split()) for t in texts}) == count
    assert docs.where("length > 2048").count() == 0
