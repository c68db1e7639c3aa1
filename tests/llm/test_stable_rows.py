"""Row numbers, and the operators that use them, under other file splits and without the package on the workers."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from marketpulse.llm import common, exact_dedup, mixing, ngram_join

SF = "/root/testdata/sf0.01"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12).write.parquet(path)
    return spark.read.parquet(path)


def under(spark, cores, make):
    """The rows of ``make()``, built with one split of the files and run with another."""
    key = "spark.sql.leafNodeDefaultParallelism"
    spark.conf.set(key, "12")
    df = make()
    spark.conf.set(key, str(cores))
    try:
        return df.collect()
    finally:
        spark.conf.unset(key)


def test_row_numbers(spark, docs):
    one = {r["doc_id"]: r["_row_id"] for r in under(spark, 12, lambda: common.with_rows(docs))}
    two = {r["doc_id"]: r["_row_id"] for r in under(spark, 2, lambda: common.with_rows(docs.where("doc_id % 2 = 0")))}
    assert len(set(one.values())) == 1000 and len(two) == 500 and all(one[k] == v for k, v in two.items())
    clash = docs.withColumns({"rid": F.lit("x"), "_rid": F.lit(1), "a.b": F.lit(2)})
    assert common.with_rows(clash).columns == [*clash.columns, "_row_id"]
    with pytest.raises(ValueError):
        common.with_rows(docs.groupBy("doc_id").count())


def test_copies_and_mix(spark, docs):
    kept = under(spark, 2, lambda: exact_dedup.without_copies(docs))
    plain = {"".join(r["text"].split()) for r in docs.collect()}
    assert len(kept) == len({"".join(r["text"].split()) for r in kept}) == len(plain)
    words = {n: sum(len(r["text"].split()) for r in under(spark, n, lambda: mixing.mixed_documents(docs)) if r["source"] == "src0") for n in (12, 2)}
    assert words[12] == words[2] > 0


def test_similar(spark, docs):
    rows = [sorted(map(tuple, under(spark, n, lambda: ngram_join.similar_groups(docs).drop("rid")))) for n in (12, 2)]
    assert rows[0] == rows[1] and sum(r[4] for r in rows[0]) > 0


SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from marketpulse.llm import queries
from marketpulse.session import local_session
spark = local_session("4")
for name in sys.argv[1:]:
    print(name, queries.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_without_the_package(tmp_path):
    """Workers start in another folder and cannot import the package."""
    names = [n for n in __import__("marketpulse.llm.queries", fromlist=["x"]).queries()]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(__import__("public_tokenizers").__file__)}
    (tmp_path / "run.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith("op")]) == len(names)
