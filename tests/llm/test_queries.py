import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontoloom.llm import decontaminate, packing, quality, secrets, simhash
from ontoloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_pipeline_equals_its_operators_by_hand(spark, tmp_path):
    """run() against the stages' own per-document results, put together in Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in after.collect()}
        if name == "quality_rules":
            assert set(rows) == {r.doc_id for r in quality.rate(docs).collect() if r.kept}
        elif name == "near_dedup":
            assert set(rows) == {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id == r.component_id}
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert set(rows) == {r.doc_id for r in decontaminate.contaminated(docs, bench).collect() if not r.n_hit}
        else:
            assert set(rows) == set(before)
            for i, r in rows.items():
                text, at = before[i].text, 0
                want = []
                for a, _, b, _ in secrets.find(text):
                    want += [text[at:a], "[REDACTED]"] if a >= at else []
                    at = max(at, b)
                assert r.text == "".join(want) + text[at:] and r.n_chars == len(r.text)
        docs = after
    want = packing.pack(docs).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"))
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Workers of a driver that found the package by sys.path alone cannot import it."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(corpus_pipeline.__file__).parent)!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op2_decontaminate", "op3_warc", "op10_language_id"):
    print(name, __spark_entry__.queries()[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "op10_language_id" in done.stdout, done.stderr[-3000:]
