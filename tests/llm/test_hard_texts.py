"""Texts of two million characters of one kind, and results that must not depend on how rows are dealt to tasks."""

import time

import pytest
from pyspark.sql import functions as F

from ontoloom.llm import decontaminate, langid, packing, quality, secrets, simhash, substrings

N = 2_000_000
RUNS = [" " * N, "\n" * N, "\t" * N, " \n" * (N // 2), "a" * N, "#" * N, "0123456789abcdef" * (N // 16), "é" * (N // 2), "<script " * (N // 8), "<!--" * (N // 4), "eyJ" * (N // 3), "token=" * (N // 6), "a " * (N // 2), "password" + " " * N]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard(spark, docs, tmp_path_factory):
    """Long runs among plain texts, with words that would join up over the ends of neighbouring texts."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [*RUNS, "We say so in our privacy", " policy and nothing else of any kind is said in this text, at all.", "lorem", " ipsum dolor sit amet, as every text that means to say nothing says."]
    place = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    docs(texts).write.parquet(place)
    return spark.read.parquet(place)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def dealt(df, operator):
    """The operator's rows with the table in one partition and in seven, and how long the first took."""
    began = time.time()
    one = rows(operator(df.coalesce(1)))
    took = time.time() - began
    assert one == rows(operator(df.repartition(7)))
    assert took < 120
    return one


def test_secrets(hard):
    dealt(hard, lambda df: secrets.scan(df).select("doc_id", F.to_json("findings")))


def test_redaction(hard):
    dealt(hard, lambda df: secrets.redact(df).select("doc_id", F.sha2("text", 256), "n_chars"))


def test_decontamination(spark, hard):
    bench = spark.createDataFrame([(1, "a"), (2, "a a a a a a a a a a a"), (3, "nothing else of any kind is said in this text"), (4, " ")], "item_id long, text string")
    got = dealt(hard, lambda df: decontaminate.contaminated(df, bench).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")))
    # Only the run of single letters is all hit, and the last item lies in one text, not over two.
    whole = [r for r in got if r[1] == r[2] == N // 2]
    assert len(whole) == 1 and whole[0][3] == "1,2" and sum("3" in r[3].split(",") for r in got) == 1


def test_substrings(hard):
    dealt(hard, lambda df: substrings.dedup(df, 5))


def test_quality(hard):
    got = {r[0]: r for r in dealt(hard, lambda df: quality.rate(df))}
    last = max(got)
    # Phrases do not reach over the ends of texts.
    assert got[last][6] == got[last][1] and got[last - 2][6] == got[last - 2][1]
    dealt(hard, lambda df: quality.clean(df).select("doc_id", F.sha2("text", 256), "n_chars"))


def test_near_duplicates(hard):
    dealt(hard, simhash.near_duplicates)
    dealt(hard, lambda df: simhash.keep_one(df).select("doc_id", F.sha2("text", 256)))


def test_packing(hard):
    """Where a document lies depends on the order of tasks, its ids do not."""
    ids = lambda df: packing.pack(df).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("ids").alias("ids")))), lambda x: x["ids"]), ""), 256))
    assert all(n == whole for _, whole, n, _ in dealt(hard, ids))


def test_languages(spark, hard):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    pages = hard.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a"), F.col("doc_id") % 3, F.lit(".fr/")).alias("url"), F.concat(F.lit("<html lang=de>"), "text").alias("html"))
    dealt(pages, lambda df: langid.identify(df, model).drop("confidence"))
