"""Each stage against brute force on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import cases
from tests.llm.test_jaccard_join import brute as classes


def setup(spark, tmp_path, df, small):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = P.language(spark, docs, small)
    assert a.columns == docs.columns and a.count() == docs.where("text rlike '[a-zA-Z]'").count()
    b = P.lines(spark, a, small)
    assert b.columns == docs.columns and b.where("n_chars <> length(text)").count() == 0
    b.write.parquet(f"{tmp_path}/b")
    b = spark.read.parquet(f"{tmp_path}/b")
    rows = [(r["doc_id"], r["text"]) for r in b.select("doc_id", "text").collect()]
    want = {k for (k, _), (c, _) in zip(rows, classes(rows), strict=True) if k == c}
    c = P.near_copies(spark, b, small)
    assert c.columns == docs.columns and {r["doc_id"] for r in c.select("doc_id").collect()} == want
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    d = P.leaks(spark, c, small)
    left = d.collect()
    assert d.columns == docs.columns and not any(t in (r["text"] or "") for r in left for t in items)
    clean = {r["doc_id"] for r in c.collect() if not any(t in (r["text"] or "") for t in items)}
    assert len(clean - {r["doc_id"] for r in left}) <= 1
    e = P.mixture(spark, d, small)
    assert e.columns[: len(docs.columns)] == docs.columns and e.count() == len(left)


def test_repeated_and_null_keys(spark, small):
    """One row of each group stays, and a clean text does not go with another one under its key."""
    import random

    rnd = random.Random(5)
    base, clean = cases.passage(rnd, 90), cases.passage(rnd, 90)
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first()["text"]
    rows = [(1, base), (1, base), (2, base + " tail"), (2, clean), (None, base), (None, "alone"), (None, "alone"), (3, None), (3, None), (-5, clean + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row_key", F.lit("clash"))
    left = sorted(((r["doc_id"], r["text"]) for r in P.near_copies(spark, df, small).collect()), key=repr)
    assert left == sorted([(1, base), (-5, clean + " end"), (None, "alone"), (3, None)], key=repr)
    rows = [(1, cases.passage(rnd, 40) + " " + item), (1, clean), (None, item + " " + cases.passage(rnd, 40)), (None, clean)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row_key", F.lit("clash"))
    assert sorted(((r["doc_id"], r["text"]) for r in P.leaks(spark, df, small).collect()), key=repr) == sorted([(1, clean), (None, clean)], key=repr)


def test_run_with_edge_cases(spark, small, tmp_path):
    out = P.run(spark, setup(spark, tmp_path / "x", cases.frame(spark), small))
    assert out.count() > 0 and {"path", "node", "mix_slot"} <= set(out.columns)


def test_run_of_nothing(spark, small, tmp_path):
    assert P.run(spark, setup(spark, tmp_path / "y", cases.empty(spark), small)).count() == 0


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_copies", "leaks", "mixture"] and P.ORACLE_SQL is None
