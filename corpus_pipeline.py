"""A corpus pipeline of five stages over `documents`; each reads all that its predecessor kept.

A stage is called as (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
Cases: nulls, repeated rows and extra columns are treated as the operators say; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, jaccard_join, lang_id, line_dedup, mixing
from chronoweave.llm.common import SLICE, checkpointed, shared_folder, small, table

#: A prediction below this, or no word in a script of the model, rejects a document.
MIN_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled rows know; text without letters goes."""
    model = lang_id.train(docs, F.lit(True))
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches):
        predictor = lang_id.Predictor(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [predictor.judge(t) for t in part.column(place).to_pylist()]
                yield part.filter([known and score >= MIN_SCORE for _, score, known in found])

    return docs.mapInArrow(keep, docs.schema)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of whole repeated line runs; n_chars follows the text, and emptied documents go."""
    out = line_dedup.dedup_lines(docs).where("n_kept > 0 or n_lines = 0").drop("n_lines", "n_kept")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _row_key() -> Column:
    """Names a document by doc_id and text: in the order of the ids, those without one last."""
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat_ws(":", F.coalesce(place, F.lit("~")), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(7), "text")))


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return docs.join(small(gone), key, "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the one with the least doc_id, then text digest.

    Rows that repeat doc_id and text are one document; rows with one doc_id and different texts, or with none, are
    different documents.
    """
    key = f"key_{uuid.uuid4().hex}"  # no column of the table is called so
    keyed = docs.withColumn(key, _row_key())
    classes = jaccard_join.jaccard_classes(keyed, key=key)
    seen = checkpointed(classes.groupBy("doc_id", "class_id").agg(F.count("*").alias("rows")).where("doc_id <> class_id or rows > 1"))
    left = _without(keyed, key, seen.where("doc_id <> class_id").select(F.col("doc_id").alias(key)))
    again = seen.where("doc_id = class_id").select(F.col("doc_id").alias(key))
    once = left.join(small(again), key, "left_semi").dropDuplicates([key])  # the repeated rows alone are shuffled
    return _without(left, key, again).unionByName(once).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; documents are told apart as in `near_copies`."""
    key = f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, _row_key())
    gone = checkpointed(decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), key=key).select(F.col("doc_id").alias(key)).distinct())
    return _without(keyed, key, gone).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the place of every document in the mixture of the sources."""
    return mixing.mix_sources(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("mixture", mixture)]

#: Stages 1, 3 and 4 cannot be said in SQL; tests/llm holds what each keeps against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
