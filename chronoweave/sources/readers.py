"""Scans. Each returns a lazy DataFrame with a declared schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.scalar import json_array_slice
from chronoweave.sources import schemas as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queue(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object in each line. Scalars in place of lists become lists of one."""
    raw = spark.read.schema(S.QUEUE.replace("array<string>", "string")).json(path)
    lists = [f.split()[0] for f in S.QUEUE.split(", ") if f.endswith("array<string>")]
    return raw.withColumns({c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c) != "", F.array(c)) for c in lists})


def checkpoints(spark: SparkSession, path: str, tag: str, complete_only: bool = True, glob: str = "ann_*.json") -> DataFrame:
    """One JSON document in each file; unreadable files are skipped."""
    df = spark.read.schema(S.CHECKPOINT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).json(path)
    ok = F.col("annotation").isNotNull()
    if complete_only:
        ok = ok & (F.col("status") == "complete")
    return df.where(F.col("_corrupt_record").isNull() & ok).drop("_corrupt_record").withColumn("extraction_source", F.lit(tag))


def checkpoint_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in file names, without parsing the files' content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ann_*.json").load(path)
    return files.select(F.regexp_extract("path", r"(ann_[^/]*)\.json$", 1).alias("article_id"))


def annotation_document(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A document with an array of annotations, one row for each."""
    df = spark.read.schema(f"annotations array<{S.ANNOTATION_STRUCT}>").option("multiLine", True).json(path)
    one = df.select(F.explode("annotations").alias("annotation"))
    return one.select(F.col("annotation.candidate_id").alias("article_id"), F.lit("complete").alias("status"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("extraction_route"), "annotation", F.lit(tag).alias("extraction_source"))


def annotations(sources: dict[str, DataFrame], include: tuple[str, ...] = ("pilot", "expansion")) -> DataFrame:
    """Union of tagged sources. Only those named are pooled; a third route must be asked for."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sources[k].withColumn("extraction_source", F.lit(k)) for k in include])


def tsv(spark: SparkSession, path: str, schema: str, quoted: bool = True) -> DataFrame:
    """Tab-separated with a header; with or without CSV quoting."""
    r = spark.read.schema(schema).option("sep", "\t").option("header", True)
    return (r.option("quote", '"').option("escape", '"') if quoted else r.option("quote", "")).csv(path)


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Rows (article_id, sentence_id, text)."""
    return spark.read.schema(S.PACKET).json(path).select("article_id", F.inline("blind_payload.source_sentences"))


def scored_run(spark: SparkSession, path: str) -> DataFrame:
    """A run as a map by article, a list, or a document with annotations: rows (article_id, annotation)."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    as_list = F.from_json("v", f"array<{S.ANNOTATION_STRUCT}>")
    as_doc = F.from_json("v", f"annotations array<{S.ANNOTATION_STRUCT}>")["annotations"]
    listed = text.select(F.explode(F.when(F.col("v").startswith("["), as_list).otherwise(as_doc)).alias("a")).select(F.col("a.candidate_id").alias("article_id"), F.col("a").alias("annotation"))
    mapped = text.where(F.col("v").startswith("{") & as_doc.isNull()).select(F.explode(F.from_json("v", f"map<string,{S.ANNOTATION_STRUCT}>")).alias("article_id", "annotation"))
    return listed.unionByName(mapped)


def batch_replies(spark: SparkSession, path: str) -> DataFrame:
    """Reply files batch-NNN.*: rows (batch, ord, record); unparsable files give a null record."""
    raw = spark.read.option("pathGlobFilter", "batch-*").text(path, wholetext=True)
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("int").alias("batch"), F.from_json(json_array_slice(F.col("value")), f"array<{S.ANNOTATION_STRUCT.replace('struct<', 'struct<article_id:string,', 1)}>").alias("records"))
    return raw.select("batch", F.posexplode_outer("records").alias("ord", "record"))


def batch_index(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(S.BATCHES).option("multiLine", True).json(path)
    return df.select(F.inline("batches")).select("batch", F.explode("article_ids").alias("article_id"))


def sql_source(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational source over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def if_exists(spark: SparkSession, path: str, read):
    """The result of `read(path)` if the path exists on its file system, else None."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return read(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def policies(spark: SparkSession, path: str, key: str | None = "policies") -> DataFrame:
    """A lookup of policies by id: the map under `key`, or the document itself if `key` is None."""
    inner = "struct<enactment_date:string,instrument_type:string>"
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"{key} map<string,{inner}>")[key] if key else F.from_json("value", f"map<string,{inner}>")
    return text.select(F.explode(m).alias("policy_id", "p")).select("policy_id", "p.enactment_date", "p.instrument_type")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Ranking candidates; known_positive as a boolean."""
    return tsv(spark, path, S.CANDIDATES, quoted=False).withColumn("known_positive", F.lower("known_positive") == "true")
