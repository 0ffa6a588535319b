"""Readers and sinks: what is written into the shared folder comes back as it was.

Whole-file formats hold the 25 nations as articles, a fixed number; tables go through Spark's writers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.graph import shared_folder
from chronoweave.plans.registry import query
from chronoweave.sources import readers as R
from chronoweave.sources import sinks as K
from chronoweave.sources.readers import table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """One small file on the file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _articles(spark: SparkSession, d: str) -> list[dict]:
    """An annotation for each nation: as many events as its region's number."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    event = lambda r, k: {"event_slot": k + 1, "event_kind": "disruption", "event_subtype": f"S{r['n_nationkey'] % 3}", "evidence_quote": r["n_name"]}
    return [{"candidate_id": f"a{r['n_nationkey']}", "pub_date": "2024-01-01", "title": r["n_name"], "events": [event(r, k) for k in range(r["n_regionkey"])], "relations": []} for r in rows]


_A = "SELECT 'a' || n_nationkey AS article_id, n_regionkey::INT AS n_events, n_name AS title, n_nationkey AS k FROM nation"


@query(f"""WITH a AS ({_A}) SELECT article_id, 'expansion' AS source, n_events, title FROM a WHERE k % 4 <> 3 UNION ALL SELECT article_id, 'pilot', n_events, title FROM a WHERE k % 2 = 0""")
def annotation_sources(spark: SparkSession, d: str) -> DataFrame:
    """One file for each article (some incomplete, one broken) and one document, pooled; a third route is not asked for."""
    at, all_ = _folder(spark), _articles(spark, d)
    for k, a in enumerate(all_):
        _put(spark, f"{at}/x/ann_{k}.json", json.dumps({"article_id": a["candidate_id"], "status": "failed" if k % 4 == 3 else "complete", "annotation": a}, indent=1))
    _put(spark, f"{at}/x/ann_broken.json", "{ broken")
    _put(spark, f"{at}/pilot.json", json.dumps({"annotations": all_[::2]}))
    pilot = R.annotation_document(spark, f"{at}/pilot.json", "pilot")
    pooled = R.annotations({"pilot": pilot, "expansion": R.checkpoints(spark, f"{at}/x", "expansion"), "chat": pilot})
    return pooled.select("article_id", F.col("extraction_source").alias("source"), F.size("annotation.events").alias("n_events"), F.col("annotation.title").alias("title"))


@query(f"""WITH a AS ({_A}) SELECT 'listed' AS name, count(*)::BIGINT AS n FROM a UNION ALL SELECT 'complete', count(*) FILTER (k % 4 <> 3) FROM a UNION ALL SELECT 'any_status', count(*) FROM a
  UNION ALL SELECT 'runs', 3 * count(*) FROM a UNION ALL SELECT 'run_events', 3 * sum(n_events)::BIGINT FROM a UNION ALL SELECT 'absent', 0""")
def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Ids by file names, checkpoints of any status, three forms of a run, and a path that does not exist."""
    at, all_ = _folder(spark), _articles(spark, d)
    for k, a in enumerate(all_):
        _put(spark, f"{at}/x/ann_{k}.json", json.dumps({"article_id": a["candidate_id"], "status": "failed" if k % 4 == 3 else "complete", "annotation": a}))
    _put(spark, f"{at}/r/list.json", json.dumps(all_))
    _put(spark, f"{at}/r/map.json", json.dumps({a["candidate_id"]: a for a in all_}))
    _put(spark, f"{at}/r/doc.json", json.dumps({"annotations": all_}))
    runs = R.scored_run(spark, f"{at}/r")
    one = lambda name, df, n=F.count("*"): df.agg(n.cast("bigint").alias("n")).select(F.lit(name).alias("name"), "n")
    none = R.if_exists(spark, f"{at}/none", lambda p: R.scored_run(spark, p))
    parts = [
        one("complete", R.checkpoints(spark, f"{at}/x", "t")), one("any_status", R.checkpoints(spark, f"{at}/x", "t", complete_only=False)), one("runs", runs),
        one("run_events", runs, F.sum(F.size("annotation.events"))), spark.sql(f"select 'absent' as name, cast({0 if none is None else 1} as bigint) as n"),
    ]
    out = one("listed", R.if_exists(spark, f"{at}/x", lambda p: R.checkpoint_ids(spark, p)))
    for p in parts:
        out = out.unionByName(p)
    return out


@query(f"""WITH a AS ({_A}) SELECT k // 10 AS batch, a.article_id, CASE WHEN k < 20 THEN n_events END AS n_events FROM a""")
def batch_files(spark: SparkSession, d: str) -> DataFrame:
    """Articles by an index of batches and the replies to them; the last batch has an unparsable reply."""
    at, all_ = _folder(spark), _articles(spark, d)
    batches = [(b, all_[b * 10 : b * 10 + 10]) for b in range(-(-len(all_) // 10))]
    _put(spark, f"{at}/index.json", json.dumps({"batches": [{"batch": b, "article_ids": [a["candidate_id"] for a in part]} for b, part in batches]}))
    for b, part in batches:
        reply = json.dumps([{"article_id": a["candidate_id"], **a} for a in part])
        _put(spark, f"{at}/r/batch-{b:03d}.txt", f"Here it is:\n```json\n{reply}\n```" if b < 2 else "no list")
    index, replies = R.batch_index(spark, f"{at}/index.json"), R.batch_replies(spark, f"{at}/r")
    got = replies.where("record is not null").select("batch", F.col("record.article_id").alias("article_id"), F.size("record.events").alias("n_events"))
    return index.join(got, ["batch", "article_id"], "left").select("batch", "article_id", "n_events")


@query("""SELECT 'p' || n_nationkey AS policy_id, '20' || lpad((n_nationkey % 25)::VARCHAR, 2, '0') || '-01-01' AS enactment_date, n_name AS instrument_type FROM nation""")
def policy_file(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    rows = table(spark, d, "nation").collect()
    _put(spark, f"{at}/p.json", json.dumps({"policies": {f"p{r['n_nationkey']}": {"enactment_date": f"20{r['n_nationkey'] % 25:02d}-01-01", "instrument_type": r["n_name"]} for r in rows}}))
    return R.policies(spark, f"{at}/p.json")


@query("""SELECT event_id::VARCHAR AS article_id, event_type AS first_commodity, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS locations, event_id % 3 = 0 AS signal FROM events""")
def queue_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines; a scalar in place of a list is a list of one."""
    at, c = _folder(spark), F.col
    e = table(spark, d, "events")
    e.select(c("event_id").cast("string").alias("article_id"), c("event_type").alias("heuristic_commodities"), F.when(c("event_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("z"))).alias("heuristic_locations"), (c("event_id") % 3 == 0).alias("explicit_connection_signal")).write.json(f"{at}/q")
    return R.queue(spark, f"{at}/q").select("article_id", F.get("heuristic_commodities", F.lit(0)).alias("first_commodity"), F.size("heuristic_locations").alias("locations"), c("explicit_connection_signal").alias("signal"))


@query("""SELECT doc_id::VARCHAR AS article_id, i::INT AS sentence_id, sha256(l[i]) AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""")
def packet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Packets with the lines of a text as source sentences."""
    at = _folder(spark)
    t = table(spark, d, "documents").where("text is not null")
    lines = F.transform(F.split("text", "\n", -1), lambda s, i: F.struct((i + 1).cast("int").alias("sentence_id"), s.alias("text")))
    t.select(F.col("doc_id").cast("string").alias("article_id"), F.struct(lines.alias("source_sentences")).alias("blind_payload")).write.json(f"{at}/p")
    return R.packets(spark, f"{at}/p").select("article_id", "sentence_id", F.sha2(F.col("text").cast("binary"), 256).alias("sentence"))


@query("""SELECT n_name || ', "quoted"' AS name, n_nationkey AS k, 'quoted' AS form FROM nation UNION ALL SELECT n_name, n_nationkey, 'plain' FROM nation""")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tables with and without quoting; only the named columns are written."""
    at, n = _folder(spark), table(spark, d, "nation")
    n.select(F.concat("n_name", F.lit(', "quoted"')).alias("name"), F.col("n_nationkey").alias("k")).coalesce(1).write.option("sep", "\t").option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{at}/q")
    K.write_tsv(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), "n_regionkey"), f"{at}/t", ["name", "k"])
    quoted, plain = R.tsv(spark, f"{at}/q", "name string, k int"), R.tsv(spark, f"{at}/t", "name string, k int", quoted=False)
    return quoted.withColumn("form", F.lit("quoted")).unionByName(plain.withColumn("form", F.lit("plain")))


@query("""SELECT event_id::VARCHAR AS response, user_id::VARCHAR AS disruption, event_id % 2 = 0 AS positive, value AS hardness FROM events""")
def candidate_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at, c = _folder(spark), F.col
    e = table(spark, d, "events").select(c("event_id").alias("query_response_id"), c("user_id").alias("candidate_disruption_id"), F.when(c("event_id") % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("known_positive"), c("value").alias("hardness_score"))
    K.write_tsv(e, f"{at}/c", e.columns)
    return R.candidates(spark, f"{at}/c").select(c("query_response_id").alias("response"), c("candidate_disruption_id").alias("disruption"), c("known_positive").alias("positive"), c("hardness_score").alias("hardness"))


@query("""WITH last AS (SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1) SELECT user_id, CASE WHEN user_id % 10 = 0 THEN -event_id ELSE event_id END AS event_id FROM last""")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The latest document of each key; a rerun over some buckets replaces those and leaves the others."""
    at, e = _folder(spark), table(spark, d, "events").select("user_id", "event_id")
    K.write_latest(e, at, "user_id", "event_id")
    again = F.pmod(F.xxhash64("user_id"), F.lit(64)).alias("bucket")
    touched = e.where("user_id % 10 = 0").select(again).distinct()
    rerun = e.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(64))).join(F.broadcast(touched), "bucket", "left_semi")  # at most 64 buckets
    K.write_latest(rerun.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("user_id", F.when(F.col("user_id") % 10 == 0, -F.col("event_id")).otherwise(F.col("event_id")).alias("event_id")), at, "user_id", "event_id")
    return spark.read.parquet(at).select("user_id", "event_id")


@query("""SELECT r_regionkey AS region, '{"region":' || r_regionkey || ',"nations":' || count(*) || '}' AS report, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey DESC) AS ids, 25::BIGINT AS manifest_rows
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1""")
def region_reports(spark: SparkSession, d: str) -> DataFrame:
    """One JSON report, one ordered id list and the manifest's number of rows for each region."""
    n = table(spark, d, "nation")
    g = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"), K.ordered_ids(-F.col("n_nationkey"), F.col("n_nationkey")).alias("ids"))
    reports = K.report(g.select("region", "nations")).select(F.get_json_object("report", "$.region").cast("int").alias("region"), "report")
    rows = K.manifest({"nation": n, "region": table(spark, d, "region")}, ["made for a check"]).where("name = 'nation'").select(F.col("rows").alias("manifest_rows"))
    return g.join(reports, "region").crossJoin(F.broadcast(rows)).select("region", "report", "ids", "manifest_rows")  # one row
