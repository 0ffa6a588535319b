import json

from chronoweave.sources import readers as R
from chronoweave.sources import sinks as K


def _annotation(a, **more):
    return {"candidate_id": a, "pub_date": "2024-01-01", "events": [{"event_slot": 1, "event_kind": "disruption", "event_end_date": None}], "relations": []} | more


def test_checkpoints_skip_unreadable_and_incomplete(spark, tmp_path):
    (tmp_path / "ann_a.json").write_text(json.dumps({"article_id": "a", "status": "complete", "annotation": _annotation("a")}, indent=1))
    (tmp_path / "ann_b.json").write_text(json.dumps({"article_id": "b", "status": "failed", "annotation": _annotation("b")}))
    (tmp_path / "ann_c.json").write_text("{ broken")
    (tmp_path / "other.json").write_text("{}")
    df = R.checkpoints(spark, str(tmp_path), "expansion").cache()
    assert [r["article_id"] for r in df.collect()] == ["a"]
    assert {r["article_id"] for r in R.checkpoint_ids(spark, str(tmp_path)).collect()} == {"ann_a", "ann_b", "ann_c"}


def test_document_and_union(spark, tmp_path):
    (tmp_path / "pilot.json").write_text(json.dumps({"annotations": [_annotation("p"), _annotation("q")]}))
    p = R.annotation_document(spark, str(tmp_path / "pilot.json"), "pilot")
    both = R.annotations({"pilot": p, "chat": p, "expansion": p.limit(1)})
    assert {(r["extraction_source"], r["n"]) for r in both.groupBy("extraction_source").count().withColumnRenamed("count", "n").collect()} == {("pilot", 2), ("expansion", 1)}


def test_queue_listifies(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(x) for x in ({"article_id": "a", "heuristic_locations": ["x", "y"], "heuristic_commodities": "rice"}, {"article_id": "b", "heuristic_commodities": []})))
    got = {r["article_id"]: (r["heuristic_locations"], r["heuristic_commodities"]) for r in R.queue(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got["a"] == (["x", "y"], ["rice"]) and got["b"] == (None, [])


def test_tsv_quoting(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"x ""y"""\n')
    assert R.tsv(spark, str(tmp_path / "t.tsv"), "a int, b string").first()["b"] == 'x "y"'
    assert R.tsv(spark, str(tmp_path / "t.tsv"), "a int, b string", quoted=False).first()["b"] == '"x ""y"""'


def test_packets_batches_policies_runs(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"article_id": "a", "blind_payload": {"source_sentences": [{"sentence_id": 1, "text": "x"}]}}))
    assert R.packets(spark, str(tmp_path / "p.jsonl")).first()[:] == ("a", 1, "x")
    (tmp_path / "i.json").write_text(json.dumps({"batches": [{"batch": 1, "article_ids": ["a", "b"]}]}))
    assert R.batch_index(spark, str(tmp_path / "i.json")).count() == 2
    (tmp_path / "pol.json").write_text(json.dumps({"policies": {"x": {"enactment_date": "2020-01-01"}}}))
    assert R.policies(spark, str(tmp_path / "pol.json")).first()["policy_id"] == "x"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "batch-007.txt").write_text('Here:\n```json\n[{"article_id": "a", "events": []}]\n```')
    (tmp_path / "r" / "batch-008.txt").write_text("no list")
    got = {r["batch"]: r["record"] and r["record"]["article_id"] for r in R.batch_replies(spark, str(tmp_path / "r")).collect()}
    assert got == {7: "a", 8: None}
    for name, body in (("m", {"a": _annotation("a")}), ("l", [_annotation("a")]), ("d", {"annotations": [_annotation("a")]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        assert [r["article_id"] for r in R.scored_run(spark, str(tmp_path / f"{name}.json")).collect()] == ["a"]


def test_if_exists(spark, tmp_path):
    assert R.if_exists(spark, str(tmp_path / "none"), lambda p: 1) is None
    assert R.if_exists(spark, str(tmp_path), lambda p: 1) == 1


def test_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 1)], "k int, v string, o int")
    K.write_latest(df, str(tmp_path / "t"), "k", "o")
    K.write_latest(df.where("k = 2").withColumn("v", F.lit("new")), str(tmp_path / "t"), "k", "o")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "b"), (2, "new")}
    K.write_tsv(df, str(tmp_path / "x"), ["v", "k"])
    assert R.tsv(spark, str(tmp_path / "x"), "v string, k int").count() == 3
    assert df.agg(K.ordered_ids(F.col("o"), F.col("v")).alias("s")).first()["s"] == "c,a,b"
    assert json.loads(K.report(df.where("k = 2")).first()[0]) == {"k": 2, "v": "c", "o": 1}
    assert K.manifest({"t": df}, ["small"]).first()["rows"] == 3
