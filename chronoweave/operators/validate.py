"""Validation of extracted events and relations. The first failing check of a row is its code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.scalar import kind_problem, norm_evidence, nz, nz_slot
from chronoweave.functions.vocab import PREDICATES


def event_codes(events: DataFrame) -> DataFrame:
    """Adds `code` and `fatal` to rows of article, body, pub_date, evidence_quote, event_date, event_kind, event_subtype.

    V1 and V2 reject the whole article, V3 drops the event.
    """
    quote, body = norm_evidence(F.coalesce("evidence_quote", F.lit(""))), norm_evidence(F.coalesce("body", F.lit("")))
    absent = (quote == "") | ~F.contains(body, quote)
    late = F.substring("event_date", 1, 10) > F.substring("pub_date", 1, 10)
    code = F.when(absent, F.lit("V1_quote_not_in_body")).when(F.coalesce(late, F.lit(False)) & nz(F.col("event_date")).isNotNull(), F.lit("V2_after_publication")).otherwise(kind_problem(F.col("event_kind"), F.col("event_subtype")))
    return events.withColumn("code", code).withColumn("fatal", F.coalesce(F.col("code").isin("V1_quote_not_in_body", "V2_after_publication"), F.lit(False)))


def kept_events(coded: DataFrame) -> DataFrame:
    """Events without a code, of articles that were not rejected, with their slot: as given, else the place among those kept."""
    good = coded.withColumn("_bad", F.max("fatal").over(Window.partitionBy("article"))).where("not _bad and code is null").drop("_bad")
    place = F.row_number().over(Window.partitionBy("article").orderBy("ord"))
    return good.withColumn("event_slot", F.coalesce(nz_slot(F.col("event_slot")), place))


def relation_codes(relations: DataFrame, events: DataFrame) -> DataFrame:
    """Adds `code`, `subject` and `object` to rows of article, body, predicate, evidence_quote, subject_event_slot, object_event_slot, policy_id."""
    ids = events.select("article", F.col("event_slot").alias("_slot"), "event_id")
    r = relations.join(ids.toDF("article", "subject_event_slot", "subject"), ["article", "subject_event_slot"], "left")
    r = r.join(ids.toDF("article", "object_event_slot", "_o"), ["article", "object_event_slot"], "left")
    policy = F.col("predicate").isin("implementsPolicy", "citesPolicy")
    quote, body = norm_evidence(F.coalesce("evidence_quote", F.lit(""))), norm_evidence(F.coalesce("body", F.lit("")))
    code = (
        F.when(~F.coalesce(F.col("predicate").isin(*PREDICATES), F.lit(False)), F.lit("V4_bad_predicate"))
        .when((quote != "") & ~F.contains(body, quote), F.lit("V4_quote_not_in_body"))
        .when(F.col("subject").isNull(), F.lit("V4_unresolved_subject"))
        .when(policy & nz(F.col("policy_id")).isNull(), F.lit("V4_policy_without_id"))
        .when(~policy & (F.col("_o").isNull() | (F.col("_o") == F.col("subject"))), F.lit("V4_unresolved_or_self_object"))
    )
    return r.withColumn("code", code).withColumn("object", F.when(policy, nz(F.col("policy_id"))).otherwise(F.col("_o"))).drop("_o")


def reconcile(expected: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., state): ok, missing or unexpected; how often an id was received does not matter."""
    j = expected.select(*keys).distinct().withColumn("_e", F.lit(True)).join(received.select(*keys).distinct().withColumn("_r", F.lit(True)), keys, "full_outer")
    return j.select(*keys, F.when(F.col("_e").isNull(), F.lit("unexpected")).when(F.col("_r").isNull(), F.lit("missing")).otherwise(F.lit("ok")).alias("state"))
