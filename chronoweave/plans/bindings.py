"""Projections of the driver's tables into the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.readers import table

#: Rows of a table that may be broadcast.
FEW = 2_000_000
DISRUPTION_TYPES = ("error", "signup")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Event mentions from `events`."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = table(spark, d, "events").select(
        F.col("event_id").alias("mention"),
        F.floor(F.col("event_id") / 3).alias("article"),
        (F.col("event_id") % 3 + 1).cast("int").alias("slot"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("subtype"),
        F.when(k % 16 == 0, F.lit("unclear")).otherwise(F.concat(F.lit("c"), (k % 16).cast("string"))).alias("commodity"),
        F.concat(F.lit("d"), (F.col("user_id") % 32).cast("string")).alias("district"),
        (k % 5).cast("int").alias("stage"),
        (F.floor(F.col("event_id") / 3) % 5).cast("int").alias("publisher"),
        (F.floor("value") % 100).cast("int").alias("confidence"),
        F.col("user_id").alias("user"),
    )
    return e.withColumn("kind", F.when(F.col("subtype").isin(*DISRUPTION_TYPES), F.lit("disruption")).otherwise(F.lit("response")))


E_SQL = """e AS (
  SELECT *, CASE WHEN subtype IN ('error', 'signup') THEN 'disruption' ELSE 'response' END AS kind FROM (
    SELECT event_id AS mention, event_id // 3 AS article, (event_id % 3 + 1)::INT AS slot, ts::DATE AS date, event_type AS subtype,
      CASE WHEN k % 16 = 0 THEN 'unclear' ELSE 'c' || (k % 16)::VARCHAR END AS commodity, 'd' || (user_id % 32)::VARCHAR AS district,
      (k % 5)::INT AS stage, (event_id // 3 % 5)::INT AS publisher, (floor(value)::BIGINT % 100)::INT AS confidence, user_id AS user
    FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)))"""


def order_mentions(spark: SparkSession, d: str, together: bool = False) -> DataFrame:
    """Bitemporal mentions from orders and their lines: one for each (order, line number), which is no key.

    With `together` lines are exchanged by order, once for all that follows within an order: suppliers and parts, if they
    are few, come to them.
    """
    lines = table(spark, d, "lineitem")
    if together:
        lines = lines.select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_returnflag").repartition("l_orderkey")
    li = lines.groupBy(F.col("l_orderkey").alias("article"), F.col("l_linenumber").alias("slot")).agg(
        F.min(F.to_date("l_shipdate")).alias("event_time"), F.min("l_suppkey").alias("actor"), F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag")
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("article"), F.to_date("o_orderdate").alias("report_time"), F.col("o_orderpriority").alias("publisher"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("actor"), F.col("s_nationkey").cast("bigint").alias("location"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("commodity"))
    if together:
        supplier, part = [F.broadcast(x) if x.limit(FEW + 1).count() <= FEW else x for x in (supplier, part)]
    t = li.join(orders, "article").join(supplier, "actor").join(part, "part")
    return t.select(
        (F.col("article") * 16 + F.col("slot")).alias("mention"), "article", "slot", "event_time", "report_time", "publisher", "actor", "location", "commodity", "flag",
        F.when(F.col("flag") == "R", F.lit("disruption")).otherwise(F.lit("response")).alias("kind"),
    )


T_SQL = """li AS (
  SELECT l_orderkey AS article, l_linenumber AS slot, min(l_shipdate::DATE) AS event_time, min(l_suppkey) AS actor, min(l_partkey) AS part, min(l_returnflag) AS flag
  FROM lineitem GROUP BY ALL
), t AS (
  SELECT article * 16 + slot AS mention, article, slot, event_time, o_orderdate::DATE AS report_time, o_orderpriority AS publisher, actor, s_nationkey::BIGINT AS location,
    p_type AS commodity, flag, CASE WHEN flag = 'R' THEN 'disruption' ELSE 'response' END AS kind
  FROM li JOIN orders ON o_orderkey = article JOIN supplier ON s_suppkey = actor JOIN part ON p_partkey = part)"""


def relations(t: DataFrame) -> DataFrame:
    """respondsTo from each A line to each R line of its order; reportedCauseOf from R to N lines; implementsPolicy from A lines to their ship year."""
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.col("a.article") == F.col("b.article")) & (F.col("a.mention") != F.col("b.mention")))
    predicate = F.when(F.expr("a.flag = 'A' and b.flag = 'R'"), F.lit("respondsTo")).when(F.expr("a.flag = 'R' and b.flag = 'N'"), F.lit("reportedCauseOf"))
    stated = pairs.select(F.col("a.mention").alias("src"), F.col("b.mention").alias("dst"), F.col("a.event_time").alias("event_time"), F.col("a.report_time").alias("report_time"), predicate.alias("predicate")).where("predicate is not null")
    policy = t.where("flag = 'A'").select(F.col("mention").alias("src"), (-F.year("event_time")).cast("bigint").alias("dst"), "event_time", "report_time", F.lit("implementsPolicy").alias("predicate"))
    return stated.unionByName(policy)


R_SQL = """r AS (
  SELECT a.mention AS src, b.mention AS dst, a.event_time, a.report_time, CASE WHEN a.flag = 'A' THEN 'respondsTo' ELSE 'reportedCauseOf' END AS predicate
  FROM t a JOIN t b ON a.article = b.article AND a.mention <> b.mention AND ((a.flag = 'A' AND b.flag = 'R') OR (a.flag = 'R' AND b.flag = 'N'))
  UNION ALL
  SELECT mention, -year(event_time)::BIGINT, event_time, report_time, 'implementsPolicy' FROM t WHERE flag = 'A')"""
