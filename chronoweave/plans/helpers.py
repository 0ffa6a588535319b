"""Column helpers over whole tables, each beside its meaning in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalar as X
from chronoweave.functions.vocab import DISRUPTIONS, DISTRICTS, RESPONSES
from chronoweave.plans.registry import query
from chronoweave.sources.readers import table

_TYPES = (*DISRUPTIONS, *RESPONSES)
_list = lambda names: f"[{', '.join(repr(x) for x in names)}]"
_array = lambda names: F.array(*map(F.lit, names))


def _pick(names: tuple[str, ...], n: Column) -> Column:
    return F.get(_array(names), F.pmod(n, F.lit(len(names))).cast("int"))


_EVENT_SQL = f"""WITH e AS (
  SELECT event_id AS id, ts::DATE AS day, user_id, event_type, {_list(_TYPES)}[event_id % {len(_TYPES)} + 1] AS a, {_list(_TYPES)}[user_id % {len(_TYPES)} + 1] AS b,
    event_id // 3 AS article, event_id % 3 AS slot, (floor(value)::BIGINT % 60) AS n, user_id % 6 AS families FROM events
)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    e, c = table(spark, d, "events"), F.col
    return e.select(
        c("event_id").alias("id"), F.to_date("ts").alias("day"), "user_id", "event_type", _pick(_TYPES, c("event_id")).alias("a"), _pick(_TYPES, c("user_id")).alias("b"),
        F.floor(c("event_id") / 3).alias("article"), (c("event_id") % 3).alias("slot"), (F.floor("value") % 60).alias("n"), (c("user_id") % 6).alias("families"),
    )


@query(f"""{_EVENT_SQL} SELECT id, strftime(day, '%Y') AS year_prefix, CASE WHEN id % 4 < 2 THEN day END AS safe_date, CASE WHEN id % 3 = 0 THEN '_none_' ELSE a END AS listed,
  event_type || '  ' || b AS one_line, CASE WHEN a IN {tuple(DISRUPTIONS)} THEN 'disruption' ELSE 'response' END AS kind_exact,
  list_any_value(list_filter({_list(DISRUPTIONS)}, lambda x: contains(a || ';' || b, x))) IS NOT NULL AS by_part,
  a IN ('DisasterEvent', 'PestDiseaseEvent', 'SupplyShortage', 'FoodSafetyIncident', 'WeatherDisruption') OR a LIKE '%Disruption%' OR b IN ('DisasterEvent', 'PestDiseaseEvent', 'SupplyShortage', 'FoodSafetyIncident', 'WeatherDisruption') OR b LIKE '%Disruption%' AS broad,
  a IN ('DisasterEvent', 'WeatherDisruption') AND b IN ('DisasterEvent', 'WeatherDisruption') AS disaster FROM e""")
def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Dates, lists and the notions of a disruption."""
    c, e = F.col, _events(spark, d)
    written = F.when(c("id") % 4 == 0, c("day").cast("string")).when(c("id") % 4 == 1, F.concat(c("day").cast("string"), F.lit("T10:00:00"))).when(c("id") % 4 == 2, F.lit("2024")).otherwise(F.lit("unknown"))
    types = F.when(c("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("a"))
    joined = F.concat_ws(";", "a", "b")
    return e.select(
        "id", X.year_prefix(c("day").cast("string")).alias("year_prefix"), X.safe_date(written).alias("safe_date"), F.array_join(X.listify(types), ",").alias("listed"),
        X.one_line(F.concat(c("event_type"), F.lit("\t\n"), c("b"))).alias("one_line"), X.kind_exact(c("a")).alias("kind_exact"), X.is_disruption_by_part(joined).alias("by_part"), X.is_disruption_broad(joined).alias("broad"), X.is_disaster(F.array("a", "b")).alias("disaster"),
    )


@query(f"""{_EVENT_SQL} SELECT id, abs(date_diff('day', day, DATE '2024-03-01'))::INT AS day_gap, date_diff('day', day, DATE '2024-03-01')::INT AS reporting_lag, 2.0::DOUBLE * (a = b)::INT - abs(date_diff('day', day, DATE '2024-03-01')) / 10000.0::DOUBLE AS district_recency,
  (least(n, 40) * least(families, 4))::BIGINT AS cell_score, least(id, user_id) AS low, greatest(id, user_id) AS high, CASE WHEN id % 5 = 0 THEN 'unclear' ELSE event_type END AS commodity,
  CASE WHEN id % 7 = 0 THEN article || ':llm:event:' || slot ELSE 'p:route' || slot || ':x' END AS event_id, CASE WHEN id % 7 = 0 THEN 'llm' ELSE 'route' || slot END AS route, (a = 'OtherResponseAction')::INT::DOUBLE AS hot, (year(day) - 2021) / 6.0::DOUBLE AS scaled_year,
  'src' || slot AS family, CASE WHEN n = 0 THEN NULL ELSE n END AS slot_n FROM e""")
def event_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, scores, keys and features."""
    c, e = F.col, _events(spark, d)
    seen = F.lit("2024-03-01").cast("date")
    low, high = X.pair_key(c("id"), c("user_id"))
    given = F.when(c("id") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("p:route"), c("slot").cast("string"), F.lit(":x")))
    e = e.withColumn("event_id", X.default_event_id(given, c("article").cast("string"), c("slot")))
    return e.select(
        "id", X.day_gap(c("day"), seen).alias("day_gap"), X.reporting_lag(seen, c("day")).alias("reporting_lag"), X.district_recency(c("a") == c("b"), X.day_gap(c("day"), seen)).alias("district_recency"), X.cell_score(c("n"), c("families")).cast("bigint").alias("cell_score"),
        low.alias("low"), high.alias("high"), X.default_commodity(F.when(c("id") % 5 == 0, F.lit("  ")).otherwise(c("event_type"))).alias("commodity"), "event_id", X.extraction_route(c("event_id")).alias("route"),
        F.element_at(X.one_hot(c("a"), list(_TYPES)), -1).alias("hot"), X.scaled_year(c("day")).alias("scaled_year"), X.publisher_family(F.concat(F.lit("src"), c("slot").cast("string"), F.lit("_"), c("event_type"))).alias("family"), X.nz_slot(c("n")).alias("slot_n"),
    )


@query(f"""WITH t AS (SELECT doc_id, {_list(DISTRICTS)} AS names, CASE doc_id % 3 WHEN 0 THEN 'In ' || upper({_list(DISTRICTS)}[doc_id % 32 + 1]) || '. ' WHEN 1 THEN {_list(DISTRICTS)}[doc_id % 32 + 1] || ' and ' || {_list(DISTRICTS)}[(doc_id + 5) % 32 + 1] || ' ' ELSE '' END || coalesce(text, '') AS x FROM documents),
u AS (SELECT doc_id, x, list_filter(names, lambda n: regexp_matches(lower(x), '\\b' || n || '\\b')) AS hits FROM t)
SELECT doc_id, coalesce(hits[1], '_other_') AS district_first, CASE WHEN len(hits) = 1 THEN hits[1] WHEN len(hits) > 1 THEN '_multi_' ELSE '_none_' END AS district_unique, sha256(substr(x, 1, 400)) AS evidence FROM u""")
def district_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The districts that a text names, and its first 400 characters."""
    n = F.col("doc_id")
    lead = F.when(n % 3 == 0, F.concat(F.lit("In "), F.upper(_pick(DISTRICTS, n)), F.lit(". "))).when(n % 3 == 1, F.concat(_pick(DISTRICTS, n), F.lit(" and "), _pick(DISTRICTS, n + 5), F.lit(" "))).otherwise(F.lit(""))
    t = table(spark, d, "documents").select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("x"))
    return t.select("doc_id", X.district_first(F.col("x")).alias("district_first"), X.district_unique(F.col("x")).alias("district_unique"), F.sha2(X.evidence_400(F.col("x")).cast("binary"), 256).alias("evidence"))


@query("""WITH x AS (SELECT doc_id, quality AS y, (doc_id % 9 - 4) * 10.0::DOUBLE AS logit, doc_id // 16 AS block FROM labels WHERE quality IS NOT NULL),
p AS (SELECT *, 1 / (1 + exp(-greatest(least(logit, 30.0), -30.0))) AS p, exp(logit - max(logit) OVER (PARTITION BY block)) AS e FROM x)
SELECT doc_id, round(-(y * ln(p + 1e-12) + (1 - y) * ln(1 - p + 1e-12)), 9) AS loss, round(e / sum(e) OVER (PARTITION BY block), 9) AS share FROM p""")
def label_losses(spark: SparkSession, d: str) -> DataFrame:
    """Cross entropy of clipped logits and softmax within a block."""
    x = table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") % 9 - 4) * 10.0).alias("logit"), F.floor(F.col("doc_id") / 16).alias("block"))
    return x.select("doc_id", F.round(X.cross_entropy(F.col("logit"), F.col("y")), 9).alias("loss"), F.round(X.softmax(F.col("logit"), Window.partitionBy("block")), 9).alias("share"))
