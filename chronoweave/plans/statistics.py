"""Paired statistics: items are users; system A is the mean confidence of their disruptions, B that of their responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import stats as S
from chronoweave.operators.ranking import position
from chronoweave.plans.bindings import E_SQL, mentions
from chronoweave.plans.registry import query

DRAWS = 20000
EFFECTS = [0.2, 0.35, 0.5, 0.8]

_ITEMS = f"""WITH {E_SQL}, x AS (SELECT *, row_number() OVER (ORDER BY item) - 1 AS pos, round(a - b, 6) AS d FROM (
  SELECT "user" AS item, avg(confidence) FILTER (kind = 'disruption') AS a, avg(confidence) FILTER (kind = 'response') AS b FROM e GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    """One row for each user that has both kinds."""
    g = mentions(spark, d).groupBy(F.col("user").alias("item")).agg(F.avg(F.when(F.col("kind") == "disruption", F.col("confidence"))).alias("a"), F.avg(F.when(F.col("kind") == "response", F.col("confidence"))).alias("b"))
    g = g.where("a is not null and b is not null").withColumn("d", F.round(F.col("a") - F.col("b"), 6))
    return position(g.withColumn("block", F.floor(F.col("item") / 1000)), "block", ["item"]).drop("block", "total")


@query(f"{_ITEMS} SELECT count(*) AS n, round(avg(d), 9) AS mean_diff, round(avg(d) / stddev_samp(d), 9) AS dz, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM x")
def paired_effect(spark: SparkSession, d: str) -> DataFrame:
    e = S.effect(_items(spark, d))
    return e.withColumn("mean_diff", F.round("mean_diff", 9)).withColumn("dz", F.round("dz", 9))


@query(f"""WITH {E_SQL}, i AS (SELECT commodity AS item, (count(*) FILTER (kind = 'disruption') * 3 - count(*) FILTER (kind = 'response') * 2)::DOUBLE AS d FROM e WHERE commodity <> 'unclear' GROUP BY 1),
l AS (SELECT list(d ORDER BY item) AS ds, sum(d) AS total, count(*) AS n FROM i)
SELECT n::INT AS n, count(*) FILTER (abs(s) >= abs(total) - 1e-12) / count(*) AS p FROM (SELECT n, total, list_sum(list_transform(ds, lambda v, k: CASE WHEN (m >> (k - 1)) & 1 = 1 THEN v ELSE -v END)) AS s FROM l, range(1 << (SELECT n FROM l)::INT) r(m)) GROUP BY n""")
def sign_flip_exact(spark: SparkSession, d: str) -> DataFrame:
    """Items are the 15 commodities, differences weighted counts."""
    g = mentions(spark, d).where("commodity <> 'unclear'").groupBy(F.col("commodity").alias("item")).agg((F.count_if(F.col("kind") == "disruption") * 3 - F.count_if(F.col("kind") == "response") * 2).cast("double").alias("d"))
    return S.sign_flip_exact(g)


_BOOT = f"""{_ITEMS}, n AS (SELECT count(*) AS n FROM x), draws AS (SELECT draw, slot, ('0x' || substr(sha256('b:' || draw || ':' || slot), 1, 8))::BIGINT % n AS pos FROM n, range({DRAWS}) r(draw), range((SELECT n FROM n)) q(slot)),
means AS (SELECT draw, round(avg(d), 9) AS m FROM draws JOIN x USING (pos) GROUP BY 1), ci AS (SELECT list_sort(list(m))[{int(0.025 * DRAWS)} + 1] AS lo, list_sort(list(m))[{int(0.975 * DRAWS)} + 1] AS hi FROM means)"""
_FLIP = f"""n2 AS (SELECT count(*) AS n, sum(d) AS obs FROM x), flips AS (SELECT draw, slot, CASE WHEN ('0x' || substr(sha256('s:' || draw || ':' || slot), 1, 8))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign FROM range({DRAWS}) r(draw), range((SELECT n FROM n2)) q(slot)),
sums AS (SELECT draw, sum(sign * d) AS s FROM flips JOIN x ON x.pos = slot GROUP BY 1), test AS (SELECT n, (count(*) FILTER (abs(s) >= abs(obs) - 1e-9) + 1) / ({DRAWS} + 1) AS p FROM sums, n2 GROUP BY n)"""


@query(f"{_BOOT} SELECT lo, hi, round((SELECT avg(d) FROM x), 9) AS mean_diff FROM ci")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return S.bootstrap(_items(spark, d), DRAWS).withColumn("mean_diff", F.round("mean_diff", 9))


@query(f"{_ITEMS}, {_FLIP} SELECT n, p FROM test")
def sign_flip_sampled(spark: SparkSession, d: str) -> DataFrame:
    return S.sign_flip_sampled(_items(spark, d), DRAWS)


@query(f"""{_BOOT}, {_FLIP} SELECT p, lo, hi, CASE WHEN NOT (p < 0.05 AND (lo > 0 OR hi < 0)) THEN 'no significant difference' WHEN m > 0 THEN 'first is better' ELSE 'second is better' END AS verdict,
  CASE WHEN NOT (p < 0.05 AND (lo > 0 OR hi < 0)) THEN 'inconclusive' WHEN m < 0 THEN 'structure suffices' ELSE 'semantics contributes' END AS ablation FROM ci, test, (SELECT avg(d) AS m FROM x)""")
def paired_verdict(spark: SparkSession, d: str) -> DataFrame:
    x = _items(spark, d)
    one = S.bootstrap(x, DRAWS).crossJoin(S.sign_flip_sampled(x, DRAWS).select("p"))  # one row each
    args = F.col("p"), F.col("lo"), F.col("hi"), F.col("mean_diff")
    return one.select("p", "lo", "hi", S.verdict(*args).alias("verdict"), S.ablation_decision(*args).alias("ablation"))


_CDF = "(CASE WHEN {z} >= 0 THEN 1.0::DOUBLE - {u} ELSE {u} END)"


def _cdf_sql(z: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * abs({z})))"
    poly = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return _CDF.format(z=z, u=f"(0.3989422804014327::DOUBLE * exp(-abs({z}) * abs({z}) / 2.0::DOUBLE) * {poly})")


_GRID = f"""WITH g AS (SELECT n, dz, dz * sqrt(n) AS s FROM range(2, 401) r(n), (VALUES (0.2::DOUBLE), (0.35), (0.5), (0.8)) v(dz)),
p AS (SELECT n, dz, {_cdf_sql('(s - 1.959964::DOUBLE)')} + {_cdf_sql('(-s - 1.959964::DOUBLE)')} AS power FROM g)"""


@query(f"{_GRID} SELECT n, dz, round(power, 7) AS power FROM p")
def power_grid(spark: SparkSession, d: str) -> DataFrame:
    return S.power_grid(spark, EFFECTS, 400).select("n", "dz", F.round("power", 7).alias("power"))


@query(f"{_GRID} SELECT dz, min(n) AS min_n FROM p WHERE power >= 0.8 GROUP BY 1")
def min_n_for_power(spark: SparkSession, d: str) -> DataFrame:
    return S.power_grid(spark, EFFECTS, 400).where("power >= 0.8").groupBy("dz").agg(F.min("n").alias("min_n"))


@query()
def power_spot_check(spark: SparkSession, d: str) -> DataFrame:
    """Simulated power at n = 25: trials of normal differences with a t-like test; seeded, so rows only."""
    trials = spark.range(2000, numPartitions=8).crossJoin(spark.range(25).withColumnRenamed("id", "item")).select("id", F.explode(F.array(*map(F.lit, [0.0, *EFFECTS]))).alias("dz"), F.randn(20260815).alias("z"))
    t = trials.groupBy("dz", "id").agg((F.avg(F.col("z") + F.col("dz")) / (F.stddev_samp(F.col("z") + F.col("dz")) / 5.0)).alias("t"))
    return t.groupBy("dz").agg(F.count("*").alias("trials"), (F.count_if(F.abs("t") > 2.0639) / F.count("*")).alias("power"))
