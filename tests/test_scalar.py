import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import scalar as S


def one(spark, col, **values):
    schema = values.pop("schema", None)
    df = spark.createDataFrame([tuple(values.values())], schema or list(values))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("2024-02-30", None), (None, None), ("", None), ("2024", None), ("2024-01-02T10:00", dt.date(2024, 1, 2))])
def test_safe_date(spark, text, want):
    assert one(spark, S.safe_date(F.col("s")), s=text, schema="s string") == want


def test_quantiles(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "v array<int>")
    assert df.select(S.quantile_upper(F.col("v"), 1, 2), S.quantile_upper(F.col("v"), 3, 4), S.median_lower(F.col("v"))).first()[:] == (3, 4, 2)


def test_districts(spark):
    c = F.col("s")
    text = "Malang and Lumajang, East Java"
    assert one(spark, S.district_first(c), s=text) == "lumajang"
    assert one(spark, S.district_unique(c), s=text) == "_multi_"
    assert one(spark, S.district_unique(c), s="kota batu") == "batu"
    assert one(spark, S.district_first(c), s="batuan") == "_other_"
    assert one(spark, S.district_unique(c), s=None, schema="s string") == "_none_"


def test_compatible_is_not_transitive(spark):
    c = lambda a, b: one(spark, S.compatible(F.col("a"), F.col("b")), a=a, b=b, schema="a string, b string")
    assert c("rice", "unclear") and c("unclear", "chili") and not c("rice", "chili") and c(None, "rice")


def test_hardness_and_recency(spark):
    t = F.lit(True)
    assert one(spark, S.hardness(t, t, t, t, F.col("lag")), lag=0) == 10.0
    assert [one(spark, S.recency(F.col("lag")), lag=x) for x in (0, 365, 730, 1000)] == [2.0, 1.0, 0.0, 0.0]


def test_ranking_of(spark):
    assert one(spark, S.ranking_of(F.col("s"), 20), s="11,16, 16, 99") == [11, 16]
    assert one(spark, S.ranking_of(F.col("s"), 20), s="99999999999999999999") == []


def test_json_slice(spark):
    assert one(spark, S.json_array_slice(F.col("s")), s='Sure:\n```json\n[{"a": [1]}]\n``` bye') == '[{"a": [1]}]'
    assert one(spark, S.json_array_slice(F.col("s")), s="nothing") is None


def test_kind_problem(spark):
    k = lambda a, b: one(spark, S.kind_problem(F.col("a"), F.col("b")), a=a, b=b, schema="a string, b string")
    assert k("response", "WeatherDisruption") == "V3_kind_subtype_mismatch"
    assert k("response", None) == k("response", "X") == "V3_unknown_subtype"
    assert k("response", "FoodAssistance") is None


@pytest.mark.parametrize(("types", "want"), [(["DisasterEvent", "WeatherDisruption"], True), (["WeatherDisruption"], True), ([], False), (["FoodAssistance"], False)])
def test_is_disaster(spark, types, want):
    df = spark.createDataFrame([(types,)], T.StructType([T.StructField("t", T.ArrayType(T.StringType()))]))
    assert df.select(S.is_disaster(F.col("t"))).first()[0] is want


def test_small_helpers(spark):
    assert one(spark, S.publisher_family(F.col("s")), s="detik_food") == "detik"
    assert one(spark, S.publisher_family(F.col("s")), s="") == ""
    assert one(spark, S.extraction_route(F.col("s")), s="a:llm:event:1") == "llm"
    assert one(spark, S.default_event_id(F.col("e"), F.col("a"), F.col("n")), e=" ", a="x", n=2) == "x:llm:event:2"
    assert one(spark, S.quarter(F.col("d")), d=dt.date(2024, 5, 1)) == "2024Q2"
    assert one(spark, S.norm_evidence(F.col("s")), s="ﬁne  day ") == "fine day"
    assert one(spark, S.tags(F.col("s")), s="a, b,,c") == ["a", "b", "c"]
    assert one(spark, S.nz_slot(F.col("n")), n=0) is None


@pytest.mark.parametrize("z", [-3.0, -1.96, -0.5, 0.0, 0.7, 2.5])
def test_normal_cdf(spark, z):
    assert abs(one(spark, S.normal_cdf(F.col("z")), z=z) - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6
