"""Grouped counts, discrete quantiles and distribution summaries.

Quantiles come from a histogram of values, so a group's values are never gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.graph import stable
from chronoweave.operators.walks import pack, unpack


def discrete_quantiles(df: DataFrame, value: str, points: dict[str, tuple[int, int]], by: list[str] | None = None, weight: str | None = None, lower: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by..., n, points...): the value at place n*num//den of the sorted values, counted from 0.

    Points in `lower` count from the largest value. Null values are left out.
    """
    by = by or []
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    every = Window.partitionBy(*by)
    hist = hist.withColumn("_cum", F.sum("_c").over(every.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(every))
    cols = []
    for name, (num, den) in points.items():
        place = F.floor(F.col("_n") * num / den)
        place = F.col("_n") - 1 - place if name in lower else place
        cols.append(F.min(F.when(F.col("_cum") > place, F.col("_v"))).alias(name))
    return hist.groupBy(*by).agg(F.coalesce(F.max("_n"), F.lit(0)).cast("bigint").alias("n"), *cols)


def binned_quantiles(df: DataFrame, value: str, points: dict[str, tuple[int, int]], by: str, width: int = 4096) -> DataFrame:
    """Rows (by, n, sum, max, above_0, points...) of integers that may nearly all differ; points as in `discrete_quantiles`.

    Values are counted in bins of `width`, and one by one only in the bins that hold a point, so `df` is read twice and
    no exchange carries its values.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_b"))
    bins = stable(rows.groupBy(by, "_b").agg(F.count("*").alias("_c"), F.sum("_v").alias("_s"), F.max("_v").alias("_m"), F.count_if(F.col("_v") > 0).alias("_a")))
    near = lambda asked: rows.join(F.broadcast(asked), [by, "_b"]).groupBy(by, "_b", "_v").agg(F.count("*").alias("_c"))  # noqa: E731  a row for each point
    return _in_bins(bins, near, points, by)


#: Rows of `packed_bins` as columns.
BINS = "_b bigint, _c bigint, _s bigint, _m bigint, _a bigint, data binary"


def packed_bins(v: np.ndarray, width: int = 65536) -> list[tuple]:
    """Rows (bin, count, sum, max, above 0, data) of integers: `data` are the sorted values of a bin, packed as differences."""
    v = np.sort(v)
    b = v // width
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(v) else np.zeros(0, np.int64)
    return [(int(x[0] // width), len(x), int(x.sum()), int(x[-1]), int((x > 0).sum()), pack({"v": np.diff(x, prepend=0)})) for x in np.split(v, start[1:]) if len(x)]


def packed_quantiles(df: DataFrame, points: dict[str, tuple[int, int]], by: str) -> DataFrame:
    """As `binned_quantiles`, from rows (by, ...) of `packed_bins`: only bins that hold a point are unpacked."""
    bins = stable(df.groupBy(by, "_b").agg(*[F.sum(c).alias(c) for c in ("_c", "_s", "_a")], F.max("_m").alias("_m")))

    def counted(batches):
        for t in batches:
            for key, b, data in zip(*(t[c].to_pylist() for c in (by, "_b", "data")), strict=True):
                v, n = np.unique(np.cumsum(unpack([data])["v"]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(v), pa.string()), pa.array(np.full(len(v), b)), pa.array(v), pa.array(n)], [by, "_b", "_v", "_c"])

    near = lambda asked: df.join(F.broadcast(asked), [by, "_b"]).select(by, "_b", "data").mapInArrow(counted, f"{by} string, _b bigint, _v bigint, _c bigint").groupBy(by, "_b", "_v").agg(F.sum("_c").alias("_c"))
    return _in_bins(bins, near, points, by)


def _in_bins(bins: DataFrame, values, points: dict[str, tuple[int, int]], by: str) -> DataFrame:
    """The quantiles, from rows (by, _b, _c, _s, _m, _a) of bins and the counted values that `values` finds in some bins."""
    every = Window.partitionBy(by)
    upto = bins.withColumns({"_end": F.sum("_c").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(every)})
    places = F.array(*[F.struct(F.lit(p).alias("_p"), F.floor(F.col("_n") * num / den).alias("_at")) for p, (num, den) in points.items()])
    asked = stable(upto.select(by, "_b", "_end", "_c", F.inline(places)).where("_at < _end and _at >= _end - _c").select(by, "_b", "_p", (F.col("_at") - F.col("_end") + F.col("_c")).alias("_at")))
    near = values(asked.select(by, "_b").distinct())
    near = near.withColumn("_cum", F.sum("_c").over(Window.partitionBy(by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = near.join(asked, [by, "_b"]).where("_cum > _at").groupBy(by).agg(*[F.min(F.when(F.col("_p") == p, F.col("_v"))).alias(p) for p in points])
    whole = bins.groupBy(by).agg(F.sum("_c").alias("n"), F.sum("_s").alias("sum"), F.max("_m").alias("max"), F.sum("_a").alias("above_0"))
    return whole.join(found, by)


def cells(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def density(cell: DataFrame) -> DataFrame:
    """One row: cells, lower median, cells of at least 4 and 8, the largest."""
    q = discrete_quantiles(cell, "n", {"median": (1, 2)}, lower=("median",)).select(F.col("n").alias("cells"), "median")
    r = cell.agg(F.count_if(F.col("n") >= 4).alias("cells_ge_4"), F.count_if(F.col("n") >= 8).alias("cells_ge_8"), F.coalesce(F.max("n"), F.lit(0)).alias("max_cell"))
    return q.crossJoin(r)  # one row each


def top(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def pairs_within(df: DataFrame, keys: list[str], day: str, width: int, apart: str | None = None) -> DataFrame:
    """Rows (keys..., pairs): unordered pairs at most `width` days apart, without those equal in `apart`.

    Counted from a histogram by day, without making a pair.
    """

    def count(by: list[str]) -> DataFrame:
        hist = df.where(F.col(day).isNotNull()).groupBy(*by, F.unix_date(day).alias("_d")).agg(F.count("*").alias("_m"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("_d").rangeBetween(-width, -1)), F.lit(0))
        hist = hist.withColumn("_p", F.floor(F.col("_m") * (F.col("_m") - 1) / 2) + F.col("_m") * before)
        return hist.groupBy(*keys).agg(F.sum("_p").alias("pairs"))

    all_ = count(keys)
    if apart is None:
        return all_
    same = count([*keys, apart]).withColumnRenamed("pairs", "same")
    return all_.join(same, keys, "left").select(*keys, (F.col("pairs") - F.coalesce("same", F.lit(0))).alias("pairs"))


def eligible_counts(df: DataFrame, key: str, day: str, is_query: Column, is_candidate: Column, window: int) -> DataFrame:
    """Rows (key, day, count, queries): candidates of the same key up to `window` days before, the day itself included."""
    hist = df.where(F.col(day).isNotNull()).groupBy(key, F.unix_date(day).alias("_d")).agg(F.count_if(is_query).alias("queries"), F.count_if(is_candidate).alias("_c"))
    n = F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_d").rangeBetween(-window, 0)), F.lit(0))
    return hist.withColumn("count", n).where("queries > 0").select(key, "_d", "count", "queries")


def lookup_ceiling(df: DataFrame, signature: list[str], label: str) -> DataFrame:
    """Rows (signature..., n, best): how many labels the commonest label of each signature gets right."""
    c = df.groupBy(*signature, label).agg(F.count("*").alias("_c"))
    return c.groupBy(*signature).agg(F.sum("_c").alias("n"), F.max("_c").alias("best"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed and expected agreement, Cohen's kappa; null when the expected one is 1."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_c"))
    m = c.select(F.col("_a").alias("_k"), F.col("_c").alias("_x"), F.lit(0).cast("bigint").alias("_y")).unionAll(c.select("_b", F.lit(0).cast("bigint"), "_c"))
    m = m.groupBy("_k").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y")).agg(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0)).alias("_dot"))
    t = c.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)), F.lit(0)).alias("_same"))
    one = t.crossJoin(m)  # one row each
    po, pe = F.col("_same") / F.greatest("n", F.lit(1)), F.col("_dot") / F.greatest(F.col("n") * F.col("n"), F.lit(1))
    return one.select("n", po.alias("observed"), pe.alias("expected"), F.when((F.col("n") > 0) & (F.col("_dot") < F.col("n") * F.col("n")), (po - pe) / (1 - pe)).alias("kappa"))


def macro_f1(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """Rows (class, tp, fp, fn, f1); a class that does not occur has 0. The mean is over all classes."""
    parts = [F.struct(F.lit(c).alias("class"), F.count_if((F.col(truth) == c) & (F.col(pred) == c)).alias("tp"), F.count_if((F.col(truth) != c) & (F.col(pred) == c)).alias("fp"), F.count_if((F.col(truth) == c) & (F.col(pred) != c)).alias("fn")) for c in classes]
    rows = df.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    two = 2.0 * F.col("tp")
    return rows.select("class", "tp", "fp", "fn", F.when(F.col("tp") > 0, two / (two + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"))
