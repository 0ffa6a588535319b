"""Sinks: tables, one document per key, reports, ordered id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns only, tab-separated with a header."""
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).option("lineSep", "\r\n").csv(path)


def write_latest(df: DataFrame, path: str, key: str, order: str) -> None:
    """One row for each key, the latest; partitions that a rerun holds are replaced, others stay."""
    last = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    last.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def report(df: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return df.select(F.to_json(F.struct("*")).alias("report"))


def ordered_ids(order: Column, key: Column) -> Column:
    """Aggregate: ids joined by commas in the order of their selection."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), key.cast("string").alias("k")))), lambda x: x["k"]), ",")


def manifest(tables: dict[str, DataFrame], caveats: list[str]) -> DataFrame:
    """Rows (name, rows, caveats) over the tables of a view."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("caveats", F.array(*map(F.lit, caveats)))
