"""Graph operators: components, view building, collapse, masked neighbourhoods, adjacency, closures."""

from __future__ import annotations

import tempfile
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. Where none is set, a local master gets one of this machine, as
    in tests; on a cluster that would be lost with its machine, so it is refused."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chronoweave-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def stable(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): root is the least node of the component; nodes without a pair do not appear.

    Labels fall to the least label of the neighbourhood, then jump to the label of their label, until none changes.
    """
    one = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = stable(one.union(one.select("v", "u")).distinct())
    label = stable(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        seen = edges.join(label, edges.v == label.node).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("seen"))
        low = label.join(seen, "node").select("node", "root", F.least("root", "seen").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = stable(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "root"))
        if new.where("new <> root").isEmpty():
            return new.select("node", "root")
        label = new.select("node", F.col("new").alias("root"))


def unpivot_edges(nodes: DataFrame, src: Column, src_type: str, links: dict[str, tuple[Column, str]], event_time: Column, report_time: Column) -> DataFrame:
    """One edge for each non-empty attribute: links are relation -> (attribute, type of the other end)."""
    rows = F.array(*[F.struct(F.lit(r).alias("relation"), c.cast("string").alias("dst_id"), F.lit(t).alias("dst_type")) for r, (c, t) in links.items()])
    cols = [src.cast("string").alias("src_id"), F.lit(src_type).alias("src_type"), event_time.alias("event_time"), report_time.alias("report_time")]
    e = nodes.select(*cols, F.explode(F.filter(rows, lambda x: F.nullif(F.trim(x["dst_id"]), F.lit("")).isNotNull())).alias("x"))
    return e.select("src_id", "src_type", "x.relation", "x.dst_id", "x.dst_type", "event_time", "report_time", F.col("report_time").alias("available_date"))


def rewrite_edges(edges: DataFrame, canonical: DataFrame, src: str = "src_id", dst: str = "dst_id") -> tuple[DataFrame, DataFrame]:
    """Edges with both ends replaced by (node, root), and those that became loops. Parallel edges stay."""
    m = canonical.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    out = edges.join(m.withColumnsRenamed({"_n": "_a", "_r": "_ra"}), F.col(src) == F.col("_a"), "left").join(m.withColumnsRenamed({"_n": "_b", "_r": "_rb"}), F.col(dst) == F.col("_b"), "left")
    out = out.withColumn(src, F.coalesce("_ra", src)).withColumn(dst, F.coalesce("_rb", dst)).drop("_a", "_ra", "_b", "_rb")
    return out.where(F.col(src) != F.col(dst)), out.where(F.col(src) == F.col(dst))


REGIMES = ("none", "event_time", "report_time")


def admitted(regime: str | Column, tau: Column, event_time: str = "event_time", available: str = "available_date") -> Column:
    """Whether an edge may be seen at tau. An edge without both times is seen in no regime."""
    r = F.lit(regime) if isinstance(regime, str) else regime
    happened, known = F.col(event_time), F.col(available)
    both = happened.isNotNull() & known.isNotNull()
    return both & ((r == "none") | ((r == "event_time") & (happened <= tau)) | ((r == "report_time") & (known <= tau)))


def masked_counts(edges: DataFrame, tau: Column) -> DataFrame:
    """Rows (regime, kept, masked, excluded) in one pass."""
    both = F.col("event_time").isNotNull() & F.col("available_date").isNotNull()
    parts = [F.struct(F.lit(r).alias("regime"), F.count_if(admitted(r, tau)).alias("kept"), F.count_if(both & ~admitted(r, tau)).alias("masked"), F.count_if(~both).alias("excluded")) for r in REGIMES]
    return edges.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def neighbourhoods(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Rows (seed, regime, edge, src, dst, hop) of the edges incident to nodes reached before the last hop.

    `edges` has edge, src, dst, event_time, available_date; `seeds` has seed, tau. Edges without both times are left
    out. All regimes run in one pass; frontiers are distinct (seed, regime, node).
    """
    usable = edges.where("event_time is not null and available_date is not null")
    ends = usable.select("edge", F.col("src").alias("at"), F.col("dst").alias("to"), "event_time", "available_date").unionByName(usable.select("edge", F.col("dst").alias("at"), F.col("src").alias("to"), "event_time", "available_date"))
    front = seeds.select("seed", "tau", F.explode(F.array(*map(F.lit, REGIMES))).alias("regime"), F.col("seed").alias("at"))
    seen, out = front, None
    for hop in range(hops):
        step = front.join(ends, "at").where(admitted(F.col("regime"), F.col("tau")))
        rows = step.select("seed", "tau", "regime", "edge", "at", "to", F.lit(hop + 1).alias("hop"))
        out = rows if out is None else out.unionByName(rows)
        if hop + 1 < hops:
            new = step.select("seed", "tau", "regime", F.col("to").alias("at")).distinct()
            front = new.join(seen, ["seed", "regime", "at"], "left_anti").select("seed", "tau", "regime", "at")
            seen = seen.unionByName(front)
    return out


def shared_counts(rows: DataFrame, key: str, attributes: list[str], masks: list[int]) -> DataFrame:
    """Rows (key, available_date, mask, none, event, report, both, latest): how many rows share all attributes of a mask.

    Bit i of a mask stands for attribute i. Counted are all rows (`none`), and those whose event time, report time or
    both are not after the row's own report time; `latest` is the last report counted by `report`. Counts are sums over
    days, so no pair of rows is written, and a value that a third of the rows share costs one row for each day. Rows
    without both times, or without a value in the mask, take no part.
    """
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    names = [f"_k{i}" for i in range(len(attributes))]
    lacks = reduce(or_, [has(i) & F.col(c).isNull() for i, c in enumerate(attributes)])
    sets = rows.where("event_time is not null and available_date is not null").withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).where(~lacks)
    sets = sets.select(key, "mask", *[F.when(has(i), F.col(c).cast("string")).otherwise("").alias(n) for i, (c, n) in enumerate(zip(attributes, names, strict=True))], "event_time", "available_date")
    days = {"event": F.col("event_time"), "report": F.col("available_date"), "both": F.greatest("event_time", "available_date")}
    moments = F.array(*[F.struct(day.alias("day"), *[F.lit(int(x == y)).alias(x) for x in days]) for y, day in days.items()])
    hist = sets.select("mask", *names, F.inline(moments)).groupBy("mask", *names, "day").agg(*[F.sum(x).alias(x) for x in days])
    every = Window.partitionBy("mask", *names)
    until = every.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    reported = F.when(F.col("report") > 0, F.col("day"))
    sums = hist.select("mask", *names, F.col("day").alias("available_date"), (F.col("report") > 0).alias("_asked"), F.sum("report").over(every).alias("none"), *[F.sum(x).over(until).alias(x) for x in days], F.max(reported).over(until).alias("latest"))
    return sets.drop("event_time").join(sums.where("_asked").drop("_asked"), ["mask", *names, "available_date"]).select(key, "available_date", "mask", "none", *days, "latest")


def adjacency(edges: DataFrame, rel: str, src: str, dst: str) -> DataFrame:
    """Rows (rel, row, col, weight): undirected, each pair once in a relation, rows add up to 1."""
    a = edges.select(F.col(rel).alias("rel"), F.col(src).alias("row"), F.col(dst).alias("col"))
    pairs = a.unionByName(a.select("rel", F.col("col").alias("row"), F.col("row").alias("col"))).distinct()
    n = pairs.groupBy("rel", "row").agg(F.count("*").alias("n"))
    return pairs.join(n, ["rel", "row"]).select("rel", "row", "col", (1.0 / F.col("n")).alias("weight"))


def adjacency_single(adj: DataFrame) -> DataFrame:
    """Rows (row, col, weight): relations added up, rows normalised again."""
    s = adj.groupBy("row", "col").agg(F.sum("weight").alias("w"))
    n = s.groupBy("row").agg(F.sum("w").alias("n"))
    return s.join(n, "row").select("row", "col", (F.col("w") / F.col("n")).alias("weight"))


def message(adj: DataFrame, features: DataFrame) -> DataFrame:
    """One hop: rows (rel, row, feature, value) as weighted sums of the neighbours' sparse features (node, feature, value)."""
    return adj.join(features, adj.col == features.node).groupBy("rel", "row", "feature").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def inverse(edges: DataFrame, names: dict[str, str], rel: str = "relation", src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges, and for each relation with an inverse the edge turned round."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    turned = edges.withColumn("_i", F.try_element_at(table, F.col(rel))).where("_i is not null").select(F.col(dst).alias(src), F.col("_i").alias(rel), F.col(src).alias(dst))
    return edges.select(src, rel, dst).unionByName(turned).distinct()


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Transitive closure by doubling the length of paths; for hierarchies, whose depth is small."""
    paths = stable(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    n = paths.count()
    while True:
        nxt = paths.select(F.col("a").alias("b"), F.col("b").alias("c"))
        paths = stable(paths.unionByName(paths.join(nxt, "b").select("a", F.col("c").alias("b"))).distinct())
        m = paths.count()
        if m == n:
            return paths.select(F.col("a").alias(src), F.col("b").alias(dst))
        n = m


def multi_valued(edges: DataFrame, rel: str, src: str, dst: str) -> DataFrame:
    """Subjects that break a functional property."""
    return edges.groupBy(rel, src).agg(F.count_distinct(dst).alias("values")).where("values > 1")


def sharing(edges: DataFrame, rel: str, src: str, dst: str) -> DataFrame:
    """For each relation: attributes, those of several subjects, of one, subjects covered, pairs of subjects sharing one."""
    deg = edges.groupBy(F.col(rel).alias("relation"), F.col(dst).alias("attribute")).agg(F.count_distinct(src).alias("degree"))
    return deg.groupBy("relation").agg(F.count("*").alias("attributes"), F.count_if(F.col("degree") > 1).alias("shared"), F.count_if(F.col("degree") == 1).alias("single"), F.max("degree").alias("largest"), F.sum(F.floor(F.col("degree") * (F.col("degree") - 1) / 2)).alias("two_hop_pairs"))


def latest_before(df: DataFrame, by: list[str], day: str) -> Column:
    """Whether a row is the latest of its group."""
    return F.col(day) == F.max(day).over(Window.partitionBy(*by))
