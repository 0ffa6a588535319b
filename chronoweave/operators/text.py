"""Corpus text: profiles, duplicates, near copies, containment, greedy matching, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.scalar import jaccard, sketch
from chronoweave.operators.graph import components, stable
from chronoweave.operators.ranking import band_pairs

QUOTES_AT_ONCE = 100_000


def containment(docs: DataFrame, quotes: DataFrame, key: str, text: str, quote_key: str, quote: str) -> DataFrame:
    """Rows (key, quote_key): quotes that occur in a text.

    Texts stream once through an automaton of the quotes; more than `QUOTES_AT_ONCE` quotes are taken in blocks.
    """
    own = quotes.select(F.col(quote_key).alias("k"), F.col(quote).alias("q")).where("q is not null and q <> ''")
    blocks = max(1, -(-own.count() // QUOTES_AT_ONCE))
    kind, quote_kind = docs.schema[key].dataType.simpleString(), quotes.schema[quote_key].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"{key} {kind}, {quote_key} {quote_kind}")
    for b in range(blocks):
        rows: dict[str, list] = {}
        for r in own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect():
            rows.setdefault(r["q"], []).append(r["k"])
        if not rows:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            a = ahocorasick.Automaton()
            for q, ks in shared.value.items():
                a.add_word(q, ks)
            a.make_automaton()
            for f in frames:
                hits = [(d, k) for d, t in zip(f[key], f[text], strict=True) if t for k in sorted({k for _, ks in a.iter(t) for k in ks})]
                yield pd.DataFrame(hits, columns=[key, quote_key])

        out = out.unionByName(docs.select(key, text).mapInPandas(run, f"{key} {kind}, {quote_key} {quote_kind}"))
    return out


def duplicate_groups(df: DataFrame, text: str) -> DataFrame:
    """One row: groups of equal texts, records in them, records beyond the first."""
    g = df.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("beyond_first"))


def sketches(df: DataFrame, key: str, text: str, size: int = 5, keep: int = 32) -> tuple[DataFrame, DataFrame]:
    """(members, classes): rows with equal sketches form a class, whose representative is the least key."""
    s = stable(df.select(F.col(key).alias("id"), sketch(F.col(text), size, keep).alias("sketch")).where("size(sketch) > 0"))
    classes = stable(s.groupBy("sketch").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    return s.join(classes.select("sketch", "rep"), "sketch").select("id", "rep"), classes


def near_copies(classes: DataFrame, least: int = 8) -> DataFrame:
    """Rows (a, b, shared), a < b: representatives that share at least `least` sketch hashes."""
    # a pair that shares `least` hashes shares one outside the least-1 most frequent of either side: only those are
    # joined, so that a hash of very many texts makes no pairs by itself
    h = classes.select("rep", F.size("sketch").alias("k"), F.explode("sketch").alias("h"))
    often = h.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    rare = h.join(often, "h").withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("c", "h"))).withColumn("shared", F.count("*").over(Window.partitionBy("rep")))
    rare = stable(rare.where(F.col("n") <= F.col("shared") - least + 1).select("rep", "h"))
    x, y = rare.toDF("a", "h"), rare.toDF("b", "h")
    pairs = x.join(y, "h").where("a < b").select("a", "b").distinct()
    own = classes.select("rep", "sketch")
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("shared")).where(F.col("shared") >= least)


def near_copy_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (id, cluster) of all members: exact classes joined by near-copy pairs."""
    c = components(pairs, "a", "b")
    return members.join(c, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("cluster"))


def greedy_match(run: Column, ref: Column, least: float = 0.45) -> Column:
    """Array of (run, ref, score): each run item in order takes the best unused reference item, ties to the first.

    Both sides are arrays of token arrays of one article; the fold is sequential within an article only.
    """
    zero = F.expr("cast(array() as array<struct<run:int,ref:int,score:double>>)")

    def step(acc: Column, item: Column) -> Column:
        free = F.filter(F.transform(ref, lambda t, i: F.struct((-jaccard(item["t"], t)).alias("minus"), i.cast("int").alias("ref"))), lambda c: (c["minus"] <= -least) & ~F.exists(acc, lambda m: m["ref"] == c["ref"]))
        best = F.array_min(free)
        return F.when(best.isNotNull(), F.concat(acc, F.array(F.struct(item["i"].alias("run"), best["ref"].alias("ref"), (-best["minus"]).alias("score"))))).otherwise(acc)

    numbered = F.transform(run, lambda t, i: F.struct(t.alias("t"), i.cast("int").alias("i")))
    return F.aggregate(numbered, zero, step)


def stratified(df: DataFrame, strata: list[str], key: str, quota: int | Column, spread: str | None = None) -> DataFrame:
    """At most `quota` rows a stratum in the order of a hash of the key; with `spread`, its values take turns."""
    h = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    x = df.withColumn("_h", h)
    if spread:
        x = x.withColumn("_t", F.row_number().over(Window.partitionBy(*strata, spread).orderBy("_h", key)))
    else:
        x = x.withColumn("_t", F.lit(0))
    order = Window.partitionBy(*strata).orderBy("_t", "_h", key)
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota).drop("_h", "_t")


def structured_candidates(q: DataFrame, c: DataFrame, traits: list[str], width: int, need: int = 2) -> DataFrame:
    """Rows (id, cid, matches, gap): pairs that agree in at least `need` traits, once each, the candidate 1 to `width` days earlier and of another family.

    Queries have id, candidates cid; both have day, family and the traits. Each combination of `need` traits is joined
    within bins of days; a pair is kept by the first combination in which it agrees.
    """
    from itertools import combinations

    right = c.select("cid", F.col("day").alias("c_day"), F.col("family").alias("c_family"), *[F.col(t).alias(f"c_{t}") for t in traits])
    parts, seen = [], F.lit(False)
    matches = sum((F.coalesce((F.col(t) == F.col(f"c_{t}")).cast("int"), F.lit(0)) for t in traits), F.lit(0))
    for combo in combinations(traits, need):
        keyed = right.withColumns({t: F.col(f"c_{t}") for t in combo})
        pairs = band_pairs(q, keyed, list(combo), "day", "c_day", width).where("day > c_day and family <> c_family")
        parts.append(pairs.where(~F.coalesce(seen, F.lit(False))).select("id", "cid", matches.alias("matches"), F.datediff("day", "c_day").alias("gap")))
        same = F.lit(True)
        for t in combo:
            same = same & (F.col(t) == F.col(f"c_{t}"))
        seen = seen | same
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
