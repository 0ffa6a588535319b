"""Mixes sources to target weights by Pfair scheduling, with DataFrame functions only.

The rows of a source, in the order of a hash of their key, are cut into blocks of `block_rows`. A source has the
weight a/P: a whole number of the P slots of a period. Given weights are taken as decimal fractions; where their least
common whole multiples add up to at most `MAX_PERIOD` these are the slots, so that the weights hold exactly. Other
weights, such as the default square roots of the numbers of rows, are rounded to the nearest whole parts of `period`,
at least one, and P is their sum: what is scheduled differs from the target by at most about 1/(2 period) of the mix.

Block j of a source with weight w may not start before slot floor(j/w) and must not end after slot ceil((j+1)/w);
earliest-deadline-first among the released blocks meets all of these on one processor, so at every slot each source is
less than one block from its weight. All windows repeat after P slots, so one period is scheduled (a fold over an
array of the sources) and every block finds its slot from its number alone.

Many sources: above `MAX_SOURCES` they are dealt by hash into about the square root of their number of groups. The
groups are scheduled as above, and the sources of a group over the slots of the group; each is then less than two
blocks from its weight. No number of sources is refused.

When a source has no more rows its slots stay empty; `mix_exact` marks the slots before that, in which the weights
hold. Every row is kept; rows of a source with weight 0 have no slot (null) and are not exact.

No task gets a whole source: rows are numbered within (source, hash prefix), plus the number of rows with smaller
prefixes from a small count table.

Cases: a null source is a source of its own; a null key is replaced by the contents of its row. Rows with equal keys
are numbered in the order of their contents; equal rows in any order among themselves, which gives the same rows. An
empty table gives an empty result. Existing columns named like the new ones are replaced.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import checkpointed, small

PERIOD, BLOCK_ROWS, PREFIX = 1000, 16, 3
MAX_PERIOD, MAX_SOURCES = 4000, 1000
NEW = ("mix_block", "mix_slot", "mix_index", "mix_exact")


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in the same proportions, as far as their decimals say."""
    if any(v < 0 for v in weights.values()):
        raise ValueError("a weight is negative")
    parts = {k: Fraction(str(v)) for k, v in weights.items()}
    unit = lcm(*(x.denominator for x in parts.values())) if parts else 1
    whole = {k: int(x * unit) for k, x in parts.items()}
    common = gcd(*whole.values()) or 1
    if max(whole.values(), default=0) // common >= 2**40:  # sums stay within a long
        return {k: round(x * 2**40 / max(parts.values())) for k, x in parts.items()}
    return {k: v // common for k, v in whole.items()}


def _slots_of(part: str, whole: str, period: int) -> Column:
    """The whole number nearest to the part of the period, at least one."""
    return F.greatest(F.lit(1), F.floor(F.expr(f"({period} * {part} * 2 + {whole}) div (2 * {whole})"))).cast("bigint")


def shares(counts: DataFrame, weights: dict[str, float] | None, period: int) -> DataFrame:
    """Rows (s, rows, g, a, p, ga, gp) of sources (s, rows) with a weight: a of the p slots of group g, which has ga of the
    gp slots of the mixture. The default weight is the square root of the number of rows, in thousandths."""
    if weights is None:
        w = F.floor(F.sqrt("rows") * 1000).cast("bigint")
    else:
        named = F.create_map(*[F.lit(x) for k, v in whole_weights(weights).items() for x in (k, v)]) if weights else F.create_map()
        w = F.coalesce(F.try_element_at(named, F.substring("s", 2, 1_000_000)), F.lit(0)).cast("bigint")
    t = counts.withColumn("w", w).where("w > 0")
    facts = t.agg(F.count("*").alias("n"), F.sum("w").alias("total"))
    t = t.crossJoin(F.broadcast(facts))  # one row
    t = t.withColumn("g", F.when(F.col("n") <= MAX_SOURCES, 0).otherwise(F.pmod(F.xxhash64("s"), F.ceil(F.sqrt("n")))).cast("int"))
    groups = t.groupBy("g").agg(F.sum("w").alias("gw"), F.first("n").alias("n"), F.first("total").alias("total")).withColumn("ga", F.when(F.col("n") <= MAX_SOURCES, 1).otherwise(_slots_of("gw", "total", period)).cast("bigint"))
    all_ = groups.agg(F.sum("ga").alias("gp"))
    t = t.join(groups.select("g", "gw", "ga"), "g").crossJoin(F.broadcast(all_))
    t = t.withColumn("a", F.when(F.col("gw") <= MAX_PERIOD, F.col("w")).otherwise(_slots_of("w", "gw", period)))
    return t.join(t.groupBy("g").agg(F.sum("a").alias("p")), "g").select("s", "rows", "g", "a", "p", "ga", "gp")


def schedule(share: DataFrame) -> DataFrame:
    """Rows (g, s, j, slot) of sources (g, s, a, p): the slot in the group's period of the j-th block of each source."""
    one = share.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "a"))).alias("src"), F.first("p").alias("p"))
    p = F.col("p")

    def step(state: Column, t: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            nxt = state["nxt"][i]
            a = x["a"]
            return F.struct(F.floor((nxt * p + p + a - 1) / a).alias("due"), i.alias("i"), F.floor(nxt * p / a).alias("release"), nxt.alias("j"))

        pick = F.array_min(F.filter(F.transform("src", window), lambda c: c["release"] <= t))
        return F.struct(
            F.transform(state["nxt"], lambda x, i: F.when(i == pick["i"], x + 1).otherwise(x)).alias("nxt"),
            F.concat(state["out"], F.array(F.struct(pick["i"].alias("i"), pick["j"].alias("j")))).alias("out"),
        )

    zero = F.struct(F.transform("src", lambda x: F.lit(0).cast("bigint")).alias("nxt"), F.expr("cast(array() as array<struct<i:int,j:bigint>>)").alias("out"))
    folded = one.select("g", "src", F.aggregate(F.sequence(F.lit(0).cast("bigint"), p - 1), zero, step)["out"].alias("out"))
    rows = folded.select("g", "src", F.posexplode("out").alias("slot", "x"))
    return rows.select("g", F.col("src")[F.col("x.i")]["s"].alias("s"), F.col("x.j").alias("j"), F.col("slot").cast("bigint").alias("slot"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """The columns of `docs` and mix_block, mix_slot, mix_index (place in the block), mix_exact.

    The mixed order is that of (mix_slot, mix_index).
    """
    s = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source)))
    cols = [c for c in docs.columns if c not in NEW]
    contents = F.struct(*cols).cast("string")
    h = F.sha2(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), contents)).cast("binary"), 256)
    base = docs.select(F.struct(*cols).alias("row"), s.alias("s"), h.alias("h"), F.xxhash64(contents).alias("tie")).withColumn("pre", F.substring("h", 1, PREFIX))
    light = docs.select(s.alias("s"), F.substring(h, 1, PREFIX).alias("pre"))
    cells = checkpointed(light.groupBy("s", "pre").agg(F.count("*").alias("here")))
    before = cells.withColumn("before", F.sum("here").over(Window.partitionBy("s").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))).select("s", "pre", F.coalesce("before", F.lit(0)).alias("before"))
    share = checkpointed(shares(cells.groupBy("s").agg(F.sum("here").alias("rows")), weights, period))
    slots = checkpointed(schedule(share))
    # the groups are sources of a mixture of their own
    outer = checkpointed(schedule(share.select(F.lit(0).alias("g"), F.lpad(F.col("g").cast("string"), 10, "0").alias("s"), F.col("ga").alias("a"), F.col("gp").alias("p")).distinct()))
    outer = outer.select(F.col("s").cast("int").alias("g"), F.col("j").alias("gj"), F.col("slot").alias("gslot"))

    def placed(blocks: DataFrame) -> DataFrame:
        """Adds the slot of block `b` of source `s`."""
        found = blocks.join(small(share.select("s", "g", "a", "p", "ga", "gp")), "s", "left").withColumn("j", F.col("b") % F.col("a"))
        found = found.join(small(slots), ["g", "s", "j"], "left").withColumn("k", F.expr("b div a") * F.col("p") + F.col("slot")).withColumn("gj", F.col("k") % F.col("ga"))
        return found.join(small(outer), ["g", "gj"], "left").withColumn("mix_slot", F.expr("k div ga") * F.col("gp") + F.col("gslot"))

    end = placed(share.select("s", F.expr(f"rows div {block_rows}").alias("b"))).agg(F.min("mix_slot").alias("end"))
    place = F.row_number().over(Window.partitionBy("s", "pre").orderBy("h", "tie"))
    numbered = base.withColumn("place", place).join(before, ["s", "pre"]).withColumn("n", F.col("before") + F.col("place") - 1)
    found = placed(numbered.withColumn("b", F.expr(f"n div {block_rows}"))).crossJoin(F.broadcast(end))  # `end` is one row
    return found.select(*[F.col("row")[c].alias(c) for c in cols], F.col("b").alias("mix_block"), "mix_slot", (F.col("n") % block_rows).cast("int").alias("mix_index"), F.coalesce(F.col("mix_slot") < F.col("end"), F.lit(False)).alias("mix_exact"))
