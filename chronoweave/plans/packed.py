"""The mentions of `order_mentions`, whole orders at a time, as columns of numbers.

Lines and orders meet in parts of whole orders as packed columns, so no exchange has a row for each of them; suppliers and
parts are looked up in arrays that every task gets, so there may be FEW of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import walks as W
from chronoweave.plans.bindings import FEW
from chronoweave.sources.readers import table

#: Lines in a part, lines that are packed at once, and orders with following keys that go to one part.
LINES, ROWS, BLOCK = 300_000, 1_000_000, 256
#: Stands for null: it comes after all values, so the least value is null only where all are.
NONE = 2**63 - 1
#: By the number that `_flag` gives: 1 A, 2 R, 3 N, 0 for other flags.
_FLAGS = np.array([0, 1, 0, 3, 0, 2, 0, 0])


def _flag(f: Column) -> Column:
    """Numbers in the order of the flags, so that the number of the least flag is the least number."""
    return F.when(f < "A", 0).when(f == "A", 1).when(f < "N", 2).when(f == "N", 3).when(f < "R", 4).when(f == "R", 5).when(f.isNotNull(), 6).otherwise(7)


def matches(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in `wanted`, in `keys`) of all equal pairs, in the order of `wanted`; `keys` are sorted."""
    if len(keys) and (keys[1:] != keys[:-1]).all():
        dense = keys[-1] - keys[0] == len(keys) - 1
        low = np.clip(wanted, keys[0], keys[-1]) - keys[0] if dense else np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        at = np.flatnonzero(keys[low] == wanted)
        return at, low[at]
    low = np.searchsorted(keys, wanted)
    n = np.searchsorted(keys, wanted, "right") - low
    at = np.repeat(np.arange(len(wanted)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NONE).to_numpy()


def _sent(rows: DataFrame, what: int, parts: int) -> DataFrame:
    """Rows (part, what, data): packed columns of the rows, sorted by article, by part."""
    names = rows.columns

    def run(batches):
        def flush(kept):
            t = pa.Table.from_batches(kept)
            x = {c: _numbers(t[c]) for c in names}
            part = ((x["article"] // BLOCK).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(x["article"])
            order = order[np.argsort(part[order].astype(np.uint16 if parts < 2**16 else np.int64), kind="stable")]
            bounds = np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))
            some = np.flatnonzero(np.diff(bounds))
            data = []
            for p in some:
                mine = order[bounds[p] : bounds[p + 1]]
                data.append(W.pack({c: np.diff(x[c][mine], prepend=0) if c == "article" else x[c][mine] for c in names}))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), what, np.int32)), pa.array(data, pa.binary())], ["part", "what", "data"])

        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield flush(kept)
                kept, n = [], 0
        if n:
            yield flush(kept)

    return rows.mapInArrow(run, "part int, what int, data binary")


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    found = [W.unpack([b]) for b in blobs]
    return {c: np.concatenate([np.cumsum(x[c]) if c == "article" else x[c] for x in found]) for c in found[0]}


def _mentions(lines: dict[str, np.ndarray], orders: dict[str, np.ndarray], suppliers: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
    """Columns (article, slot, event, flag, report, publisher, supplier, part), sorted by article and slot; the last two are places in the sorted keys."""
    slot, article = lines["slot"], lines["article"]
    narrow = slot.min() >= 0 and slot.max() < 2**12 and article.min() >= 0 and article.max() < 2**50
    order = np.argsort(article << 12 | slot) if narrow else np.lexsort((slot, article))
    x = {c: v[order] for c, v in lines.items()}
    start = np.flatnonzero(np.r_[True, (x["article"][1:] != x["article"][:-1]) | (x["slot"][1:] != x["slot"][:-1])])
    x = {c: x[c][start] if c in ("article", "slot") else np.minimum.reduceat(x[c], start) for c in x}
    x["flag"] = _FLAGS[x["flag"]]
    order = np.argsort(orders["article"], kind="stable")
    at, there = matches(orders["article"][order], x["article"])
    x = {c: v[at] for c, v in x.items()} | {c: orders[c][order][there] for c in ("report", "publisher")}
    for c, keys in (("supplier", suppliers), ("part", parts)):
        at, there = matches(keys, x[c])
        x = {k: there if k == c else v[at] for k, v in x.items()}
    return x


def in_parts(spark: SparkSession, d: str, publishers: tuple[Column, pa.Array], supplier: list[Column], part: list[Column]) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]], pa.Table, pa.Table] | None:
    """(rows, mentions, suppliers, parts): packed rows, what turns batches of them into columns of whole orders, and two tables by key.

    `publisher` of a mention is its place in `publishers`, from 1, and 0 for null; `supplier` and `part` are its places in
    the tables, which have the given columns. None if these are too many to look up.
    """
    found = []
    for name, key, more in (("supplier", "s_suppkey", supplier), ("part", "p_partkey", part)):
        rows = table(spark, d, name).where(F.col(key).isNotNull())
        if rows.count() > FEW:
            return None
        found.append(rows.select(F.col(key).cast("bigint").alias("key"), *more).toArrow().sort_by("key"))
    suppliers, parts = (t["key"].to_numpy() for t in found)
    lines = table(spark, d, "lineitem")
    n = max(1, -(-lines.count() // LINES))
    c = F.col
    lines = lines.where("l_orderkey is not null").select(c("l_orderkey").alias("article"), c("l_linenumber").alias("slot"), F.unix_date(F.to_date("l_shipdate")).alias("event"), c("l_suppkey").alias("supplier"), c("l_partkey").alias("part"), _flag(c("l_returnflag")).alias("flag"))
    place, values = publishers
    names = F.create_map(*[F.lit(x) for i, v in enumerate(values.to_pylist()) for x in (v, i + 1)]) if len(values) else None
    number = F.coalesce(F.try_element_at(names, place), F.lit(0)) if names is not None else F.lit(0)
    orders = table(spark, d, "orders").where("o_orderkey is not null").select(c("o_orderkey").alias("article"), F.unix_date(F.to_date("o_orderdate")).alias("report"), number.alias("publisher"))

    def mentions(batches):
        kept: dict[int, tuple[list, list]] = {}
        for b in batches:
            for p, what, data in zip(*(b[k].to_pylist() for k in ("part", "what", "data")), strict=True):
                kept.setdefault(p, ([], []))[what].append(data)
        for p in sorted(kept):
            mine = kept.pop(p)
            if all(mine):
                x = _mentions(*map(_unpacked, mine), suppliers, parts)
                if len(x["article"]):
                    yield x

    return _sent(lines, 0, n).unionByName(_sent(orders, 1, n)).repartitionById(n, c("part")), mentions, *found
