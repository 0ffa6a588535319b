"""Removes later copies of repeated line runs, found with a suffix array over line-ID sequences.

A text is the sequence of its lines that hold words; a line's id is a 64-bit hash of the stripped line. Only lines
that occur twice or more can belong to a repeated run, so the sequences are cut into stretches of such lines, and only
stretches of at least `min_words` words go on.

Prefix doubling: rank 0 orders suffixes by their first line. A round takes the rank of a suffix and that of the suffix
2^k lines later, sorts the distinct pairs by range, and the place in that order is the rank by the first 2^(k+1) lines.
Rounds go on until the ranks are as deep as the longest stretch or as `min_words` lines, which hold that many words.

The suffix array is the table of suffixes in the order of the last rank, dealt by range and sorted; ties are dealt by
document, so that equal suffixes meet no single task. Neighbours are compared line by line for their longest common
prefix, to the depth that a suffix asks for. An interval of depth d ends where that prefix is shorter than d: the
number of such places before a suffix names its interval, counted within tasks and carried over their borders by one
row a task. A suffix asks for the least number of lines with `min_words` words from it, and for the numbers that make
it the last beginning of so many words before some line. In each interval the first place (least document key, then
text hash, then line) is kept and the lines of the others are deleted. Every line of a window of at least `min_words`
words that occurs earlier lies in a least window from its start or to its end that does so too: together they are the
whole maximal runs.

Cases: null or empty texts have no lines and stay. Rows that repeat both key and text are one document and get equal
results; rows with equal keys, or none, and different texts are different documents. An empty table gives an empty
result. Blank lines stay where they are and do not break a run. Extra columns pass through `dedup_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import checkpointed, grouped, map_texts, small

MIN_WORDS = 50


def _hash(s: str) -> int:
    """What xxhash64 of Spark makes of a text."""
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), 1000):
            part = frame.iloc[at : at + 1000]
            rows = []
            for text in part["text"]:
                lines = [(s, len(s.split())) for s in map(str.strip, (text or "").split("\n")) if s]
                rows.append((_hash(text or ""), [_hash(s) for s, _ in lines], [n for _, n in lines]))
            yield pd.DataFrame({"key": part["key"], "th": [r[0] for r in rows], "lines": [r[1] for r in rows], "words": [r[2] for r in rows]})


def _suffixes(min_words: int):
    """Suffixes of the stretches of a document: position, stretch, rank, the depths they ask for, and their first lines
    to the greatest of these."""

    def run(t: pa.Table) -> pa.Table | None:
        pos, words, rank = (t.column(c).to_numpy() for c in ("pos", "words", "r"))
        cut = np.r_[0, np.nonzero(np.diff(pos) != 1)[0] + 1, len(pos)]
        keep, depths, heads = [], [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            total = np.r_[0, np.cumsum(words[a:b])]
            if total[-1] < min_words:
                continue
            n = b - a
            m = np.searchsorted(total, total[:-1] + min_words) - np.arange(n)
            begins = np.searchsorted(total, total[1:] - min_words, side="right") - 1
            asked: list[set[int]] = [{int(x)} if i + x <= n else set() for i, x in enumerate(m)]
            for end in np.flatnonzero(begins >= 0):
                asked[begins[end]].add(int(end + 1 - begins[end]))
            keep.append((pos[a:b], np.full(n, pos[a]), rank[a:b]))
            depths += [sorted(x) for x in asked]
            heads += [rank[a + i : a + i + max(x, default=0)] for i, x in enumerate(asked)]
        if not keep:
            return None
        p, s, r = (np.concatenate(x) for x in zip(*keep, strict=True))
        n = len(p)
        offsets = np.cumsum([0, *map(len, heads)]).astype(np.int32)
        head = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads).astype(np.int64)))
        return pa.table({"doc": pa.array(t.column("doc").to_pylist()[:1] * n, t.schema.field("doc").type), "th": pa.array(t.column("th").to_pylist()[:1] * n, pa.int64()), "stretch": pa.array(s, pa.int32()), "pos": pa.array(p, pa.int32()), "r": pa.array(r, pa.int64()), "depths": pa.array(depths, pa.list_(pa.int32())), "head": head})

    return run


def common_prefixes(heads: list[np.ndarray]) -> np.ndarray:
    """Equal leading lines of each head and the one before it."""
    size = np.array([len(h) for h in heads])
    wide = np.full((len(heads), max(1, size.max())), -1, np.int64)
    wide[np.arange(wide.shape[1]) < size[:, None]] = np.concatenate(heads)
    equal = (wide[1:] == wide[:-1]) & (wide[1:] >= 0)
    return np.logical_and.accumulate(equal, axis=1).sum(1)


def _heads(batch: pa.RecordBatch) -> list[np.ndarray]:
    col = batch.column("head")
    at = col.offsets.to_numpy()
    return np.split(col.flatten().to_numpy(), at[1:-1] - at[0])


def _borders(depth: int):
    """For each task: its first and last head, and at how many places within it the common prefix is shorter than d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        breaks = np.zeros(depth + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = _heads(batch)
            first = heads[0] if first is None else first
            lcp = common_prefixes(heads if last is None else [last, *heads])
            breaks += (lcp[:, None] < np.arange(depth + 1)).sum(0)
            last, pid = heads[-1], batch.column("pid")[0].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"pid": [pid], "first": [first.tolist()], "last": [last.tolist()], "breaks": [breaks.tolist()]}, pa.schema([("pid", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("first", "last", "breaks"))]))

    return run


def _intervals(depth: int, before: dict[int, np.ndarray]):
    """Names the interval of each depth that a suffix asks for: the depth and the number of breaks so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = _heads(batch)
            if last is None:
                count, lcp = before[batch.column("pid")[0].as_py()], np.r_[depth, common_prefixes(heads)]
            else:
                lcp = common_prefixes([last, *heads])
            last = heads[-1]
            counts = count + np.cumsum(lcp[:, None] < np.arange(depth + 1), axis=0)
            count = counts[-1]
            asked = batch.column("depths")
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            d = asked.flatten().to_numpy()
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in ("doc", "th", "pos")), pa.array(d, pa.int32()), pa.array(counts[row, d], pa.int64())], names=["doc", "th", "pos", "m", "interval"])

    return run


def _carried(borders: list, depth: int) -> dict[int, np.ndarray]:
    """Breaks up to the first row of each task, from one row a task."""
    out: dict[int, np.ndarray] = {}
    count, last = np.zeros(depth + 1, np.int64), None
    for b in sorted(borders, key=lambda r: r["pid"]):
        if last is not None:
            count = count + (common_prefixes([np.array(last, np.int64), np.array(b["first"], np.int64)])[0] < np.arange(depth + 1))
        out[b["pid"]] = count
        count, last = count + np.array(b["breaks"]), b["last"]
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc, th, pos, m): m lines from the pos-th line with words of a document are a later copy."""
    kind = docs.schema[key].dataType.simpleString()
    lines = checkpointed(map_texts(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc", "text", _lines, "th bigint, lines array<bigint>, words array<int>").where("size(lines) > 0"))
    again = checkpointed(lines.groupBy("doc", "th").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc").alias("d"), F.col("th").alias("t")))
    same = lines["doc"].eqNullSafe(again["d"]) & (lines["th"] == again["t"])
    copies = lines.join(small(again), same, "left_semi").groupBy("doc", "th").agg(F.first("lines").alias("lines"), F.first("words").alias("words"))
    lines = lines.join(small(again), same, "left_anti").unionByName(copies)  # each document once

    repeated = lines.select(F.explode("lines").alias("line")).groupBy("line").count().where("count > 1").select("line")
    ranked = checkpointed(repeated.repartitionByRange("line").sortWithinPartitions("line").withColumn("r", F.monotonically_increasing_id()))
    flat = lines.select("doc", "th", F.posexplode(F.arrays_zip("lines", "words")).alias("pos", "x")).select("doc", "th", "pos", F.col("x.lines").alias("line"), F.col("x.words").alias("words"))
    flat = flat.join(small(ranked), "line").drop("line")
    suffix = checkpointed(grouped(flat, ["doc", "th"], ["pos"], _suffixes(min_words), f"doc {kind}, th bigint, stretch int, pos int, r bigint, depths array<int>, head array<bigint>"))
    deepest = suffix.agg(F.max(F.size("head"))).first()[0] or 0

    ranks, deep = suffix.select("doc", "th", "stretch", "pos", "r"), 1
    stretch = Window.partitionBy("doc", "th", "stretch").orderBy("pos")
    while deep < deepest:
        paired = checkpointed(ranks.withColumn("next", F.coalesce(F.lead("r", deep).over(stretch), F.lit(-1))))
        pairs = paired.select(F.col("r").alias("x"), F.col("next").alias("y")).distinct()
        order = checkpointed(pairs.repartitionByRange("x", "y").sortWithinPartitions("x", "y").withColumn("new", F.monotonically_increasing_id()))
        ranks = paired.join(small(order), (paired["r"] == order["x"]) & (paired["next"] == order["y"])).select("doc", "th", "stretch", "pos", F.col("new").alias("r"))
        deep *= 2

    places = ["doc", "th", "pos"]
    asked = suffix.where(F.size("depths") > 0).select(*places, "depths", "head").alias("s")
    ranks = ranks.select(*(F.col(c).alias(f"{c}_") for c in places), F.col("r").alias("r"))
    found = asked.join(ranks, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("th") == F.col("th_")) & (F.col("pos") == F.col("pos_"))).select("r", *places, "depths", "head")
    array = checkpointed(found.repartitionByRange("r", *places).sortWithinPartitions("r", *places)).withColumn("pid", F.spark_partition_id())
    borders = array.mapInArrow(_borders(deepest), "pid int, first array<bigint>, last array<bigint>, breaks array<bigint>").collect()  # one row a task
    named = checkpointed(array.mapInArrow(_intervals(deepest, _carried(borders, deepest)), f"doc {kind}, th bigint, pos int, m int, interval bigint"))
    first = checkpointed(named.groupBy("m", "interval").agg(F.min(F.struct(*places)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return named.join(small(first), ["m", "interval"]).where(~F.struct(*places).eqNullSafe(F.col("first"))).select(*places, "m")


def _clean(text: str | None, runs: list[dict]) -> tuple[str | None, int, int]:
    """The text without its runs, and the numbers of lines with words before and after."""
    if not text:
        return text, 0, 0
    lines = text.split("\n")
    at = [i for i, s in enumerate(lines) if s.strip()]
    gone = {at[p] for r in runs for p in range(r["pos"], min(r["pos"] + r["m"], len(at)))}
    return ("\n".join(s for i, s in enumerate(lines) if i not in gone) if gone else text), len(at), len(at) - len(gone)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of `docs` with later copies of repeated runs deleted from the text, and n_lines, n_kept."""
    runs = repeated_runs(docs, min_words, text, key)
    by_doc = checkpointed(runs.groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "m")).alias("cut_runs")))  # at most two for each line of a text
    by_doc = small(by_doc, cells=2 * F.size("cut_runs")).select(F.col("doc").alias("run_doc"), F.col("th").alias("run_th"), "cut_runs")
    cols = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    here = docs.select(F.struct(*cols).alias("row"))
    same = F.col(f"row.`{key}`").eqNullSafe(F.col("run_doc")) & (F.xxhash64(F.col(f"row.`{text}`")) == F.col("run_th"))
    joined = here.join(by_doc, same, "left").select(*(F.col("row")[c].alias(c) for c in cols), F.col("cut_runs").alias("the runs to cut"))
    schema = joined.drop("the runs to cut").withColumn("n_lines", F.lit(0)).withColumn("n_kept", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                t = pa.Table.from_batches([batch.slice(at, 1000)])
                out = [_clean(s, cuts or []) for s, cuts in zip(t.column(text).to_pylist(), t.column("the runs to cut").to_pylist(), strict=True)]
                place = t.column_names.index(text)
                t = t.set_column(place, text, pa.array([x[0] for x in out], pa.string())).drop_columns(["the runs to cut"])
                t = t.append_column("n_lines", pa.array([x[1] for x in out], pa.int32())).append_column("n_kept", pa.array([x[2] for x in out], pa.int32()))
                yield from t.to_batches()

    return joined.mapInArrow(run, schema)
