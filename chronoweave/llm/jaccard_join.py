"""N-gram Jaccard self-join by chosen paths.

Every set of word shingles is embedded as `COORDS` min-hash coordinates. In each of `runs` independent runs the
sets start in one node; a node is split on a coordinate that its path chooses, so that sets which share the sampled
token stay together. A node with at most `leaf` sets is compared by brute force; larger ones are split again, down to
`depth` levels, and what is still large there is compared in square blocks. A pair of similarity s survives a run with
probability s**level, so `runs` is the least number that brings a pair at the threshold to the target recall even at
the deepest level.

Exact: copies are joined by a digest of their whole set, and each surviving pair is verified on whole sets. A pair is
counted in the first run that brings it together, found by comparing the nodes of earlier runs; pairs are never
written out. Each block emits the number of links of each set and one edge to the least set of its local component.

Cases: rows with a null key are texts like others; they take the least key of their class that is not null. A null text or one without words has no set: its row has its own class and no links. A text of fewer than five
words is a single shingle. Repeated rows are copies of each other. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import WordHashes, checkpointed, grouped, map_texts, mix, shingles, small, words
from chronoweave.llm.components import connected_components

COORDS = 64
#: Sets and shingles in a side of a block of a large node.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000


def runs_for(similarity: float, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def _odd(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _signatures(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """Min-hash coordinates of non-empty sets, in blocks of bounded size."""
    out = np.empty((len(sets), coords), np.uint64)
    odd, start = _odd(coords), 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= 200_000):
            total += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        at = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        for c in range(coords):
            out[start:stop, c] = np.minimum.reduceat(flat * odd[c], at)
        start = stop
    return out


def _paths(sig: np.ndarray, runs: int, depth: int) -> np.ndarray:
    """Node of each set at each level of each run: rows, runs, levels.

    A run has coordinates of its own, and each level of it too, among which the path chooses; so neither runs nor
    levels depend on each other, and the recall is that of `runs_for`.
    """
    n = len(sig)
    keys = np.empty((n, runs, depth), np.uint64)
    rows, choice = np.arange(n), sig.shape[1] // (runs * depth)
    for r in range(runs):
        path = np.full(n, r + 1, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for level in range(depth):
            coord = (r * depth + level) * choice + (path % np.uint64(choice)).astype(np.int64)
            path = mix(path ^ mix(sig[rows, coord] + np.uint64(level + 1)))
            keys[:, r, level] = path
    return keys


def _text_hash(text: str | None) -> int:
    """What xxhash64 of Spark makes of the text."""
    value = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), seed=42)
    return value - (value >> 63 << 64)


def _sketch(col: str, size: int, runs: int, depth: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        coords = max(COORDS, runs * depth)
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                sets = [shingles(hashes.of(words(t)), size) for t in part[col]]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = _signatures([sets[i] for i in full], coords) if full else np.empty((0, coords), np.uint64)
                paths = _paths(sig, runs, depth).reshape(len(full), runs * depth).astype(np.int64)
                digest, bits, path = [None] * len(part), [None] * len(part), [None] * len(part)
                low = (sig[:, :COORDS] & np.uint64(0xFFFF)).astype(np.uint16)
                for k, i in enumerate(full):
                    digest[i], bits[i], path[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), low[k].tobytes(), paths[k]
                yield pd.DataFrame({"key": part["key"], "fp": digest, "h": [_text_hash(t) for t in part[col]], "n": [len(s) for s in sets], "sig": bits, "path": path})

    return run


def _sets(col: str, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            for at in range(0, len(frame), 500):
                sets = [shingles(hashes.of(words(t)), size) for t in frame[col].iloc[at : at + 500]]
                yield pd.DataFrame({"fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "items": [s.tobytes() for s in sets]}).dropna(subset=["fp"])

    return run


def _unseen(nodes: np.ndarray, run: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs that no earlier run has in one node (0: alone in that run)."""
    out = np.ones((len(left), len(right)), bool)
    for r in range(run):
        a, b = nodes[left, r], nodes[right, r]
        out &= (a[:, None] != b[None, :]) | (a == 0)[:, None]
    return out


def _sides(ci: int, cj: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.arange(len(slot))
    return (rows, rows) if ci == cj else (rows[slot == ci], rows[slot == cj])


def _matrix(t: pa.Table, col: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(col).to_pylist()), dtype).reshape(t.num_rows, -1)


def _prune(similarity: float, slack: float):
    """Keeps the sets of a block that have an unseen partner whose size and sketch allow the similarity."""

    def run(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        sig, nodes = _matrix(t, "sig", np.uint16), np.asarray(t.column("nodes").to_pylist(), np.int64)
        n, slot = t.column("n").to_numpy(), t.column("slot").to_numpy()
        left, right = _sides(t.column("ci")[0].as_py(), t.column("cj")[0].as_py(), slot)
        keep = np.zeros(t.num_rows, bool)
        step = max(1, 4_000_000 // (COORDS * max(1, len(right))))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            ok = _unseen(nodes, t.column("run")[0].as_py(), rows, right) & (rows[:, None] != right[None, :])
            a, b = n[rows][:, None], n[right][None, :]
            ok &= np.minimum(a, b) >= similarity * np.maximum(a, b)
            if ok.any():
                ok &= (sig[rows][:, None, :] == sig[right][None, :, :]).sum(-1) >= (similarity - slack) * COORDS
                keep[rows] |= ok.any(1)
                keep[right] |= ok.any(0)
        return t.filter(pa.array(keep)).select(["node", "ci", "cj", "run", "slot", "fp", "n", "copies", "nodes"]) if keep.any() else None

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, by matrix products over slices of the shared tokens."""
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    del order
    token = np.cumsum(np.r_[True, flat[1:] != flat[:-1]], dtype=np.int32) - 1
    del flat
    keep = (np.bincount(token) > 1)[token]
    token, owner = token[keep], owner[keep]
    if len(token):
        token = np.cumsum(np.r_[True, token[1:] != token[:-1]], dtype=np.int32) - 1
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(1, min(2048, 4_000_000 // len(sets)))
    whole = left is right
    for low in range(0, (int(token[-1]) + 1) if len(token) else 0, width):
        a, b = np.searchsorted(token, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], token[a:b] - low] = 1
        out += m @ m.T if whole else m[left] @ m[right].T
    return out


def _verify(similarity: float):
    def run(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        t = t.sort_by("fp")
        sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        nodes = np.asarray(t.column("nodes").to_pylist(), np.int64)
        n, slot, copies = t.column("n").to_numpy().astype(np.float64), t.column("slot").to_numpy(), t.column("copies").to_numpy()
        left, right = _sides(t.column("ci")[0].as_py(), t.column("cj")[0].as_py(), slot)
        if not len(left) or not len(right):
            return None
        ok = _overlaps(sets, left, right)
        # inter / (a + b - inter) >= s, in whole numbers but for s
        ok = ok.astype(np.float64) * (1 + similarity) >= similarity * (n[left][:, None] + n[right][None, :]) - 1e-3
        ok &= _unseen(nodes, t.column("run")[0].as_py(), left, right) & (left[:, None] != right[None, :])
        links = np.zeros(t.num_rows, np.int64)
        links[left] += ok @ copies[right]
        if t.column("ci")[0].as_py() != t.column("cj")[0].as_py():
            links[right] += ok.T @ copies[left]

        # least member of each local component; as many rounds as a component is wide
        root, last = np.arange(t.num_rows), None
        while last is None or (root != last).any():
            last = root.copy()
            for rows, cols, pairs in ((left, right, ok), (right, left, ok.T)):
                near = np.where(pairs, root[cols].astype(np.int32)[None, :], np.int32(t.num_rows)).min(1, initial=t.num_rows)
                root[rows] = np.minimum(root[rows], near)
            root = root[root]
        at = np.nonzero(links)[0]
        fp = t.column("fp").to_pylist()
        return pa.table({"fp": pa.array([fp[i] for i in at], pa.binary()), "links": pa.array(links[at], pa.int64()), "root": pa.array([fp[root[i]] for i in at], pa.binary())}) if len(at) else None

    return run


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8, recall: float = 0.9995, leaf: int = 256, depth: int = 3, slack: float = 0.25) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each row of `docs`.

    n_links counts the other rows whose set has at least the similarity; class_id is the least key that links reach.
    """
    runs = runs_for(similarity, depth, recall)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sketch = checkpointed(map_texts(source, "doc_id", "text", _sketch("text", size, runs, depth), "fp binary, h bigint, n int, sig binary, path array<bigint>"))
    reps = checkpointed(sketch.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("h").alias("h"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("path").alias("path")))

    open_ = reps.select("fp", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("path", r * depth + 1, F.lit(depth)))).alias("run", "path"))
    leaves = []
    for level in range(depth):
        open_ = open_.withColumn("node", F.col("path")[level])
        sizes = open_.groupBy("node").agg(F.count("*").alias("sets"), F.sum("n").alias("items")).where("sets > 1")
        # as a table of its own, so that Spark can split the partition of a node that holds very many sets
        open_ = checkpointed(open_.join(small(checkpointed(sizes)), "node"))
        done = F.lit(True) if level == depth - 1 else (F.col("sets") <= leaf) & (F.col("items") <= BLOCK_SHINGLES)
        leaves.append(open_.where(done).select("fp", "run", "node", "sets", "items"))
        open_ = open_.where(~done).drop("node", "sets", "items")
        if level < depth - 1 and open_.isEmpty():
            break
    found = leaves[0]
    for x in leaves[1:]:
        found = found.unionByName(x)

    at = F.sequence(F.lit(0), F.lit(runs - 1))
    homes = found.groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("run", F.struct("node", "sets", "items")))).alias("by"))
    homes = homes.withColumn("nodes", F.transform(at, lambda r: F.coalesce(F.try_element_at("by", r)["node"], F.lit(0).cast("bigint"))))
    member = homes.join(reps.select("fp", "n", "sig", "copies"), "fp").select("fp", "n", "sig", "copies", "nodes", F.explode("by").alias("run", "at"))
    member = member.select("fp", "n", "sig", "copies", "nodes", "run", F.col("at.node").alias("node"), F.greatest(F.ceil(F.col("at.sets") / BLOCK_SETS), F.ceil(F.col("at.items") / BLOCK_SHINGLES)).cast("int").alias("g"))
    member = member.withColumn("slot", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    member = member.select("node", F.least("slot", "other").alias("ci"), F.greatest("slot", "other").alias("cj"), "run", "slot", "fp", "n", "copies", "nodes", "sig")
    kept = checkpointed(grouped(member, ["node", "ci", "cj"], [], _prune(similarity, slack), "node bigint, ci int, cj int, run int, slot int, fp binary, n int, copies bigint, nodes array<bigint>"))

    wanted = checkpointed(kept.select("fp").distinct())
    texts = checkpointed(reps.join(wanted, "fp").select("h").distinct())  # one text of each set, whatever its key
    items = source.select("text", F.xxhash64("text").alias("h")).join(small(texts), "h", "left_semi").mapInPandas(_sets("text", size), "fp binary, items binary").dropDuplicates(["fp"])
    linked = checkpointed(grouped(kept.join(items, "fp"), ["node", "ci", "cj"], [], _verify(similarity), "fp binary, links bigint, root binary"))

    roots = connected_components(linked, "fp", "root")
    links = linked.groupBy("fp").agg(F.sum("links").alias("links"))
    table = reps.select("fp", "least", "copies").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = table.groupBy("root").agg(F.min("least").alias("class_id"))
    table = checkpointed(table.join(least, "root").join(links, "fp", "left").select("fp", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return sketch.select("doc_id", "fp").join(table, "fp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
