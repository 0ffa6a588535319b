"""Exact top-k inner products by best-first search in M-trees.

Inner product becomes a metric by one more component: x' = (x, sqrt(M - |x|^2)) and q' = (q, 0), with M the largest
squared norm, so that d(q', x')^2 = |q|^2 + M - 2 q.x. The vectors are dealt into shards of bounded size by a hash of
their id. A shard's tree has paged nodes; each entry stores its distance to the parent's routing object, and each
routing entry a covering radius. Queries descend in slices, best-first: a node is visited once for a slice, by those
queries alone for which its least possible distance is within the current k-th best, and an entry's distance is
computed only if |d(q, parent) - d(entry, parent)| - radius allows it for one of them. Scores of a page come from one
matrix product. Each shard's tree is built once for `QUERY_BLOCK` queries; the k best of each shard are merged.

Scores are whole numbers and exact: sums stay in float64 where the largest norm keeps them below 2^53, in 64-bit
integers below 2^62, and in Python integers beyond, where a score outside the range of a long is cut to that range.
Bounds are floats with a slack relative to the norms.

Cases: vectors that are null, or hold a null or non-finite component, and rows without an id take no part. Vectors of
different lengths have no inner product: a query meets those of its own length. Ties go to the smaller id. Rows with
the query's own id are no candidates; repeated ids are rows of their own otherwise. Fewer candidates than k give fewer
rows. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import checkpointed, grouped, small

SHARD_ROWS, QUERY_BLOCK, PAGE = 16_384, 65_536, 256
#: Queries that descend together.
SLICE = 1024
#: Relative to the largest distance.
SLACK = 1e-6
#: Cells are few bytes and much work, so each gets a task of its own up to this number.
MAX_TASKS = 10_000
LONG = 2**63 - 1


class MTree:
    """Bulk-loaded: pages are split around far-apart routing objects until they hold at most `page` entries."""

    def __init__(self, plain: np.ndarray, top: float, page: int = PAGE, seed: int = 5):
        """`plain` are whole vectors (float64, int64 or Python integers), `top` their largest squared norm or more."""
        self.bounded = bool(np.isfinite(top))  # beyond the range of a double all points are taken as one, and no bound holds
        x = plain.astype(np.float64) if self.bounded else np.zeros(plain.shape)
        self.plain, self.top, self.page, self.rng = plain, float(top) if self.bounded else 0.0, page, np.random.default_rng(seed)
        self.x = np.concatenate([x, np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))[:, None]], axis=1)
        self.computed = 0
        self.root = self._build(np.arange(len(x)), None) if len(x) else None

    def _distances(self, point: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - point
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> dict:
        if len(rows) <= self.page:
            return {"rows": rows, "to_parent": self._distances(parent, rows) if parent is not None else np.zeros(len(rows))}
        fan = min(32, -(-len(rows) // self.page) + 1)
        pivots = [int(rows[self.rng.integers(len(rows))])]
        near = self._distances(self.x[pivots[0]], rows)
        owner = np.zeros(len(rows), np.int64)
        while len(pivots) < fan and near.max() > 0:
            pivots.append(int(rows[near.argmax()]))
            d = self._distances(self.x[pivots[-1]], rows)
            closer = d < near
            owner[closer], near = len(pivots) - 1, np.minimum(near, d)
        if len(pivots) == 1:  # all alike: chunks of equal points
            owner = np.arange(len(rows)) // self.page
            pivots = [pivots[0]] * int(owner.max() + 1)
        children, radii, to_parent, points = [], [], [], []
        for k, p in enumerate(pivots):
            own = rows[owner == k]
            if not len(own):
                continue
            point = self.x[p]
            points.append(point)
            radii.append(float(self._distances(point, own).max()))
            to_parent.append(float(np.sqrt(((point - parent) ** 2).sum())) if parent is not None else 0.0)
            children.append(self._build(own, point))
        return {"points": np.array(points), "radii": np.array(radii), "to_parent": np.array(to_parent), "children": children}

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """The k best (score, -id) of each query, best first; `own` are the queries' ids, `ids` those of the rows."""
        m = len(queries)
        q = np.concatenate([queries.astype(np.float64) if self.bounded else np.zeros(queries.shape), np.zeros((m, 1))], axis=1)
        base = (q * q).sum(1) + self.top
        slack = SLACK * (1 + np.sqrt(base))
        best: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        limit = np.full(m, np.inf)
        full = np.zeros(m, bool)
        kth, kth_id = np.zeros(m, self.plain.dtype), np.zeros(m, np.int64)

        def settle(i: int) -> None:
            if len(best[i]) == k:
                full[i], kth[i], kth_id[i] = True, best[i][0][0], -best[i][0][1]
                if self.bounded:
                    limit[i] = np.sqrt(max(0.0, base[i] - 2.0 * float(best[i][0][0]))) + slack[i]

        def read(node: dict, who: np.ndarray, at_parent: np.ndarray | None) -> None:
            rows = node["rows"]
            if at_parent is not None:
                near = np.abs(node["to_parent"][None, :] - at_parent[:, None]) <= limit[who][:, None]
                rows, who = rows[near.any(0)], who[near.any(1)]
            if not len(rows) or not len(who):
                return
            self.computed += len(rows) * len(who)
            scores = queries[who] @ self.plain[rows].T
            names = ids[rows]
            bar = kth[who][:, None]
            better = (scores > bar) | ((scores == bar) & (names[None, :] < kth_id[who][:, None]))
            better = (better | ~full[who][:, None]) & (names[None, :] != own[who][:, None])
            a, b = better.nonzero()
            cuts = np.flatnonzero(np.diff(a)) + 1
            for i, cols in zip(a[np.append(0, cuts)] if len(a) else [], np.split(b, cuts), strict=False):
                mine = best[who[i]]
                order = cols[np.lexsort((names[cols], -scores[i, cols]))[:k]] if len(cols) > 4 and scores.dtype != object else cols
                for item in zip(scores[i, order].tolist(), (-names[order]).tolist(), strict=True):
                    if len(mine) < k:
                        heapq.heappush(mine, item)
                    elif item > mine[0]:
                        heapq.heapreplace(mine, item)
                settle(who[i])

        queue: list = [(0.0, 0, self.root, np.arange(m), np.zeros(m), None)] if self.root is not None and m else []
        n = 0
        while queue:
            least, _, node, who, low, at_parent = heapq.heappop(queue)
            if least > limit.max():
                break
            keep = low <= limit[who]
            who, at_parent = who[keep], at_parent[keep] if at_parent is not None else None
            if not len(who):
                continue
            if "rows" in node:
                read(node, who, at_parent)
                continue
            need = np.ones((len(who), len(node["children"])), bool)
            if at_parent is not None:
                need = np.abs(node["to_parent"][None, :] - at_parent[:, None]) - node["radii"][None, :] <= limit[who][:, None]
            cols = np.flatnonzero(need.any(0))
            self.computed += len(cols) * len(who)
            d = np.sqrt(np.maximum(0, base[who][:, None] - 2 * (q[who] @ node["points"][cols].T)))
            for c, dist in zip(cols.tolist(), d.T, strict=True):
                under = np.maximum(0, dist - node["radii"][c] - slack[who])
                go = need[:, c] & (under <= limit[who])
                if go.any():
                    n += 1
                    heapq.heappush(queue, (float(under[go].min()), n, node["children"][c], who[go], under[go], dist[go]))
        return [sorted(b, reverse=True) for b in best]


def _exact(x: np.ndarray, top: float) -> np.ndarray:
    """Whole vectors in a type in which their inner products are exact."""
    if top < 2**52:
        return x
    return x.astype(np.int64) if top < 2**61 else np.array([[int(c) for c in r] for r in x.tolist()], object).reshape(x.shape)


def _cell(k: int):
    def run(t: pa.Table) -> pa.Table | None:
        ids, role = t.column("id").to_numpy(), t.column("query").to_numpy(zero_copy_only=False)
        top = t.column("top")[0].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x = _exact(x, top)
        tree, names, asked = MTree(x[~role], top), ids[~role], np.flatnonzero(role)
        out = [
            (q, -neg, max(-LONG - 1, min(LONG, int(s))))
            for at in range(0, len(asked), SLICE)
            for q, found in zip(ids[asked[at : at + SLICE]].tolist(), tree.search(x[asked[at : at + SLICE]], ids[asked[at : at + SLICE]], names, k), strict=True)
            for s, neg in found
        ]
        if not out:
            return None
        a, b, c = zip(*out, strict=True)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    return run


def _floor(c: Column) -> Column:
    """As a double; large doubles are whole and may be beyond a long."""
    return F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)


def top_inner_products(vectors: DataFrame, is_query: str, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the k highest integer inner products of each query row."""
    v = F.transform(F.col(vector), lambda c: _floor(c.cast("double") * scale))
    whole = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(~F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = whole.select(F.col(key).cast("bigint").alias("id"), v.alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("query"), F.size(vector).alias("dim"))
    norm = F.aggregate(F.transform("v", lambda c: c * c), F.lit(0.0), lambda a, c: a + c)
    facts = checkpointed(whole.groupBy("dim").agg(F.count("*").alias("rows"), F.count_if("query").alias("asked"), F.max(norm).alias("top")))
    facts = facts.where("asked > 0").select("dim", "top", F.ceil(F.col("rows") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("blocks"))
    cells = facts.agg(F.sum(F.col("shards").cast("bigint") * F.col("blocks"))).first()[0] or 1
    dealt = whole.join(small(facts), "dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = dealt.select("id", "v", "top", "dim", F.lit(False).alias("query"), F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int").alias("shard"), every("blocks").alias("block"))
    asked = dealt.where("query").select("id", "v", "top", "dim", F.lit(True).alias("query"), every("shards").alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.col("blocks")).cast("int").alias("block"))
    found = grouped(data.unionByName(asked), ["dim", "shard", "block"], [], _cell(k), "query_id bigint, vec_id bigint, score bigint", min(cells, MAX_TASKS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # Spark limits each task's groups to k before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
