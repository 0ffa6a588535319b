"""Relational graph convolution for edge classification: dense training inside grouped workers.

Features, splits, masks and adjacency are DataFrames. `fit_modes` trains each (mode, seed) in one group, for graphs that
fit in a worker. `fit_groups` trains on whole graphs of any size whose rows meet in groups and at hubs: every step sums the
gradients of distributed blocks. Predictions pass messages over the whole graph, which stays distributed.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import graph as G
from chronoweave.operators.graph import stable

MODES = ("typed", "single", "none")


class Adjacency:
    """A row-normalised sparse matrix; parallel entries of one pair count once."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, n: int):
        self.row, self.col, self.w, self.n = row, col, weight, n

    def dot(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        np.add.at(out, self.row, x[self.col] * self.w[:, None])
        return out

    def dot_t(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        np.add.at(out, self.col, x[self.row] * self.w[:, None])
        return out


def adjacency(edges: np.ndarray, n: int) -> Adjacency:
    """From rows (a, b): undirected, each pair once."""
    both = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0) if len(edges) else np.zeros((0, 2), np.int64)
    deg = np.bincount(both[:, 0], minlength=n)
    return Adjacency(both[:, 0], both[:, 1], 1.0 / np.maximum(deg[both[:, 0]], 1), n)


def single(parts: list[Adjacency], n: int) -> Adjacency:
    """Relations added up, rows normalised again."""
    if not parts:
        return adjacency(np.zeros((0, 2), np.int64), n)
    key = np.concatenate([a.row * n + a.col for a in parts])
    w = np.concatenate([a.w for a in parts])
    pairs, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, w)
    row, col = pairs // n, pairs % n
    sums = np.bincount(row, total, minlength=n)
    return Adjacency(row, col, total / np.maximum(sums[row], 1e-12), n)


class RelationalNet:
    """Two layers H' = relu(H W0 + sum_r A_r H W_r), then a linear head on [h_s, h_o, h_s * h_o]."""

    def __init__(self, features: int, hidden: int, n_rel: int, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        g = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"a0": g(features, hidden), "b0": g(hidden, hidden), "head": g(3 * hidden, classes), "bias": np.zeros(classes)}
        self.n_rel = n_rel
        for r in range(n_rel):
            self.p |= {f"a{r + 1}": g(features, hidden), f"b{r + 1}": g(hidden, hidden)}

    def _layer(self, name: str, h: np.ndarray, adj: list[Adjacency]):
        spread = [a.dot(h) for a in adj]
        z = h @ self.p[f"{name}0"] + sum((s @ self.p[f"{name}{r + 1}"] for r, s in enumerate(spread)), 0.0)
        return np.maximum(z, 0), (h, spread, z)

    def forward(self, x: np.ndarray, adj: list[Adjacency], pairs: np.ndarray):
        h1, k1 = self._layer("a", x, adj)
        h2, k2 = self._layer("b", h1, adj)
        s, o = h2[pairs[:, 0]], h2[pairs[:, 1]]
        f = np.concatenate([s, o, s * o], axis=1)
        return f @ self.p["head"] + self.p["bias"], (k1, k2, h2, f, s, o)

    def _back(self, name: str, d: np.ndarray, kept, adj: list[Adjacency], grads: dict) -> np.ndarray:
        h, spread, z = kept
        d = d * (z > 0)
        grads[f"{name}0"] = h.T @ d
        out = d @ self.p[f"{name}0"].T
        for r, (a, s) in enumerate(zip(adj, spread, strict=True)):
            grads[f"{name}{r + 1}"] = s.T @ d
            out += a.dot_t(d @ self.p[f"{name}{r + 1}"].T)
        return out

    def loss_and_grads(self, x: np.ndarray, adj: list[Adjacency], pairs: np.ndarray, y: np.ndarray):
        logits, (k1, k2, h2, f, s, o) = self.forward(x, adj, pairs)
        e = np.exp(logits - logits.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        rows = np.arange(len(y))
        loss = -np.log(p[rows, y] + 1e-12).mean()
        d = p.copy()
        d[rows, y] -= 1
        d /= len(y)
        grads = {"head": f.T @ d, "bias": d.sum(0)}
        df, w = d @ self.p["head"].T, h2.shape[1]
        dh = np.zeros_like(h2)
        np.add.at(dh, pairs[:, 0], df[:, :w] + df[:, 2 * w :] * o)
        np.add.at(dh, pairs[:, 1], df[:, w : 2 * w] + df[:, 2 * w :] * s)
        self._back("a", self._back("b", dh, k2, adj, grads), k1, adj, grads)
        return loss, grads

    def fit(self, x, adj, pairs, y, epochs: int, rate: float) -> float:
        loss = 0.0
        for _ in range(epochs):
            loss, grads = self.loss_and_grads(x, adj, pairs, y)
            for k, g in grads.items():
                self.p[k] -= rate * g
        return float(loss)


def gradient_error(mode: str, seed: int = 0) -> float:
    """Largest relative difference between analytic and numeric gradients on a small graph."""
    rng = np.random.default_rng(seed)
    n, x = 7, rng.normal(size=(7, 5))
    parts = [adjacency(rng.integers(0, n, (6, 2)), n) for _ in range(2)]
    adj = parts if mode == "typed" else [single(parts, n)] if mode == "single" else []
    pairs, y = rng.integers(0, n, (9, 2)), rng.integers(0, 3, 9)
    net = RelationalNet(5, 4, len(adj), 3, seed)
    _, grads = net.loss_and_grads(x, adj, pairs, y)
    worst = 0.0
    for k, g in grads.items():
        flat = net.p[k].reshape(-1)
        for i in range(0, len(flat), 3):
            keep, step = flat[i], 1e-6
            flat[i] = keep + step
            up = net.loss_and_grads(x, adj, pairs, y)[0]
            flat[i] = keep - step
            down = net.loss_and_grads(x, adj, pairs, y)[0]
            flat[i] = keep
            num = (up - down) / (2 * step)
            worst = max(worst, abs(num - g.reshape(-1)[i]) / max(1e-4, abs(num) + abs(g.reshape(-1)[i])))
    return worst


def _between(edges: DataFrame, features: DataFrame) -> DataFrame:
    """The edges whose ends both have features."""
    known = features.select("node").distinct()
    return edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")


def fit_modes(edges: DataFrame, features: DataFrame, samples: DataFrame, n_features: int, classes: list[str], modes: tuple[str, ...], seeds: int, epochs: int, rate: float, hidden: int) -> DataFrame:
    """Rows (mode, seed, relations, weights): one model for each mode and seed, fitted on the training samples.

    The whole graph meets in each (mode, seed) group, so the caller bounds it.
    """
    spark = edges.sparkSession
    grid = spark.createDataFrame([(m, s) for m in modes for s in range(seeds)], "mode string, seed int")
    none = lambda t: F.lit(None).cast(t)
    parts = [
        edges.select(F.lit("edge").alias("what"), F.col("rel").alias("name"), "src", "dst", none("array<double>").alias("values")),
        features.select(F.lit("node"), none("string"), F.col("node"), none("bigint"), F.col("values")),
        samples.where("split = 'train'").select(F.lit("sample"), F.col("label"), "src", "dst", none("array<double>")),
    ]
    data = parts[0].unionAll(parts[1]).unionAll(parts[2]).crossJoin(F.broadcast(grid))  # as many copies as models
    known = {c: i for i, c in enumerate(classes)}

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        mode, seed = key
        t = t.sort_values(["what", "name", "src", "dst"], kind="stable")
        nodes = t[t.what == "node"]
        at = {n: i for i, n in enumerate(nodes.src)}
        x = np.stack(nodes["values"].to_list()) if len(nodes) else np.zeros((0, n_features))
        e = t[(t.what == "edge") & t.src.isin(at) & t.dst.isin(at)]
        named = [(name, adjacency(np.array([[at[a], at[b]] for a, b in zip(g.src, g.dst, strict=True)]), len(at))) for name, g in e.groupby("name", sort=True)]
        rels = [a for _, a in named]
        adj = rels if mode == "typed" else [single(rels, len(at))] if mode == "single" else []
        s = t[(t.what == "sample") & t.src.isin(at) & t.dst.isin(at)]
        if not len(s):
            return pd.DataFrame({"mode": [], "seed": [], "relations": [], "weights": []})
        pairs = np.array([[at[a], at[b]] for a, b in zip(s.src, s.dst, strict=True)])
        net = RelationalNet(x.shape[1], hidden, len(adj), len(classes), int(seed))
        net.fit(x, adj, pairs, s["name"].map(known).to_numpy(), epochs, rate)
        file = io.BytesIO()
        np.savez(file, **net.p)
        names = [name for name, _ in named] if mode == "typed" else ["single"] if mode == "single" else []
        return pd.DataFrame({"mode": [mode], "seed": [seed], "relations": [names], "weights": [file.getvalue()]})

    return data.groupBy("mode", "seed").applyInPandas(run, "mode string, seed int, relations array<string>, weights binary")


def _layer(h: DataFrame, adj: DataFrame, layer: str, nets: list[dict], relations: list[str], shared: bool) -> DataFrame:
    """Rows (node, h) after a layer of all nets side by side: each node's own part, and what its neighbours send by relation.

    Products with the weights are taken at the sender, so a receiver adds up vectors of one width for all relations.
    """
    n = len(nets)
    width = n * nets[0][f"{layer}0"].shape[1]

    def project(batches):
        for t in batches:
            x = np.stack(t["h"].to_list()) if len(t) else np.zeros((0, 0))
            if not len(t):
                continue
            own = [x] * n if shared else np.split(x, n, axis=1)
            out = [np.concatenate([v @ net[f"{layer}{r}"] for v, net in zip(own, nets, strict=True)], axis=1) for r in range(len(relations) + 1)]
            yield pd.DataFrame({"node": t["node"].to_numpy(), "own": list(out[0]), "sent": [[o[i] for o in out[1:]] for i in range(len(t))]})

    sent = h.mapInPandas(project, "node bigint, own array<double>, sent array<array<double>>")
    relu = lambda v: F.greatest(v, F.lit(0.0))
    if not relations:
        return sent.select("node", F.transform("own", relu).alias("h"))
    sent = stable(sent)
    place = F.array_position(F.array(*map(F.lit, relations)), F.col("rel")).cast("int")
    got = adj.join(sent.select(F.col("node").alias("col"), "sent"), "col").select("row", "weight", F.element_at("sent", place).alias("v"))
    sums = got.groupBy(F.col("row").alias("node")).agg(*[F.sum(F.col("weight") * F.col("v")[i]).alias(f"_{i}") for i in range(width)])
    z = F.array(*[F.col("own")[i] + F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(width)])
    return sent.select("node", "own").join(sums, "node", "left").select("node", F.transform(z, relu).alias("h"))


def predict_modes(models: DataFrame, edges: DataFrame, features: DataFrame, samples: DataFrame, classes: list[str]) -> DataFrame:
    """Rows (mode, seed, row, split, truth, pred): every sample by every model, with messages over all edges.

    The graph stays distributed; only the weights, whose size does not depend on it, reach the driver.
    """
    spark = edges.sparkSession
    found = models.collect()  # one row for each mode and seed
    out = spark.createDataFrame([], "mode string, seed int, row bigint, split string, truth string, pred string")
    if not found:
        return out
    typed = stable(G.adjacency(_between(edges, features), "rel", "src", "dst"))
    for mode in sorted({m["mode"] for m in found}):
        mine = sorted((m for m in found if m["mode"] == mode), key=lambda m: m["seed"])
        seeds, relations = [m["seed"] for m in mine], list(mine[0]["relations"])
        nets = [dict(np.load(io.BytesIO(m["weights"]))) for m in mine]
        adj = typed.where(F.col("rel").isin(*relations)) if mode == "typed" else G.adjacency_single(typed).withColumn("rel", F.lit("single"))
        h = features.select("node", F.col("values").alias("h"))
        h = stable(_layer(_layer(h, adj, "a", nets, relations, True), adj, "b", nets, relations, False))
        ends = samples.join(h.select(F.col("node").alias("src"), F.col("h").alias("hs")), "src").join(h.select(F.col("node").alias("dst"), F.col("h").alias("ho")), "dst").select("row", "split", "label", "hs", "ho")

        def judge(batches, mode=mode, seeds=seeds, nets=nets):
            for t in batches:
                if not len(t):
                    continue
                s, o = np.stack(t["hs"].to_list()), np.stack(t["ho"].to_list())
                for seed, net, a, b in zip(seeds, nets, np.split(s, len(nets), axis=1), np.split(o, len(nets), axis=1), strict=True):
                    best = (np.concatenate([a, b, a * b], axis=1) @ net["head"] + net["bias"]).argmax(1)
                    yield pd.DataFrame({"mode": mode, "seed": seed, "row": t["row"], "split": t["split"], "truth": t["label"], "pred": [classes[i] for i in best]})

        out = out.unionByName(ends.mapInPandas(judge, out.schema))
    return out


def train_modes(edges: DataFrame, features: DataFrame, samples: DataFrame, n_features: int, classes: list[str], modes: tuple[str, ...] = MODES, seeds: int = 3, epochs: int = 150, rate: float = 0.1, hidden: int = 16, fit: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows (mode, seed, row, split, truth, pred): predictions of every sample by every model.

    `edges` (rel, src, dst) is the graph that may be seen, without the samples' own edges; `features` (node, values);
    `samples` (row, src, dst, label, split). The models are fitted on `fit`, a part of these three that the caller bounds
    (all of it where none is given), and predict over the whole graph.
    """
    models = fit_modes(*(fit or (edges, features, samples)), n_features, classes, modes, seeds, epochs, rate, hidden)
    return predict_modes(models, edges, features, samples, classes)


def _by_place(at: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place."""
    return np.stack([np.bincount(at, c, n) for c in np.ascontiguousarray(d.T)], axis=1)


class Groups:
    """Rows of whole groups with their links: to hubs, by one column of numbers each (-1: none), and within the group, by rules (a, b) on flags.

    Messages are means over the neighbours by relation; of the rows, each hub sends one vector.
    """

    def __init__(self, group: np.ndarray, flag: np.ndarray, hubs: dict[str, np.ndarray], rules: dict[str, tuple[int, int]]):
        self.start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.at = np.repeat(np.arange(len(self.start)), np.diff(np.r_[self.start, len(group)]))
        self.flag, self.hubs, self.rules = flag, hubs, rules
        self.size = {f: np.add.reduceat((flag == f).astype(np.int64), self.start)[self.at] for rule in rules.values() for f in rule}
        self.linked = {r: h >= 0 for r, h in hubs.items()} | {r: ((flag == a) & (self.size[b] > 0)) | ((flag == b) & (self.size[a] > 0)) for r, (a, b) in rules.items()}

    def mean(self, relation: str, x: np.ndarray, sent: dict[str, np.ndarray]) -> np.ndarray:
        """What the neighbours in a relation send to each row: `x` are the rows' vectors, `sent` those of the hubs."""
        if relation in self.hubs:
            return np.concatenate([sent[relation], np.zeros((1, sent[relation].shape[1]))])[self.hubs[relation]]  # the last row is of no hub
        out = np.zeros_like(x)
        a, b = self.rules[relation]
        for mine, theirs in ((a, b), (b, a)):
            total = np.add.reduceat(x * (self.flag == theirs)[:, None], self.start)[self.at]
            out += np.where((self.flag == mine)[:, None], total / np.maximum(self.size[theirs], 1)[:, None], 0.0)
        return out

    def spread(self, mode: str, relations: list[str], x: np.ndarray, sent: dict[str, np.ndarray], net: dict[str, np.ndarray], layer: str) -> np.ndarray:
        """What a layer's relations add to each row: with `single`, the mean over the relations in which a row has neighbours.

        Means are linear, so products with the weights are taken at the sender: of a hub, once.
        """
        if mode == "none":
            return np.zeros((len(x), net[f"{layer}0"].shape[1]))
        add = lambda r, w: self.mean(r, x @ w if r in self.rules else None, {r: sent[r] @ w} if r in self.hubs else {})
        if mode == "typed":
            return sum((add(r, net[f"{layer}{i + 1}"]) for i, r in enumerate(relations)), 0.0)
        n = sum(v.astype(np.int64) for v in self.linked.values())
        return sum(add(r, net[f"{layer}1"]) for r in self.linked) / np.maximum(n, 1)[:, None]

    def embed(self, net: dict[str, np.ndarray], mode: str, relations: list[str], x: np.ndarray, hub_x: np.ndarray, hub_means: dict[str, np.ndarray]) -> np.ndarray:
        """The rows' vectors after both layers. Hubs all have the features `hub_x`; `hub_means` are the means of their rows'."""
        weight = lambda r: {"typed": lambda: net.get(f"a{relations.index(r) + 1}") if r in relations else None, "single": lambda: net["a1"], "none": lambda: None}[mode]()
        first = np.maximum(x @ net["a0"] + self.spread(mode, relations, x, {r: np.broadcast_to(hub_x, m.shape) for r, m in hub_means.items()}, net, "a"), 0)
        sent = {r: np.maximum(hub_x @ net["a0"] + (m @ weight(r) if weight(r) is not None else 0.0) + np.zeros((len(m), 1)), 0) for r, m in hub_means.items()}
        return np.maximum(first @ net["b0"] + self.spread(mode, relations, first, sent, net, "b"), 0)

    def pairs(self, rule: tuple[int, int]) -> np.ndarray:
        """Rows (i, j) of all links by a rule."""
        a, b = (np.flatnonzero(self.flag == f) for f in rule)
        low, high = (np.searchsorted(self.at[b], self.at[a], side=s) for s in ("left", "right"))
        n = high - low
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.stack([np.repeat(a, n), b[np.repeat(low, n) + inside]], axis=1)


def judge(net: dict[str, np.ndarray], h: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best class of each pair of rows."""
    first, second, both = np.split(net["head"], 3)
    i, j = pairs[:, 0], pairs[:, 1]
    return ((h @ first)[i] + (h @ second)[j] + (h[i] * h[j]) @ both + net["bias"]).argmax(1)


class Sorted:
    """Rows of whole groups sorted by group and flag, with the links of `Groups` and pairs of rows to be told apart.

    Rows of one group and flag send and get the same messages by rule, so these are computed once for each such run of rows.
    """

    def __init__(self, group: np.ndarray, flag: np.ndarray, hubs: dict[str, np.ndarray], rules: dict[str, tuple[int, int]], x: np.ndarray, pairs: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.x, self.pairs, self.y, self.weight = x, pairs, y, weight
        self.start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (flag[1:] != flag[:-1])])
        self.size = np.diff(np.r_[self.start, len(group)])
        self.run = np.repeat(np.arange(len(self.start)), self.size)
        n, kind = len(self.start), flag[self.start]
        _, of = np.unique(group[self.start], return_inverse=True)
        self.other = {}  # of each run, the run that a rule links it to; the last is none
        for r, rule in rules.items():
            self.other[r] = np.full(n, n)
            for mine, theirs in (rule, rule[::-1]):
                at = np.full(of.max() + 1, n)
                at[of[kind == theirs]] = np.flatnonzero(kind == theirs)
                self.other[r][kind == mine] = at[of[kind == mine]]
        self.has = {r: (h >= 0).astype(float)[:, None] for r, h in hubs.items()}
        self.hubs = {r: np.unique(h, return_inverse=True) for r, h in hubs.items()}  # -1 is none
        links = sum(self.has.values()) + sum((v < n).astype(float)[self.run, None] for v in self.other.values())
        self.share = 1.0 / np.maximum(links, 1.0)
        self.near = self.others(self.means(x))
        self.order = [np.argsort(c, kind="stable") for c in pairs.T]
        self.ends = []
        for c, order in zip(pairs.T, self.order, strict=True):
            row = c[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            self.ends.append((row[first], first))

    def means(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.start) / self.size[:, None]

    def others(self, v: np.ndarray) -> dict[str, np.ndarray]:
        """Of each relation by rule, what the runs get."""
        v = np.concatenate([v, np.zeros((1, v.shape[1]))])
        return {r: v[at] for r, at in self.other.items()}

    def at_ends(self, side: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are at a side of pairs, and the sums over their pairs."""
        row, first = self.ends[side]
        return row, np.add.reduceat(d[self.order[side]], first)


class Gradients:
    """The gradients of one net, summed up over blocks of whole groups. Hubs all have the features `hub_x`.

    A hub's first layer needs the mean of its rows only, which is known, so what comes back to hubs is taken to the weights
    in each task; gradients of tasks add up. Products with the weights are taken at the sender, as in `Groups.spread`.
    """

    def __init__(self, net: dict[str, np.ndarray], mode: str, relations: list[str], hub_x: np.ndarray, means: dict[str, np.ndarray]):
        self.net, self.mode, self.hub_x, self.means = net, mode, hub_x, means
        self.place = {} if mode == "none" else {r: i + 1 if mode == "typed" else 1 for i, r in enumerate(relations)}
        self.hubs, self.rules = [r for r in self.place if r in means], [r for r in self.place if r not in means]
        self.sent = {r: np.maximum(hub_x @ net["a0"] + means[r] @ self.weight("a", r), 0) for r in self.hubs}
        self.given = {r: np.concatenate([np.zeros((1, v.shape[1])), v @ self.weight("b", r)]) for r, v in self.sent.items()}  # first to rows without a hub
        self.back = {r: np.zeros_like(v) for r, v in self.given.items()}
        self.sums = {k: np.zeros_like(v) for k, v in net.items()}

    def weight(self, layer: str, relation: str) -> np.ndarray:
        return self.net[f"{layer}{self.place[relation]}"]

    def _layer(self, t: Sorted, layer: str, v: np.ndarray, near: dict[str, np.ndarray], from_hubs: list[np.ndarray]) -> np.ndarray:
        z = v @ self.net[f"{layer}0"]
        if self.place:
            add = sum((near[r] @ self.weight(layer, r) for r in self.rules), np.zeros((len(t.start), z.shape[1])))[t.run]
            for one in from_hubs:
                add += one
            z += add * t.share if self.mode == "single" else add
        return np.maximum(z, 0)

    def add(self, t: Sorted) -> None:
        net, sums = self.net, self.sums
        h1 = self._layer(t, "a", t.x, t.near, [t.has[r] * (self.hub_x @ self.weight("a", r)) for r in self.hubs])
        near = t.others(t.means(h1)) if self.rules else {}
        h2 = self._layer(t, "b", h1, near, [self.given[r][t.hubs[r][0] + 1][t.hubs[r][1]] for r in self.hubs])
        one, two, both = np.split(net["head"], 3)
        i, j = t.pairs.T
        s, o = h2[i], h2[j]
        so = s * o
        logits = (h2 @ one)[i] + (h2 @ two)[j] + so @ both + net["bias"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(len(t.y)), t.y] -= 1
        d *= t.weight[:, None]
        sums["bias"] += d.sum(0)
        sums["head"][2 * len(both) :] += so.T @ d
        back, dh2 = d @ both.T, np.zeros_like(h2)
        for side, (head, other) in enumerate(((one, o), (two, s))):
            row, v = t.at_ends(side, np.concatenate([back * other, d], axis=1))
            dh2[row] += v[:, : h2.shape[1]] + v[:, h2.shape[1] :] @ head.T
            sums["head"][side * len(both) : (side + 1) * len(both)] += h2[row].T @ v[:, h2.shape[1] :]
        dh2 *= h2 > 0
        sums["b0"] += h1.T @ dh2
        dh1 = dh2 @ net["b0"].T
        if self.place:
            got = dh2 * t.share if self.mode == "single" else dh2
            for r in self.hubs:
                hub, at = t.hubs[r]
                self.back[r][hub + 1] += _by_place(at, got, len(hub))
            if self.rules:
                runs = np.add.reduceat(got, t.start)
                turned = t.others(runs)  # links go both ways, so what comes back takes the same way
                for r in self.rules:
                    sums[f"b{self.place[r]}"] += near[r].T @ runs
                dh1 += (sum(turned[r] @ self.weight("b", r).T for r in self.rules) / t.size[:, None])[t.run]
        dh1 *= h1 > 0
        sums["a0"] += t.x.T @ dh1
        if self.place:
            got = dh1 * t.share if self.mode == "single" else dh1
            runs = np.add.reduceat(got, t.start)
            for r in self.rules:
                sums[f"a{self.place[r]}"] += t.near[r].T @ runs
            for r in self.hubs:
                sums[f"a{self.place[r]}"] += np.outer(self.hub_x, (t.has[r] * got).sum(0))

    def total(self) -> dict[str, np.ndarray]:
        for r, v in self.back.items():
            v = v[1:]
            self.sums[f"b{self.place[r]}"] += self.sent[r].T @ v
            v = (v @ self.weight("b", r).T) * (self.sent[r] > 0)
            self.sums["a0"] += np.outer(self.hub_x, v.sum(0))
            self.sums[f"a{self.place[r]}"] += self.means[r].T @ v
        return self.sums


def fit_groups(blocks: DataFrame, read: Callable, relations: list[str], hub_x: np.ndarray, means: dict[str, np.ndarray], classes: int, modes: tuple[str, ...], seeds: int, epochs: int, rate: float, hidden: int) -> DataFrame:
    """What `fit_modes` gives, fitted on all rows of `blocks`, which stay distributed; each step is a pass over them.

    `read` makes of an iterator of batches one of `Sorted`, each with pairs; their weights sum up to 1 over all. Only weights and their gradients, whose size does not depend on the rows, meet in the driver.
    """
    spark = blocks.sparkSession
    means = {r: v for r, v in means.items() if r in relations}
    grid = [(m, s) for m in modes for s in range(seeds)]
    nets = [RelationalNet(len(hub_x), hidden, {"typed": len(relations), "single": 1, "none": 0}[m], classes, s).p for m, s in grid]
    held = spark.sparkContext.broadcast(means)
    for _ in range(epochs):

        def run(batches, nets=nets):
            at = [Gradients(net, m, relations, hub_x, held.value) for (m, _), net in zip(grid, nets, strict=True)]
            for t in read(batches):
                for one in at:
                    one.add(t)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([v.ravel() for one in at for v in one.total().values()]).tobytes()], pa.binary())], ["grads"])

        got = sum(np.frombuffer(r.grads) for r in blocks.mapInArrow(run, "grads binary").collect())  # one row a task
        step, nets = 0, [dict(net) for net in nets]
        for net in nets:
            for k, v in net.items():
                net[k] = v - rate * got[step : step + v.size].reshape(v.shape)
                step += v.size
    held.destroy()
    rows = []
    for (m, s), net in zip(grid, nets, strict=True):
        file = io.BytesIO()
        np.savez(file, **net)
        rows.append((m, s, {"typed": relations, "single": ["single"], "none": []}[m], file.getvalue()))
    return spark.createDataFrame(rows, "mode string, seed int, relations array<string>, weights binary")
