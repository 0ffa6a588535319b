"""Neighbourhoods that count what lies at large attributes, held against a plain walk over all edges."""

import io
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import aggregates as A
from chronoweave.operators import graph as G
from chronoweave.operators import learn as L
from chronoweave.operators import walks as W
from chronoweave.plans import catalogue, graph, learning
from chronoweave.plans import packed as P
from chronoweave.plans.bindings import order_mentions
from tests.oracle import compare, connect


def _walk(ends, seed, tau, ok):
    nodes, edges, front = {seed}, set(), {seed}
    for _ in range(2):
        new = set()
        for u in front:
            for v, edge, happened, known in ends[u]:
                if ok(happened, known, tau):
                    edges.add(edge)
                    new.add(v)
        front = new - nodes
        nodes |= new
    return nodes, edges


@pytest.mark.parametrize("moves", [0, 1])
def test_khop_equals_a_plain_walk(spark, small, moves):
    """With `moves`, an actor has several locations."""
    t = order_mentions(spark, small).where("article % 10 = 1").withColumn("location", F.col("location") + F.col("article") % 3 * moves)
    ends = defaultdict(list)
    for i, e in enumerate(graph._edges(t).collect()):
        if e.event_time is not None and e.available_date is not None:
            a, b = f"{e.src_type}:{e.src_id}", f"{e.dst_type}:{e.dst_id}"
            ends[a].append((b, i, e.event_time, e.available_date))
            ends[b].append((a, i, e.event_time, e.available_date))
    taus = {f"event:{r.mention}": r.report_time for r in t.collect()}
    got = {r.seed: r for r in graph.khop(t).collect()}
    assert len(got) == len(taus) > 300
    for seed, tau in taus.items():
        all_n, all_e = _walk(ends, seed, tau, lambda h, k, at: True)
        evt_n, evt_e = _walk(ends, seed, tau, lambda h, k, at: h <= at)
        rep_n, rep_e = _walk(ends, seed, tau, lambda h, k, at: k <= at)
        want = (len(all_n), len(evt_n), len(rep_n), len(all_e), len(evt_e), len(rep_e), len(all_e - rep_e), len(evt_e - rep_e), len(evt_n - rep_n), 0)
        assert tuple(got[seed])[1:] == want, seed


def test_khop_without_rows(spark, small):
    assert graph.khop(order_mentions(spark, small).where("false")).count() == 0


def test_khop_with_gaps_over_ranges_of_days(spark, small, monkeypatch):
    """Hubs and times may lack; ranges of days, and sets of hubs in place of them, give what a plain walk does."""
    monkeypatch.setattr(graph, "ARTICLES", 30)
    c = F.col
    t = order_mentions(spark, small).where("article % 11 = 1").withColumns({"commodity": F.when(c("mention") % 3 > 0, c("commodity")).otherwise(" "), "publisher": F.when(c("mention") % 5 > 0, c("publisher")), "event_time": F.when(c("mention") % 7 > 0, c("event_time"))})
    ends = defaultdict(list)
    for i, e in enumerate(graph._edges(t).where("event_time is not null and available_date is not null").collect()):
        a, b = f"{e.src_type}:{e.src_id}", f"{e.dst_type}:{e.dst_id}"
        ends[a].append((b, i, e.event_time, e.available_date))
        ends[b].append((a, i, e.event_time, e.available_date))
    taus = {f"event:{r.mention}": r.report_time for r in t.where("event_time is not null").collect()}
    got = {r.seed: tuple(r) for r in graph.khop(t).collect()}
    assert len(got) == len(taus) > 200
    for seed, tau in taus.items():
        all_n, all_e = _walk(ends, seed, tau, lambda h, k, at: True)
        evt_n, evt_e = _walk(ends, seed, tau, lambda h, k, at: h <= at)
        rep_n, rep_e = _walk(ends, seed, tau, lambda h, k, at: k <= at)
        want = (len(all_n), len(evt_n), len(rep_n), len(all_e), len(evt_e), len(rep_e), len(all_e - rep_e), len(evt_e - rep_e), len(evt_n - rep_n), 0)
        assert got[seed][1:] == want, seed
    monkeypatch.setattr(graph, "CELLS", 0)
    assert {r.seed: tuple(r) for r in graph.khop(t).collect()} == got


def test_khop_keeps_no_row_for_an_edge(spark, small, monkeypatch):
    kept, real = [], G.stable

    def counted(df):
        out = real(df)
        kept.append(out.count())
        return out

    for module in (G, W):
        monkeypatch.setattr(module, "stable", counted)
    n = order_mentions(spark, small).count()
    assert graph.khop(order_mentions(spark, small)).count() == n
    assert sum(kept) < n


def test_distributed_predictions_equal_the_local_net(spark):
    rng = np.random.default_rng(3)
    n = 12
    e = {r: rng.integers(0, n, (14, 2)) for r in ("p", "q")}
    x, pairs = rng.normal(size=(n, 4)), rng.integers(0, n, (20, 2))
    edges = spark.createDataFrame([(r, int(a), int(b)) for r, es in e.items() for a, b in es], "rel string, src bigint, dst bigint")
    features = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "node bigint, values array<double>")
    samples = spark.createDataFrame([(i, int(a), int(b), "ab"[i % 2], "train" if i < 15 else "test") for i, (a, b) in enumerate(pairs)], "row bigint, src bigint, dst bigint, label string, split string")
    got = {(r["mode"], r["seed"], r["row"]): r["pred"] for r in L.train_modes(edges, features, samples, 4, ["a", "b"], seeds=2, epochs=40).collect()}
    parts = [L.adjacency(e[r], n) for r in ("p", "q")]
    for mode, adj in {"typed": parts, "single": [L.single(parts, n)], "none": []}.items():
        for seed in range(2):
            net = L.RelationalNet(4, 16, len(adj), 2, seed)
            order = sorted(range(15), key=lambda i: ("ab"[i % 2], *pairs[i]))
            net.fit(x, adj, pairs[order], np.array([i % 2 for i in order]), 40, 0.1)
            want = net.forward(x, adj, pairs)[0].argmax(1)
            assert [got[mode, seed, i] for i in range(20)] == ["ab"[k] for k in want]


@pytest.mark.parametrize("mask", [True, False])
def test_predictions_by_order_equal_those_over_the_whole_graph(spark, small, mask):
    """Few epochs, so that there are errors to compare."""
    edges, features, samples = learning.graph(spark, small, mask_targets=mask)
    few = learning.part(edges, features, samples)
    modes = L.MODES if mask else ("typed",)
    models = L.fit_modes(*few, 5, learning.CLASSES, modes, seeds=2, epochs=4, rate=0.05, hidden=16).cache()
    want = L.predict_modes(models, edges, features, samples, learning.CLASSES).where("split = 'test'").groupBy("mode", "seed", "truth", "pred").count()
    data = learning.packed(order_mentions(spark, small, together=True))
    first, test = learning.bounds(data)
    assert {tuple(r) for r in learning.confusion(models, data, test, mask).collect()} == {tuple(r) for r in want.collect()}
    for got, old, keys in zip(learning.fitted_on(data, first, mask), few, (["rel", "src", "dst"], ["node", "values"], ["src", "dst", "label", "split"]), strict=True):
        assert sorted(tuple(r) for r in got.select(*keys).collect()) == sorted(tuple(r) for r in old.select(*keys).collect())


@pytest.mark.parametrize("mask", [True, False])
def test_fit_takes_all_training_samples(spark, small, mask):
    """As a fit in one worker on all edges and training samples, of which a part alone gives other weights."""
    modes = L.MODES if mask else ("typed",)
    data = learning.packed(order_mentions(spark, small, together=True))
    first, _ = learning.bounds(data)
    edges, features, samples = learning.graph(spark, small, mask_targets=mask)
    train = samples.where("split = 'train'")
    assert train.select(F.floor(F.col("src") / 16)).distinct().count() > 300
    want = L.fit_modes(edges, features, train, 5, learning.CLASSES, modes, seeds=2, epochs=5, rate=0.5, hidden=16)
    got = learning.fit(data, first, learning.hub_means(data), mask, modes, seeds=2, epochs=5, rate=0.5)
    got, want = ({(m["mode"], m["seed"]): (list(m["relations"]), dict(np.load(io.BytesIO(m["weights"])))) for m in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, (relations, weights) in want.items():
        assert got[k][0] == relations
        assert all(np.allclose(got[k][1][p], w, rtol=1e-9, atol=1e-12) for p, w in weights.items())


@pytest.mark.parametrize("mode", L.MODES)
def test_groups_give_the_vectors_of_the_whole_net(mode):
    """Eight rows in three groups, two hubs of one kind; a row without a hub, and one without any link."""
    rng = np.random.default_rng(5)
    group, flag, hub = np.array([0, 0, 0, 1, 1, 1, 1, 2]), np.array([1, 2, 3, 1, 1, 2, 0, 3]), np.array([0, 1, 1, 0, -1, 1, -1, -1])
    rules = {"p": (1, 2), "q": (2, 3)}
    g = L.Groups(group, flag, {"h": hub}, rules)
    x, hub_x = rng.normal(size=(8, 4)), rng.normal(size=4)
    edges = {"h": np.array([(i, 8 + h) for i, h in enumerate(hub) if h >= 0])} | {r: g.pairs(rule) for r, rule in rules.items()}
    parts = [L.adjacency(edges[r], 10) for r in ("h", "p", "q")]
    adj = {"typed": parts, "single": [L.single(parts, 10)], "none": []}[mode]
    net = L.RelationalNet(4, 3, len(adj), 2, 1)
    pairs = np.array([(0, 1), (5, 3), (7, 4)])
    logits, kept = net.forward(np.concatenate([x, [hub_x, hub_x]]), adj, pairs)
    means = {"h": np.stack([x[hub == k].mean(0) for k in range(2)])}
    h = g.embed(net.p, mode, ["h", "p", "q"] if mode == "typed" else [], x, hub_x, means)
    assert np.allclose(h, kept[2][:8])
    assert (L.judge(net.p, h, pairs) == logits.argmax(1)).all()


def test_khop_sizes_over_ranges_of_days(spark, small, monkeypatch):
    """Equal to the SQL, without a row kept for an edge or for a value of a measure."""
    kept, real = [], G.stable

    def counted(df):
        out = real(df)
        kept.append(out.count())
        return out

    for module in (G, W, A):
        monkeypatch.setattr(module, "stable", counted)
    monkeypatch.setattr(graph, "ARTICLES", 300)
    compare(graph.khop_sizes(spark, small), catalogue.ORACLE["khop_sizes"], small)
    assert 0 < sum(kept) < order_mentions(spark, small).count()


def _odd(folder, small, gap=7):
    """Tables with missing dates (every `gap`th) and keys, other flags, orders and suppliers that no line has or that are lacking."""
    c = connect(small)
    c.execute(f"""COPY (SELECT * REPLACE (CASE WHEN i % {gap} > 0 THEN l_shipdate END AS l_shipdate, CASE WHEN i % 11 > 0 THEN l_suppkey END AS l_suppkey, CASE WHEN i % 13 > 0 THEN l_orderkey END AS l_orderkey,
      CASE WHEN i % 5 > 0 THEN l_returnflag WHEN i % 2 = 0 THEN 'B' WHEN i % 3 = 0 THEN 'a' END AS l_returnflag) FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey, l_partkey, l_returnflag, row_number() OVER () AS i FROM lineitem))
      TO '{folder}/lineitem.parquet'""")
    for name, rows in {"orders": "o_orderkey % 9 > 0", "supplier": "s_suppkey % 6 > 0", "part": "p_partkey % 8 > 0"}.items():
        c.execute(f"COPY (SELECT * FROM {name} WHERE {rows}) TO '{folder}/{name}.parquet'")
    return str(folder)


def test_khop_sizes_exchanges_no_row_of_a_line(spark, small, tmp_path, monkeypatch):
    """Lines meet by order as packed columns, in several parts, on odd tables as well."""
    plans, real = [], G.stable

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    for module in (G, W, A):
        monkeypatch.setattr(module, "stable", seen)
    d = _odd(tmp_path, small, gap=10**9)
    monkeypatch.setattr(graph, "ARTICLES", 300)
    monkeypatch.setattr(P, "LINES", 900)
    monkeypatch.setattr(P, "BLOCK", 16)
    compare(graph.khop_sizes(spark, d), catalogue.ORACLE["khop_sizes"], d)
    assert plans and not any("hashpartitioning(l_orderkey" in p or "hashpartitioning(article" in p for p in plans)
    _odd(tmp_path, small)  # the SQL counts events without a time
    got = sorted(graph.khop_sizes(spark, d).collect())
    monkeypatch.setattr(P, "in_parts", lambda *_: None)
    assert got == sorted(graph.khop_sizes(spark, d).collect())


def test_packed_mentions_equal_those_of_the_joins(spark, small, tmp_path):
    d = _odd(tmp_path, small)
    c = connect(d)  # and twice the same order, supplier and part
    for name, rows in {"orders": "o_orderkey % 50 = 1", "supplier": "s_suppkey = 7", "part": "p_partkey % 10 = 5"}.items():
        c.execute(f"CREATE TABLE t_{name} AS SELECT * FROM {name} UNION ALL SELECT * FROM {name} WHERE {rows}")
        c.execute(f"COPY t_{name} TO '{d}/{name}.parquet'")
    rows, mentions, suppliers, parts = P.in_parts(spark, d, (F.col("o_orderpriority"), spark.sql("select '2-HIGH' as v").toArrow()["v"]), [F.col("s_nationkey").alias("location")], [F.col("p_type").alias("commodity")])
    got = [
        (int(x["article"][i]), int(x["slot"][i]), None if x["event"][i] == P.NONE else int(x["event"][i]), int(x["report"][i]), int(x["publisher"][i]), int(x["flag"][i]), suppliers["key"][x["supplier"][i]].as_py(), suppliers["location"][x["supplier"][i]].as_py(), parts["commodity"][x["part"][i]].as_py())
        for x in mentions(rows.toArrow().to_batches()) for i in range(len(x["article"]))
    ]
    n = F.col("flag")
    t = order_mentions(spark, d).select("article", "slot", F.unix_date("event_time"), F.unix_date("report_time"), (F.col("publisher") == "2-HIGH").cast("int"), F.when(n == "A", 1).when(n == "R", 2).when(n == "N", 3).otherwise(0), "actor", "location", "commodity")
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted((tuple(r) for r in t.collect()), key=key)
    assert len(got) > 1000


def test_rgcn_ablation_exchanges_no_row_of_a_line(spark, small, tmp_path, monkeypatch):
    """Columns of whole orders equal those of the joins on odd tables, so what follows is the same."""
    d = _odd(tmp_path, small)
    monkeypatch.setattr(P, "LINES", 900)
    monkeypatch.setattr(P, "BLOCK", 16)
    plans, real = [], G.stable

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(learning, "stable", seen)
    got = [learning.packed_lines(spark, d)]
    assert plans and not any("hashpartitioning(l_orderkey" in p or "hashpartitioning(article" in p for p in plans)
    got.append(learning.packed(order_mentions(spark, d, together=True)))
    rows = [sorted(zip(*(x[c].tolist() for c in learning.COLUMNS), strict=True)) for x in (W.unpack([r.data for r in df.collect()]) for df in got)]
    assert rows[0] == rows[1] and len(rows[0]) > 1000
    assert learning.bounds(got[0]) == learning.bounds(got[1])
