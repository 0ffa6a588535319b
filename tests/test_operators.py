import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import aggregates as A
from chronoweave.operators import coref as C
from chronoweave.operators import graph as G
from chronoweave.operators import learn as L
from chronoweave.operators import stats as S
from chronoweave.operators import text as X
from chronoweave.operators.selection import dense_selection
from chronoweave.plans import statistics


def test_min_n_matches_the_published_grid(spark, small):
    got = {r["dz"]: r["min_n"] for r in statistics.min_n_for_power(spark, small).collect()}
    assert got == {0.2: 197, 0.35: 65, 0.5: 32, 0.8: 13}


@pytest.mark.parametrize(("ds", "p"), [([1.0, 2.0, 3.0, 4.0], 0.125), ([0.0, 0.0], 1.0), ([0.2] * 15, 2 / 2**15)])
def test_sign_flip(spark, ds, p):
    df = spark.createDataFrame(list(enumerate(ds)), "item int, d double")
    assert S.sign_flip_exact(df).first()["p"] == pytest.approx(p)


def test_constant_shift_bootstrap(spark):
    df = spark.createDataFrame([(i, 0.2) for i in range(15)], "pos bigint, d double")
    r = S.bootstrap(df, 200).first()
    assert r["lo"] == r["hi"] == pytest.approx(0.2)


def test_unpaired_items_fail(spark):
    a, b = spark.createDataFrame([(1, 1.0)], "item int, a double"), spark.createDataFrame([(2, 1.0)], "item int, b double")
    with pytest.raises(Exception, match="same items"):
        S.paired(a, b).collect()


def test_kappa_is_null_when_one_category_only(spark):
    assert A.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first()["kappa"] is None


@pytest.mark.parametrize("mode", L.MODES)
def test_gradients(mode):
    assert L.gradient_error(mode) < 1e-4


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)], "a int, b int")
    got = {r["node"]: r["root"] for r in G.components(e, "a", "b").collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_masks(spark):
    import datetime as dt

    d = dt.date
    e = spark.createDataFrame([(d(2024, 1, 1), d(2024, 1, 5)), (d(2024, 1, 1), d(2024, 1, 6)), (None, d(2024, 1, 1))], "event_time date, available_date date")
    got = {r["regime"]: tuple(r)[1:] for r in G.masked_counts(e, F.lit("2024-01-05").cast("date")).collect()}
    assert got == {"none": (2, 0, 1), "event_time": (2, 0, 1), "report_time": (1, 1, 1)}


def test_neighbourhood_keeps_edges_back_to_seen_nodes(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    e = spark.createDataFrame([("ab", 1, 2, d, d), ("bc", 2, 3, d, d), ("cd", 3, 4, d, d)], "edge string, src int, dst int, event_time date, available_date date")
    seeds = spark.createDataFrame([(1, d)], "seed int, tau date")
    got = {(r["regime"], r["edge"]) for r in G.neighbourhoods(e, seeds).collect()}
    assert got == {(r, x) for r in G.REGIMES for x in ("ab", "bc")}


def test_collapse_drops_loops_only(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c")], "src string, dst string")
    m = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, root string")
    kept, loops = G.rewrite_edges(e, m, "src", "dst")
    assert kept.count() == 2 and loops.count() == 1


def test_adjacency_counts_duplicates_and_reciprocals_once(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "a", "b"), ("r", "a", "c")], "rel string, s string, d string")
    got = {(r["row"], r["col"]): r["weight"] for r in G.adjacency(e, "rel", "s", "d").collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "a"): 1.0, ("c", "a"): 1.0}


@pytest.mark.parametrize("window", [0, 1, 3])
def test_merge_pairs_against_all_pairs(spark, window):
    import datetime as dt

    rnd = random.Random(window)
    rows = [(i, i // 2, rnd.choice("st"), rnd.choice(["x", "y", "_none_"]), dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(12)), rnd.choice(["rice", "unclear", "chili"]), i % 3) for i in range(80)]
    df = spark.createDataFrame(rows, "mention int, article int, subtype string, district string, date date, commodity string, publisher int")
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and x[2] == y[2] and x[3] == y[3] != "_none_" and abs((x[4] - y[4]).days) <= window and (x[5] == y[5] or "unclear" in (x[5], y[5]))}
    got = C.merge_pairs(df, window).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_pairs_within(spark):
    import datetime as dt

    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randrange(6), dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(15))) for _ in range(90)]
    want = {}
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x[0] == y[0] and x[1] != y[1] and abs((x[2] - y[2]).days) <= 4:
                want[x[0]] = want.get(x[0], 0) + 1
    df = spark.createDataFrame(rows, "k string, art int, d date")
    assert {r["k"]: r["pairs"] for r in A.pairs_within(df, ["k"], "d", 4, apart="art").collect()} == want


def test_greedy_match(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(8)]
    rows = [([rnd.sample(words, 4) for _ in range(rnd.randrange(4))], [rnd.sample(words, 4) for _ in range(rnd.randrange(5))]) for _ in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, run array<array<string>>, ref array<array<string>>")
    got = {r["i"]: [(m["run"], m["ref"]) for m in r["m"]] for r in df.select("i", X.greedy_match(F.col("run"), F.col("ref")).alias("m")).collect()}
    for i, (run, ref) in enumerate(rows):
        used, want = set(), []
        for a, x in enumerate(run):
            s = [(len({*x} & {*y}) / len({*x} | {*y}), -b) for b, y in enumerate(ref) if b not in used]
            if s and max(s)[0] >= 0.45:
                used.add(-max(s)[1])
                want.append((a, -max(s)[1]))
        assert got[i] == want


def test_selection_against_a_plain_loop(spark):
    rnd = random.Random(5)
    has, disaster = {a: rnd.random() < 0.5 for a in range(60)}, {a: rnd.random() < 0.6 for a in range(60)}
    rows = []
    for place in range(12):
        c = rnd.random() < 0.5
        rows += [(place, a, c, disaster[a]) for a in rnd.sample(range(60), 8)]
    budget = 20
    taken, n_c, n_d = [], 0, 0
    for phase in (0, 1):
        for place in range(12):
            cell = sorted(r for r in rows if r[0] == place)
            if len(taken) >= budget or (phase == 0 and n_c >= int(budget * 0.45)):
                break
            if phase == 0 and not cell[0][2]:
                continue
            for _, a, c, dis in cell:
                if a in taken or len(taken) >= budget or (dis and n_d >= int(budget * 0.7)):
                    continue
                taken.append(a)
                n_c += c
                n_d += dis
    df = spark.createDataFrame(rows, "place int, article bigint, has_commodity boolean, is_disaster boolean")
    got = [r["article"] for r in dense_selection(df, budget).orderBy("ord").collect()]
    assert got == taken


def test_structure_is_learned(spark):
    """Labels that depend on a neighbour are learned with relations and not without."""
    rnd = random.Random(2)
    n = 120
    kind = [rnd.randrange(2) for _ in range(n)]
    edges = spark.createDataFrame([("r", i, 1000 + kind[i]) for i in range(n)], "rel string, src bigint, dst bigint")
    feats = [(i, [0.0, 0.0, 1.0]) for i in range(n)] + [(1000, [1.0, 0.0, 1.0]), (1001, [0.0, 1.0, 1.0])]
    features = spark.createDataFrame(feats, "node bigint, values array<double>")
    samples = spark.createDataFrame([(i, i, (i + 1) % n, "a" if kind[i] else "b", "train" if i < 80 else "test") for i in range(n)], "row bigint, src bigint, dst bigint, label string, split string")
    p = L.train_modes(edges, features, samples, 3, ["a", "b"], modes=("typed", "none"), seeds=1, epochs=200).toPandas()
    acc = p[p.split == "test"].assign(ok=lambda t: t.truth == t.pred).groupby("mode").ok.mean()
    assert acc["typed"] > acc["none"] + 0.05


def test_streaming_equals_batch(spark, small, tmp_path):
    from chronoweave.streaming import density as D

    ev = spark.read.parquet(f"{small}/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    q = D.density_stream(D.events_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("density").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("density").toPandas()
    want = D.density_batch(ev).toPandas().merge(got[["start", "event_type"]], on=["start", "event_type"])
    pd.testing.assert_frame_equal(got.sort_values(["start", "event_type"]).reset_index(drop=True), want.sort_values(["start", "event_type"]).reset_index(drop=True))
    assert len(got)


def test_binned_quantiles_equal_discrete_ones(spark):
    points = {"p25": (1, 4), "median": (1, 2), "p75": (3, 4)}
    df = spark.range(3000).selectExpr("concat('m', id % 3) as m", "case when id % 3 = 2 then id % 2 else (id * 7919) % 100003 - 500 end as v").unionAll(spark.sql("select 'm0', cast(null as bigint)")).unionAll(spark.sql("select 'm3', 7L"))
    got = {r.m: r for r in A.binned_quantiles(df, "v", points, "m", width=64).collect()}
    want = {r.m: r for r in A.discrete_quantiles(df, "v", points, by=["m"]).collect()}
    assert {m: (r.n, r.p25, r.median, r.p75) for m, r in got.items()} == {m: (r.n, r.p25, r.median, r.p75) for m, r in want.items()}
    values = [x.v for x in df.where("m = 'm0' and v is not null").collect()]
    assert (got["m0"].sum, got["m0"].max, got["m0"].above_0) == (sum(values), max(values), sum(v > 0 for v in values))
