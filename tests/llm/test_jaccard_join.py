import random

import pytest

from chronoweave.llm import jaccard_join as J
from chronoweave.llm.jaccard_join import jaccard_classes, runs_for
from tests.llm import cases


def brute(rows, size=5, s=0.8):
    """(class, links) of each row by place."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= s * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [(least.get(find(i)) if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


def check(spark, df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = sorted(((k, *b) for (k, _), b in zip(rows, brute(rows), strict=True)), key=repr)
    got = sorted((tuple(r) for r in jaccard_classes(df).select("doc_id", "class_id", "n_links").collect()), key=repr)
    assert got == want


def test_edge_cases(spark):
    check(spark, cases.frame(spark))


def test_null_keys_next_to_near_copies(spark):
    rnd = random.Random(2)
    w = cases.passage(rnd, 80).split()
    near = lambda: " ".join([*w[:40], f"x{rnd.random()}", *w[41:]])
    check(spark, spark.createDataFrame([(None, near()), (1, near()), (None, near()), (None, near()), (None, cases.passage(rnd, 60)), (4, None), (None, None)], "doc_id bigint, text string"))


def test_text_hash_is_that_of_spark(spark):
    texts = ["", "a", "é ü 漢字 🙂", "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
    assert got == [J._text_hash(t) for t in texts]


@pytest.mark.parametrize("similarity", [0.8, 0.82])
def test_recall_of_the_runs(similarity):
    """Pairs of independent min-hashes meet in some run at the deepest level as often as the formula says."""
    import numpy as np

    rng = np.random.default_rng(1)
    runs, n = J.runs_for(0.8, 3, 0.9995), 40_000
    a = rng.integers(0, 2**63, (n, J.COORDS)).astype(np.uint64)
    b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 2**63, a.shape).astype(np.uint64))
    miss = 1 - (J._paths(a, runs, 3)[:, :, 2] == J._paths(b, runs, 3)[:, :, 2]).any(1).mean()
    expected = (1 - similarity**3) ** runs
    assert abs(miss - expected) < 4 * (expected / n) ** 0.5


def test_empty(spark):
    assert jaccard_classes(cases.empty(spark)).count() == 0


def test_small_table(spark, small):
    check(spark, spark.read.parquet(f"{small}/documents.parquet"))


@pytest.mark.parametrize("leaf", [4, 256])
def test_large_group_of_near_copies(spark, leaf):
    """Blocks and deep nodes lose no link."""
    rnd = random.Random(9)
    base = cases.passage(rnd, 120).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randrange(1, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(5)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(i, *b) for (i, _), b in zip(rows, brute(rows), strict=True)]
    old = J.BLOCK_SETS
    J.BLOCK_SETS = 32
    try:
        got = sorted(tuple(r) for r in jaccard_classes(df, leaf=leaf).collect())
    finally:
        J.BLOCK_SETS = old
    lost = sum(w[2] - g[2] for g, w in zip(got, want, strict=True))
    print(lost, sum(w[2] for w in want), sum(g[1] != w[1] for g, w in zip(got, want, strict=True)))
    assert 0 <= lost <= 0.005 * sum(w[2] for w in want) and [g[1] for g in got] == [w[1] for w in want]


def test_runs():
    assert runs_for(0.8, 1, 0.99) == 3
    assert 1 - (1 - 0.8**4) ** runs_for(0.8, 4, 0.995) >= 0.995
