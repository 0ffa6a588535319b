import random

import numpy as np
import pytest

from chronoweave.llm.line_dedup import _carried, _hash, common_prefixes, dedup_lines
from tests.llm import cases


def brute(rows, least):
    """Lines with words that remain, by (key, text): every window of `least` words that also begins earlier goes."""
    docs = sorted({(k is not None, k or 0, t) for k, t in rows if t})
    seen, out = set(), {}
    for has, k, t in sorted(docs, key=lambda d: (d[0], d[1], _hash(d[2]))):
        lines = [s.strip() for s in t.split("\n") if s.strip()]
        gone = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += len(lines[b].split())
                if total >= least:
                    window = hash(tuple(lines[a : b + 1]))
                    if window in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(window)
        out[(k if has else None, t)] = [s for i, s in enumerate(lines) if i not in gone]
    return out


def check(df, least):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows, least)
    got = dedup_lines(df.withColumnRenamed("lang", "cut_runs_"), least)
    first = {r: 0 for r in rows}
    n = 0
    by = {}
    for r in got.collect():
        n += 1
        by.setdefault(r["doc_id"], []).append([s.strip() for s in (r["text"] or "").split("\n") if s.strip()])
    assert n == len(rows) and len(first) <= n
    for (k, t), kept in want.items():
        assert kept in by[k]


@pytest.mark.parametrize("least", [1, 5, 50])
def test_edge_cases(spark, least):
    check(cases.frame(spark), least)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_runs(spark, seed):
    rnd = random.Random(seed)
    lines = [cases.passage(rnd, rnd.randrange(1, 6)) for _ in range(6)] + [""]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 25)))) for i in range(12)]
    check(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string"), 8)


def test_columns_pass_through(spark):
    df = cases.frame(spark)
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_kept"] and out.count() == df.count()
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id in (0, 1, 2)").collect()} == {0: None, 1: "", 2: " \n "}


def test_empty(spark):
    assert dedup_lines(cases.empty(spark)).count() == 0


def kept_lines(spark, rows, least):
    got = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), least).collect()
    return {r["doc_id"]: [s.strip() for s in r["text"].split("\n") if s.strip()] for r in got}


def test_maximal_takes_the_tail_of_a_run(spark):
    rnd = random.Random(5)
    for sizes in ((40, 20, 5), (60, 3, 2, 4), (30, 10, 30)):
        run = [cases.passage(rnd, n) for n in sizes]
        rows = [(i, "\n".join([f"own line {i}", *run, f"own end {i}"])) for i in range(2)]
        kept = kept_lines(spark, rows, 50)
        assert kept[0] == rows[0][1].split("\n") and kept[1] == ["own line 1", "own end 1"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maximal_runs_at_random(spark, seed):
    rnd = random.Random(seed)
    lines = [cases.passage(rnd, n) for n in (1, 1, 2, 3, 5, 9)] + [""]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 20)))) for i in range(12)]
    assert kept_lines(spark, rows, 8) == {k: kept for (k, _), kept in brute(rows, 8).items()} | {k: [] for k, t in rows if not t}


def test_deep_runs_over_many_tasks(spark):
    """Runs of up to 200 lines of one word each; the array and its intervals go over the borders of tasks."""
    rnd = random.Random(7)
    run = [f"w{rnd.randrange(6)}" for _ in range(200)]
    rows = [(i, "\n".join([f"own {i}", *run[rnd.randrange(0, 60) : rnd.randrange(120, 201)], f"end {i}", *run[:70]])) for i in range(14)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = kept_lines(spark, rows, 50)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: kept for (k, _), kept in brute(rows, 50).items()}


def test_common_prefixes_and_borders():
    """Intervals named by tasks and borders are those of one scan."""
    rnd = random.Random(3)
    heads = sorted([rnd.randrange(2) for _ in range(rnd.randrange(0, 9))] for _ in range(200))
    arrays = [np.array(h, np.int64) for h in heads]
    plain = [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(heads, heads[1:])]
    assert common_prefixes(arrays).tolist() == plain
    cuts = [0, 1, 2, 50, 51, 200]
    borders = [{"pid": p, "first": heads[a], "last": heads[b - 1], "breaks": [sum(x < d for x in plain[a : b - 1]) for d in range(9)]} for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    carried = _carried(borders, 8)
    assert [carried[p].tolist() for p in range(5)] == [[sum(x < d for x in plain[:a]) for d in range(9)] for a in cuts[:-1]]
