"""Graph operators, drift and common substrings against plain Python."""

import math
import random
from collections import deque
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import substring
from siltstone.functions import vectors as v
from siltstone.operators import graph


def brandes(edges, sources):
    """Dependencies of the sources, normalised, node by node with queues."""
    near = {}
    for a, b in set(edges):
        near.setdefault(a, []).append(b)
        near.setdefault(b, [])
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        order, far, paths, before = [], {s: 0}, dict.fromkeys(near, 0.0), {x: [] for x in near}
        paths[s] = 1.0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in near[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
                if far[y] == far[x] + 1:
                    paths[y] += paths[x]
                    before[y].append(x)
        held = dict.fromkeys(near, 0.0)
        for y in reversed(order):
            for x in before[y]:
                held[x] += paths[x] / paths[y] * (1 + held[y])
            if y != s:
                total[y] += held[y]
    n = len(near)
    return {x: t / ((n - 1) * (n - 2)) for x, t in total.items()}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def test_betweenness_of_all_sources_in_blocks(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(14)}", f"n{min(r.randrange(14), r.randrange(14))}") for _ in range(40)] + [("x", "y"), ("y", "x"), ("n1", "n1")]
    got = {r.id: r.betweenness for r in graph.betweenness(frame(spark, edges), block=8).collect()}
    want = brandes([e for e in edges if e[0] != e[1]], {x for e in edges for x in e})
    assert got == pytest.approx(want)


def test_betweenness_on_suppliers_and_parts(spark):
    from siltstone.queries.analytics import _between, _both_ways
    from siltstone.queries.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    edges = [tuple(r) for r in _both_ways(t).collect()]
    sources = {x for x, _ in edges if int(x[1:]) % 100 == 0}
    want = brandes(edges, sources)
    got = {r.id: r.betweenness for r in _between(t).collect()}
    assert len(got) == len(want) and sources and all(math.isclose(got[x], round(b, 9), abs_tol=2e-9) for x, b in want.items())
    assert max(got.values()) > 0


def test_nothing_passes_without_edges(spark):
    assert graph.betweenness(frame(spark, [("a", "b")]).limit(0)).count() == 0
    assert {r.betweenness for r in graph.betweenness(frame(spark, [("a", "b")]), frame(spark, [("q", "q")]).select(F.col("src").alias("id"))).collect()} == {0.0}


def test_shared_neighbours_with_a_target_of_all(spark):
    edges = [(f"s{i}", f"p{i % 7}") for i in range(60)] + [(f"s{i}", "all") for i in range(60)] * 2
    got = {(r.a, r.b): r.shared for r in graph.shared_neighbours(frame(spark, edges), block=8).collect()}
    of = {}
    for a, b in set(edges):
        of.setdefault(a, set()).add(b)
    assert got == {(a, b): len(of[a] & of[b]) for a, b in combinations(sorted(of), 2)}


def test_pagerank_stops_at_the_tolerance(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    loose, few = graph.pagerank(frame(spark, edges), 1e-2)
    tight, many = graph.pagerank(frame(spark, edges), 1e-9)
    ranks = dict.fromkeys("abcd", 0.25)
    out = {x: [b for a, b in edges if a == x] for x in ranks}
    for _ in range(many):
        lost = sum(ranks[x] for x in ranks if not out[x])
        ranks = {x: 0.85 * (sum(ranks[y] / len(out[y]) for y in ranks if x in out[y]) + lost / 4) + 0.15 / 4 for x in ranks}
    assert few < many and {r.id: r["rank"] for r in tight.collect()} == pytest.approx(ranks)
    assert loose.count() == 4


def test_drift_counts_every_pair_in_every_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.3, (37, 5)), rng.normal(0.2, 0.3, (23, 5))
    k = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1)).mean()
    want = k(a, a) + k(b, b) - 2 * k(a, b)
    df = lambda x: spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    monkeypatch.setattr(v, "KERNEL_ROWS", 8)
    assert v.mmd(df(a), df(b), "x").first().mmd == pytest.approx(want)
    assert v.mmd(df(a), df(b).limit(0), "x").first().mmd == 0


def test_longest_common_substring(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choices("abc é", k=r.randrange(60))), "".join(r.choices("abc é", k=r.randrange(60)))) for i in range(60)] + [(60, None, "x"), (61, "same", "same"), (62, "a" * 5000, "a" * 4500)]

    def plain(a, b):
        a, b = (a or "")[:4000], (b or "")[:4000]
        return len(a) if a in b else max((n for i in range(len(a)) for n in range(len(a) - i + 1) if a[i : i + n] in b), default=0)

    df = spark.createDataFrame(rows, "id long, a string, b string")
    assert {x.id: x.longest for x in substring.longest_common(df, "id", "a", "b").collect()} == {i: plain(a, b) for i, a, b in rows}
    assert substring.longest_common(df.filter("id = 62"), "id", "a", "b", None).first().longest == 4500


def test_shared_neighbours_over_more_tasks_where_there_are_more_pairs(spark, monkeypatch):
    edges = [(f"s{i}", f"p{i % 5}") for i in range(40)] + [(f"s{i}", "all") for i in range(40)]
    count = lambda: {(r.a, r.b): r.shared for r in graph.shared_neighbours(frame(spark, edges), block=8).collect()}
    once = count()
    monkeypatch.setattr(graph, "PAIRS", 20)
    assert count() == once and len(once) == 40 * 39 // 2


def test_betweenness_goes_by_numbers_and_ends_when_all_is_reached(spark, monkeypatch):
    kept = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: kept.append(df) or real(df))
    names = ("a", "b", "c", "d")
    got = {r.id: r.betweenness for r in graph.betweenness(frame(spark, [(x, y) for x in names for y in names if x != y])).collect()}
    assert got == dict.fromkeys(names, 0.0)
    levels = [df for df in kept if df.columns == ["source", "node", "paths"]]
    assert len(levels) == 2 and all(dict(df.dtypes)["node"] == "bigint" for df in levels)


def test_sources_share_the_rows_of_betweenness(spark, monkeypatch):
    kept = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: kept.append(df) or real(df))
    r = random.Random(4)
    edges = {(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(70)}
    edges = [x for x in edges if x[0] != x[1]]
    monkeypatch.setattr(graph, "SUMMED", 5)  # sums of parts are summed again
    got = {r.id: r.betweenness for r in graph.betweenness(frame(spark, edges)).collect()}
    assert got == pytest.approx(brandes(edges, {x for e in edges for x in e}))
    nodes = len(got)
    levels = [df for df in kept if df.columns == ["source", "node", "paths"]]
    assert len(levels) > 3 and all(df.count() <= nodes for df in levels[1:])  # not a row for each source
