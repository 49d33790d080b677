"""Hash trees against a plain recursion, components against Tarjan's and against closures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import graphs, trees


def root(files, depth):
    def node(prefix, level):
        if level == depth:
            lines = [f"{p}:{s}" for p, s in files.items() if hashlib.md5(p.encode()).hexdigest().startswith(prefix)]
        else:
            lines = [f"{prefix}{d}:{h}" for d in "0123456789abcdef" if (h := node(prefix + d, level + 1))]
        return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest() if lines else None

    return node("", 0)


def table(spark, sets):
    return spark.createDataFrame([(k, p, s) for k, files in sets.items() for p, s in files.items()], "k string, path string, sha string").repartition(3)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_roots(spark, depth):
    sets = {"a": {f"dir/{i}": f"s{i}" for i in range(40)}, "b": {"x": "y"}}
    got = {r["k"]: (r["tree"], r["files"]) for r in trees.roots(trees.nodes(table(spark, sets), ["k"], "path", "sha", depth), ["k"]).collect()}
    assert got == {k: (root(f, depth), len(f)) for k, f in sets.items()}


def test_changes_are_found_and_no_more_is_read(spark):
    old = {"a": {f"p{i}": "s" for i in range(60)}, "gone": {"q": "s"}, "same": {f"r{i}": "s" for i in range(30)}}
    new = {"a": {**{f"p{i}": "s" for i in range(59)}, "p7": "t", "p99": "s"}, "fresh": {"z": "s"}, "same": old["same"]}
    got = sorted(tuple(r) for r in trees.changed(table(spark, old), table(spark, new), ["k"], "path", "sha", 2).collect())
    assert got == [("a", "p59", "removed"), ("a", "p7", "altered"), ("a", "p99", "added"), ("fresh", "z", "added"), ("gone", "q", "removed")]


def components(edges):
    nodes = {v for e in edges for v in e}
    reach = {v: set() for v in nodes}
    for a, b in edges:
        reach[a].add(b)
    changed = True
    while changed:
        changed = False
        for v in nodes:
            more = set().union(reach[v], *[reach[w] for w in reach[v]])
            changed |= more != reach[v]
            reach[v] = more
    return {(v, min([u for u in nodes if u in reach[v] and v in reach[u]])) for v in nodes if v in reach[v]}


@pytest.mark.parametrize("seed,n,m,local", [(0, 12, 14, 0), (1, 30, 40, 20), (2, 30, 60, 1 << 16), (3, 60, 70, 1 << 16)])
def test_components(spark, monkeypatch, seed, n, m, local):
    monkeypatch.setattr(graphs, "LOCAL_EDGES", local)
    draw = random.Random(seed)
    sets = {g: [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] for g in "xy"}
    sets["loop"], sets["line"] = [(3, 3), (3, 4)], [(0, 1), (1, 2), (2, 3)]
    sets["bridge"] = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 3)]
    df = spark.createDataFrame([(g, a, b) for g, e in sets.items() for a, b in e], "graph string, a long, b long")
    got = {(r["graph"], r["node"], r["component"]) for r in graphs.strong_components(df).collect()}
    assert got == {(g, v, c) for g, e in sets.items() for v, c in components(e)}


def test_rows_stay_linear_in_a_large_component(spark, monkeypatch):
    """A ring of 400 nodes with chords: its closure has 160,000 pairs, no table of a round more than nodes and edges."""
    n = 400
    edges = spark.range(n).select(F.lit("g").alias("graph"), "id", F.explode(F.array((F.col("id") + 1) % n, (F.col("id") * 7 + 3) % n)).alias("b")).select("graph", F.col("id").alias("a"), "b")
    monkeypatch.setattr(graphs, "LOCAL_EDGES", 0)
    seen, real = [], graphs.written
    graphs.written = lambda df, tag: seen.append(real(df, tag)) or seen[-1]
    try:
        assert graphs.strong_components(edges).where("component = 0").count() == n
    finally:
        graphs.written = real
    assert max(t.count() for t in seen) <= 3 * n


def test_edges_are_dealt_over_tasks_that_grow_in_number(spark, monkeypatch):
    """What a task sorts is bounded; a large graph meets its size by broadcast, not in one partition of its name."""
    from episodica.sources import shared

    assert shared.dealt(spark.range(4_000), "id", rows=100).rdd.getNumPartitions() == 40
    met = []
    monkeypatch.setattr(graphs, "LOCAL_EDGES", 10)
    monkeypatch.setattr(graphs, "dealt", lambda df, *keys: met.append((keys, df.count())) or df.repartition(3, *keys))
    edges = [("large", i, j) for i in range(4) for j in range(4) if i != j] + [("small", 1, 2), ("small", 2, 1), ("small", 2, 3)]
    got = graphs.strong_components(spark.createDataFrame(edges, "graph string, a int, b int")).collect()
    assert sorted(map(tuple, got)) == [*[("large", i, 0) for i in range(4)], ("small", 1, 1), ("small", 2, 1)]
    assert met == [(("graph", "a", "b"), 15), (("graph",), 3)]
