import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph

TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(TRIANGLES, "src string, dst string")


def test_bridge_has_the_highest_betweenness(edges):
    values = {(r["src"], r["dst"]): r["value"] for r in graph.edge_betweenness(edges).collect()}
    assert values["c", "d"] == 9 and len(values) == 7
    in_memory = graph._credits({v: {w for e in TRIANGLES for w in e if v in e and w != v} for v in "abcdef"}, "abcdef")
    assert values == in_memory


@pytest.mark.parametrize("in_task", [100, 0])
def test_first_split_gives_the_triangles(edges, in_task):
    labels = graph.girvan_newman(edges, in_task)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, parts.values())) == [["a", "b", "c"], ["d", "e", "f"]]
    assert math.isclose(graph.modularity(edges, labels, "component").first()["q"], 5 / 14, abs_tol=1e-6)


def test_components_of_a_long_chain_and_a_pair(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    found = {r["node"]: r["component"] for r in graph.connected_components(chain).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_labels_take_the_smallest_of_ties(edges):
    first = {r["node"]: r["label"] for r in graph.label_propagation(edges, 1).collect()}
    assert first == {"a": "b", "b": "a", "c": "a", "d": "c", "e": "d", "f": "d"}
    sizes = [r["size"] for r in graph.communities(graph.connected_components(edges), "component").collect()]
    assert sizes == [6]


def test_edges_count_common_businesses_once(spark):
    rows = [(u, b) for u in ("u", "v", "w") for b in range(3)] + [("w", 9)]
    out = graph.coreview_edges(spark.createDataFrame(rows, "user_id string, business_id int"), 3)
    assert sorted(map(tuple, out.collect())) == [("u", "v", 3), ("u", "w", 3), ("v", "w", 3)]


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.connected_components(none).collect() == []
    assert graph.edge_betweenness(none).collect() == []
    assert graph.girvan_newman(none).collect() == []


def test_betweenness_of_a_long_chain_has_no_cap(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    values = {(r["src"], r["dst"]): r["value"] for r in graph.edge_betweenness(chain).collect()}
    assert values == {(i, i + 1): (i + 1) * (20 - i) for i in range(20)}


def brute_force_communities(edges):
    """Edges removed one by one over the whole graph, betweenness from all shortest paths written out, and the partition of largest modularity."""
    nodes, m = sorted({v for e in edges for v in e}), len(edges)
    left = {tuple(sorted(e)) for e in edges}
    degree = {v: sum(v in e for e in edges) for v in nodes}

    def near(v):
        return [b if a == v else a for a, b in left if v in (a, b)]

    def paths(s):
        level, found = {s: [[s]]}, {s: [[s]]}
        while level:
            longer = {}
            for v, ps in level.items():
                for w in near(v):
                    if w not in found:
                        longer.setdefault(w, []).extend([*p, w] for p in ps)
            found.update(longer)
            level = longer
        return found

    def betweenness():
        value = dict.fromkeys(left, 0.0)
        for s in nodes:
            for t, ps in paths(s).items():
                for p in ps:
                    for a, b in zip(p, p[1:]):
                        value[min(a, b), max(a, b)] += 0.5 / len(ps)
        return {e: round(x, 9) for e, x in value.items()}

    def partition():
        return {frozenset(paths(v)) for v in nodes}

    def q(parts):
        return round(sum(sum(a in c and b in c for a, b in edges) / m - (sum(degree[v] for v in c) / (2 * m)) ** 2 for c in parts), 12)

    best = partition()
    while left:
        value = betweenness()
        left.remove(min(value, key=lambda e: (-value[e], e)))
        if q(partition()) > q(best):
            best = partition()
    return best


@pytest.mark.parametrize("steps", [1e9, 0])
def test_communities_of_random_graphs_equal_brute_force(spark, steps):
    rng = random.Random(6)
    size, groups = (12, 4) if steps else (4, 3)
    edges = {(a, b) for a in range(size * groups) for b in range(a) if rng.random() < ((0.45 if steps else 0.8) if a // size == b // size else 0.02)}
    edges = sorted({(f"n{b:02}", f"n{a:02}") for a, b in edges} | {("x0", "x1"), ("x1", "x2")})
    labels = graph.girvan_newman(spark.createDataFrame(edges, "src string, dst string"), steps)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["component"], set()).add(r["node"])
    assert set(map(frozenset, parts.values())) == brute_force_communities(edges) and len(parts) >= groups


def test_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), float(rng.randrange(9))) for i in range(500)]
    found = graph.running_sum(spark.createDataFrame(rows, "i int, k int, v double").repartition(5), [F.col("k"), -F.col("i")], "v", "s")
    total, expected = 0.0, {}
    for i, k, v in sorted(rows, key=lambda r: (r[1], -r[0])):
        total += v
        expected[i] = total
    assert {r["i"]: r["s"] for r in found.collect()} == expected and found.columns == ["i", "k", "v", "s"]


def test_a_large_star_is_peeled_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "_peel_distributed", None)  # 1,300 distributed searches
    edges = spark.createDataFrame([("a", f"b{i:04}") for i in range(1300)] + [("x", "y")], "src string, dst string")
    labels = {r["node"]: r["component"] for r in graph.girvan_newman(edges).collect()}
    assert len(labels) == 1303 and {labels["x"], labels["y"]} == {"x"} and {labels[v] for v in labels if v not in "xy"} == {"a"}
