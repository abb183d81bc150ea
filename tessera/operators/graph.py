"""Graphs of users that reviewed the same businesses: components, labels, betweenness, communities.

A graph is a table (src, dst) with src < dst, each edge once; ``both_ways`` gives it in both directions.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.packed_pairs import Packed
from tessera.session import dropped, materialized

STEPS = 1e9  # edges^2 x nodes up to which a component is peeled within one task: at most some minutes


def coreview_edges(rows: DataFrame, threshold: int) -> DataFrame:
    """(src, dst, common): users with at least ``threshold`` common businesses; ``rows`` is distinct (user_id, business_id)."""
    packed = Packed(rows.select("user_id", "business_id"), "user_id", "business_id", threshold - 1)
    pairs = packed.named(packed.pairs(threshold))
    return pairs.select(F.col("key_a").alias("src"), F.col("key_b").alias("dst"), F.col("n").cast("long").alias("common"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of every node with an edge."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reached from each node.

    Every round takes the smallest label among the neighbours and then the label of that label,
    so that distances halve; it ends when no label changes. Each round's labels are written to
    the shared folder, which cuts the lineage, and removed when the next ones are there.
    """
    links = materialized(both_ways(edges), "links")
    written = materialized(links.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    labels = written
    for _ in range(rounds):
        heard = links.join(labels, links["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, F.col("node") == F.col("src"), "left").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("near"))
        jump = nearer.select(F.col("node").alias("at"), F.col("near").alias("next"))
        moved = materialized(nearer.join(jump, F.col("near") == F.col("at"), "left").select("node", "was", F.coalesce(F.least("near", "next"), "near").alias("component")), "labels")
        dropped(written)
        labels, written = moved.select("node", "component"), moved
        if moved.filter(F.col("was") != F.col("component")).isEmpty():
            dropped(links)
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) after ``rounds`` synchronous rounds: the most frequent label of the neighbours, ties to the smallest."""
    links = materialized(both_ways(edges), "links")
    labels = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = links.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count("*").alias("votes"))
        labels = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("label").alias("label"))).alias("best")).select("node", "best.label")
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(size, members): one row per label with its nodes in order; to be sorted by size and first member."""
    return labels.groupBy(label).agg(F.array_sort(F.collect_list("node")).alias("members")).select(F.size("members").alias("size"), "members")


def modularity(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """One row ``q``: the sum over communities of inner edges / m - (degrees / 2 m)^2; 0 for a graph without edges."""
    edges = materialized(edges.select("src", "dst"), "edges")
    m = edges.agg(F.count("*").cast("double").alias("m"))
    of = labels.select("node", F.col(label).alias("c"))
    ends = edges.join(of.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(of.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
    inner = ends.filter(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("c")).agg(F.count("*").alias("inner_edges"))
    total = degrees(edges).join(of, "node").groupBy("c").agg(F.sum("degree").alias("degrees"))
    parts = total.join(inner, "c", "left").crossJoin(F.broadcast(m))  # m is one row
    q = F.coalesce("inner_edges", F.lit(0)) / F.col("m") - F.pow(F.col("degrees") / (2 * F.col("m")), 2)
    return parts.agg(F.round(F.coalesce(F.sum(q), F.lit(0.0)), 6).alias("q"))


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, value): shortest paths between all pairs of nodes that use an edge, shared among equally short ones.

    Breadth-first search from all sources at once: level by level the frontier (source, node,
    paths) is joined to the edges; credits then flow back the same way. Levels are written to the
    shared folder. The exact values need a row per (source, reached node), V^2 in a connected graph:
    the bound of what this can do. Rows are spread by (source, node), so no task holds a whole search.
    """
    links = materialized(both_ways(edges), "links")
    start = links.select(F.col("src").alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths"))
    levels = [materialized(start, "level")]
    while True:
        reached = levels[-1].join(links, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for earlier in levels[-2:]:  # a neighbour is at most one level away
            reached = reached.join(earlier.select("source", "node"), ["source", "node"], "left_anti")
        reached = materialized(reached, "level")
        if reached.isEmpty():
            break
        levels.append(reached)
    credit, flows = levels[-1].withColumn("credit", F.lit(1.0)), None
    for upper in reversed(levels[:-1]):
        lower = credit.select("source", F.col("node").alias("child"), F.col("paths").alias("child_paths"), "credit")
        down = lower.join(links, F.col("child") == F.col("dst")).select("source", F.col("src").alias("node"), "child", "child_paths", "credit")
        share = materialized(down.join(upper, ["source", "node"]).select("source", "node", "child", (F.col("credit") * F.col("paths") / F.col("child_paths")).alias("flow")), "flows")
        flows = share.select("node", "child", "flow") if flows is None else flows.unionByName(share.select("node", "child", "flow"))
        own = share.groupBy("source", "node").agg(F.sum("flow").alias("flow"))
        last, credit = credit, materialized(upper.join(own, ["source", "node"], "left").select("source", "node", "paths", (F.coalesce("flow", F.lit(0.0)) + 1).alias("credit")), "credit")
        dropped(last)
    if flows is None:
        return edges.select("src", "dst", F.lit(0.0).alias("value")).limit(0)
    return flows.groupBy(F.least("node", "child").alias("src"), F.greatest("node", "child").alias("dst")).agg(F.round(F.sum("flow") / 2, 9).alias("value"))


def _stripped(near: dict, nodes) -> tuple[list[tuple], dict]:
    """The edges of the trees that hang on the cycles of one component, as (node, rest, weight), and the weights of the nodes that are left.

    A weight counts the node and what hung on it. Of a tree one node is left.
    """
    degree, weight, trees = {v: len(near[v]) for v in nodes}, dict.fromkeys(nodes, 1), []
    leaves = [v for v, d in degree.items() if d == 1]
    while leaves:
        v = leaves.pop()
        if degree[v] != 1:  # the last node of a tree
            continue
        w = next(x for x in near[v] if x in weight)
        trees.append((v, w, weight[v]))
        weight[w] += weight.pop(v)
        degree[v], degree[w] = 0, degree[w] - 1
        if degree[w] == 1:
            leaves.append(w)
    return trees, weight


def _credits(near: dict, nodes) -> dict:
    """Betweenness of the edges among ``nodes``, whole components, in memory.

    The paths over an edge of a tree are all those between its two sides; only the nodes on and between cycles are searched from.
    """
    value: dict = {}
    left = set(nodes)
    while left:
        own = _reach(near, next(iter(left)))
        left -= own
        trees, weight = _stripped(near, own)
        for v, w, n in trees:
            value[(v, w) if v < w else (w, v)] = 2.0 * n * (len(own) - n)
        if len(weight) == 1:
            continue
        core = {v: [w for w in near[v] if w in weight] for v in weight}
        for s in core:
            level, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for w in core[v]:
                    if w not in level:
                        level[w], paths[w] = level[v] + 1, 0.0
                        queue.append(w)
                    if level[w] == level[v] + 1:
                        paths[w] += paths[v]
            gain = {v: float(weight[v]) for v in order}
            for w in reversed(order):
                for v in core[w]:
                    if level[v] == level[w] - 1:
                        flow = gain[w] * paths[v] / paths[w]
                        gain[v] += flow
                        e = (v, w) if v < w else (w, v)
                        value[e] = value.get(e, 0.0) + flow * weight[s]
    return {e: round(x / 2, 9) for e, x in value.items()}


def _work(pdf: pd.DataFrame) -> pd.DataFrame:
    """(component, work): about the steps that ``_peel`` takes for one component."""
    near: dict = {}
    for a, b in zip(pdf["src"], pdf["dst"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    trees, weight = _stripped(near, list(near))
    k, v = len(pdf), len(near)
    return pd.DataFrame({"component": [pdf["component"].iloc[0]], "work": [float(k) * (k + v + (k - len(trees)) * len(weight))]})


def _reach(near: dict, start) -> set:
    seen, queue = {start}, [start]
    while queue:
        for w in near[queue.pop()]:
            if w not in seen:
                seen.add(w)
                queue.append(w)
    return seen


def _peel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Removes all edges of one component by betweenness: (component, seq, value, src, dst, gain of modularity)."""
    component, m = pdf["component"].iloc[0], float(pdf["m"].iloc[0])
    near: dict = {}
    for a, b in zip(pdf["src"], pdf["dst"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    first = {v: frozenset(ws) for v, ws in near.items()}

    def part(c: set) -> float:
        inner = sum(len(first[v] & c) for v in c) / 2
        return inner / m - (sum(len(first[v]) for v in c) / (2 * m)) ** 2

    value, rows = _credits(near, list(near)), []
    while value:
        (a, b), x = min(value.items(), key=lambda i: (-i[1], i[0]))
        near[a].discard(b)
        near[b].discard(a)
        of_a = _reach(near, a)
        gain = 0.0
        if b not in of_a:
            of_b = _reach(near, b)
            gain = part(of_a) + part(of_b) - part(of_a | of_b)
            touched = of_a | of_b
        else:
            touched = of_a
        rows.append((component, len(rows) + 1, x, a, b, gain))
        value = {e: y for e, y in value.items() if e[0] not in touched}
        value.update(_credits(near, touched))
    return pd.DataFrame(rows, columns=["component", "seq", "value", "src", "dst", "gain"])


def _peel_distributed(edges: DataFrame, component, m: float) -> list[tuple]:
    """As ``_peel`` for a component too large for a task: one distributed betweenness per removed edge."""
    first, left, rows = materialized(edges.select("src", "dst"), "edges"), edges.select("src", "dst"), []

    def parts(labels: DataFrame, within: list) -> float:
        inside = labels.filter(F.col("component").isin(within))
        deg = inside.join(degrees(first), "node").groupBy("component").agg(F.sum("degree").alias("d"))
        s, t = inside.select(F.col("node").alias("src"), F.col("component").alias("cs")), inside.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
        inner = first.join(s, "src").join(t, "dst").filter("cs = cd").groupBy(F.col("cs").alias("component")).count()
        return float(deg.join(inner, "component", "left").agg(F.sum(F.coalesce("count", F.lit(0)) / m - F.pow(F.col("d") / (2 * m), 2))).first()[0] or 0.0)

    nodes = both_ways(first).select(F.col("src").alias("node")).distinct()
    labelled = lambda e: nodes.join(connected_components(e), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    before = materialized(labelled(left), "labels")
    while True:
        top = edge_betweenness(left).orderBy(F.col("value").desc(), "src", "dst").first()
        if top is None:
            return rows
        cut, left = left, materialized(left.filter(~((F.col("src") == top["src"]) & (F.col("dst") == top["dst"]))), "edges")
        dropped(cut)
        after = materialized(labelled(left), "labels")
        ends = {r["node"]: r["component"] for r in after.filter(F.col("node").isin([top["src"], top["dst"]])).collect()}
        gain = 0.0
        if len(set(ends.values())) == 2:
            old = before.filter(F.col("node") == top["src"]).first()["component"]
            gain = parts(after, list(ends.values())) - parts(before, [old])
        rows.append((component, len(rows) + 1, top["value"], top["src"], top["dst"], gain))
        dropped(before)
        before = after


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` up to each row in a total order, rising by the columns ``order``.

    Rows are range-partitioned by the order, each range is summed by itself, and the sums of the
    earlier ranges, one row per range, are added.
    """
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    placed = rows.withColumns(keys).repartitionByRange(*[F.col(k) for k in keys]).withColumn("__range", F.spark_partition_id())
    placed = materialized(placed, "ranges")
    own = placed.withColumn(name, F.sum(value).over(Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    totals = placed.groupBy("__range").agg(F.sum(value).alias("__sum"))
    earlier = totals.alias("t").join(totals.alias("u"), F.col("u.__range") < F.col("t.__range")).groupBy(F.col("t.__range").alias("__range")).agg(F.sum("u.__sum").alias("__before"))
    out = own.join(F.broadcast(earlier), "__range", "left")  # a row per range
    return out.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0.0))).drop("__range", "__before", *keys)


def girvan_newman(edges: DataFrame, steps: float = STEPS) -> DataFrame:
    """(node, component): the partition of largest modularity on the way of removing the edge of highest betweenness.

    Betweenness changes in the edge's own component only, so components are peeled independently
    and their removals merged into the global order: an edge is removed as soon as it is the
    highest among the components' next ones, i.e. in the order of the smallest value up to it. Ties
    go to the smaller edge; among equal modularities the earlier partition wins. The removals within
    a component follow from one another, about E x V x E steps in all, where E x V are those on and between
    cycles: trees take E x E. A component of up to ``steps`` of them is peeled by one task, as many at once as there are tasks; beyond that every removal is
    a distributed search, with the same result.
    """
    spark = edges.sparkSession
    edges = materialized(edges.select("src", "dst"), "edges")
    parts = materialized(connected_components(edges), "parts")
    placed = materialized(edges.join(parts.select(F.col("node").alias("src"), "component"), "src"), "placed")
    m = edges.count()
    sizes = placed.groupBy("component").agg(F.count("*").cast("double").alias("k")).join(parts.groupBy("component").agg(F.count("*").alias("v")), "component")
    kind = edges.schema["src"].dataType.simpleString()
    sizes = materialized(sizes.withColumn("large", F.col("k") * F.col("k") * F.col("v") > steps), "sizes")
    unclear = sizes.filter(F.col("large") & (F.col("k") * (F.col("k") + F.col("v")) <= steps)).select("component")  # trees need no more than that
    work = placed.join(unclear, "component", "left_semi").groupBy("component").applyInPandas(_work, f"component {kind}, work double")
    sizes = materialized(sizes.join(work, "component", "left").withColumn("large", F.col("large") & (F.coalesce("work", F.lit(float("inf"))) > steps)), "sizes")
    schema = f"component {kind}, seq long, value double, src {kind}, dst {kind}, gain double"
    small = placed.join(sizes.filter("NOT large").select("component"), "component", "left_semi")
    removed = small.withColumn("m", F.lit(float(max(m, 1)))).groupBy("component").applyInPandas(_peel, schema)
    for r in sizes.filter("large").toLocalIterator():
        own = placed.filter(F.col("component") == F.lit(r["component"]))
        removed = removed.unionByName(spark.createDataFrame(_peel_distributed(own, r["component"], float(m)), schema))
    removed = materialized(removed, "removed")
    so_far = Window.partitionBy("component").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # the removal that holds up this one: the smallest value, of equal ones the first
    keyed = removed.withColumn("key", F.min(F.struct("value", "seq", "src", "dst")).over(so_far))
    order = [F.col("key.value").desc(), F.col("key.src"), F.col("key.dst"), F.col("component"), F.col("seq")]
    rising = [-F.col("key.value"), *order[1:]]
    splits = running_sum(keyed.filter(F.col("gain") != 0), rising, "gain", "q").withColumn("q", F.round("q", 12))
    best = splits.orderBy(F.col("q").desc(), *order).first()
    nodes = parts.select("node", F.col("component").alias("first"))
    if best is None or best["q"] <= 0:
        return nodes.select("node", F.col("first").alias("component"))
    b = best["key"]
    at = F.struct((-F.col("key.value")).alias("v"), F.col("key.src").alias("s"), F.col("key.dst").alias("d"), "component", "seq")
    mark = F.struct(F.lit(-b["value"]).alias("v"), F.lit(b["src"]).alias("s"), F.lit(b["dst"]).alias("d"), F.lit(best["component"]).alias("component"), F.lit(best["seq"]).cast("long").alias("seq"))
    kept = keyed.filter(at > mark).select("src", "dst")
    joined = connected_components(kept)
    return nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
