"""Items that appear together far more often than chance.

Exact pair counts. Pairs are joined basket by basket, except in the (at most 64) largest baskets:
which of those an item is in is a bit mask of the item, so their part of a pair's count is the
number of common bits. A pair that meets in large baskets only is found from the masks, leaving
out each item's largest ones, of which any frequent enough pair shares one more. All other baskets
of more than a thousand items, and the large ones where they are joined, are cut into blocks, a key
for each pair of blocks. Items that can't reach the count or the lift in any pair are left out before.

Chance. The null model is the maximum-entropy random bipartite graph that keeps, on average,
every item's frequency and every basket's size: P(item i in basket u) = x_i y_u / (1 + x_i y_u).
The number of common baskets is then Poisson-binomial. Its upper tail is computed exactly: the
distribution is tilted until its mean is the count observed, so that the tail keeps its relative
precision, and inverted from its characteristic function. Benjamini-Hochberg over all possible
pairs turns tails into q-values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common_pairs import in_blocks, meeting
from tessera.session import materialized

HEAVY_BASKETS, HEAVY_FLOOR = 64, 256
EXACT_DEGREES, RATIO = 64, 1.02


def degree_class(degree: Column) -> Column:
    """Degrees up to 64 are classes of their own, larger ones share classes 2 % wide: under 1500 classes up to 10^12."""
    wide = EXACT_DEGREES + F.floor(F.log(degree / EXACT_DEGREES) / math.log(RATIO)) + 1
    return F.when(degree <= EXACT_DEGREES, degree).otherwise(wide).cast("int")


def _histogram(degrees: DataFrame, column: str) -> pd.DataFrame:
    """(class, mean degree, number) by class; bounded by the number of classes."""
    return degrees.groupBy(degree_class(F.col(column)).alias("cls")).agg(F.avg(column).alias("degree"), F.count("*").alias("number")).orderBy("cls").toPandas()


def fit_null(items: pd.DataFrame, baskets: pd.DataFrame, rounds: int = 2000, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The fitness of each item class and basket class under which expected degrees are the observed ones."""
    d, m = items["degree"].to_numpy(float), items["number"].to_numpy(float)
    s, w = baskets["degree"].to_numpy(float), baskets["number"].to_numpy(float)
    if not len(d) or not len(s):
        return np.zeros(len(d)), np.zeros(len(s))
    edges = (d * m).sum()
    x, y = d / math.sqrt(edges), s / math.sqrt(edges)
    for _ in range(rounds):
        old = x
        x = d / ((w * y) / (1 + np.outer(x, y))).sum(axis=1)
        y = s / ((m * x)[:, None] / (1 + np.outer(x, y))).sum(axis=0)
        if np.max(np.abs(x - old) / np.maximum(x, 1e-300)) < tolerance:
            break
    return x, y


def log_tail(p: np.ndarray, times: np.ndarray, k: int) -> float:
    """ln P(K >= k) for K the sum of Bernoulli(p_c) variables, each ``times_c`` times."""
    keep = (p > 0) & (times > 0)
    p, times = np.minimum(p[keep], 1 - 1e-12), times[keep]
    mean = float((p * times).sum())
    if k <= 0:
        return 0.0
    if k > times.sum():
        return -math.inf
    if k <= mean:
        theta = 0.0
    else:  # the tilt at which the mean is k, by bisection
        low, high = 0.0, math.log(k / max(mean, 1e-300)) + 1.0
        expected = lambda t: float((times * (p * math.exp(t)) / (1 - p + p * math.exp(t))).sum())
        while expected(high) < min(k, times.sum() - 1e-9) and high < 500:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if expected(mid) < k else (low, mid)
        theta = (low + high) / 2
    grown = p * math.exp(theta)
    log_m = float((times * np.log(1 - p + grown)).sum())
    q = grown / (1 - p + grown)
    centre, spread = float((q * times).sum()), math.sqrt(float((q * (1 - q) * times).sum()))
    first = max(0, int(centre - 14 * spread - 30))
    size = int(min(times.sum(), centre + 14 * spread + 30)) - first + 1
    angle = 2j * np.pi * np.arange(size // 2 + 1) / size
    phi = np.exp((times[:, None] * np.log1p(np.outer(q, np.exp(angle) - 1))).sum(axis=0) - angle * first)
    probability = np.fft.irfft(np.conj(phi), n=size).clip(0)
    values = first + np.arange(size)
    up = values >= k
    tail = float((probability[up] * np.exp(-theta * (values[up] - k))).sum())
    return min(0.0, log_m - theta * k + math.log(max(tail, 1e-300)))


def cooccurring(members: DataFrame, basket: str, item: str, min_count: int = 5, min_lift: float = 1.0, heavy_floor: int = HEAVY_FLOOR) -> DataFrame:
    """Pairs of items in at least ``min_count`` common baskets and ``min_lift`` times as often as independence gives.

    ``members`` has a row per (basket, item); rows with a null in either are left out, repeated rows
    count once, other columns are ignored. Result: ``item_a`` < ``item_b``, ``k`` common baskets, ``a``
    and ``b`` baskets of each, ``n_baskets``, ``lift`` = k N / (a b), ``expected`` under the null model,
    ``surprise`` = -log10 P(K >= k) and ``q_value`` (an upper bound: only pairs returned are ranked,
    against all possible pairs). An empty input gives no rows.
    """
    spark = members.sparkSession
    pairs = materialized(members.select(F.col(basket).alias("u"), F.col(item).alias("i")).dropna().distinct(), "baskets")
    sizes = materialized(pairs.groupBy("u").agg(F.count("*").alias("size")), "sizes")
    by_size = _histogram(sizes, "size")
    n_baskets = int(by_size["number"].sum())
    # At most HEAVY_BASKETS rows, whatever the data.
    heavy = [(r["u"], i) for i, r in enumerate(sizes.filter(F.col("size") > heavy_floor).orderBy(F.col("size").desc(), "u").limit(HEAVY_BASKETS).collect())]
    u_type = pairs.schema["u"].dataType.simpleString()
    large = F.broadcast(spark.createDataFrame(heavy, f"u {u_type}, bit int"))

    bit = F.expr("coalesce(shiftleft(1L, bit), 0L)")
    degrees = pairs.join(large, "u", "left").groupBy("i").agg(F.count("*").alias("a"), F.bit_or(bit).alias("mask"))
    items = materialized(degrees.withColumn("iid", F.monotonically_increasing_id()), "items")
    by_degree = _histogram(items, "a")
    n_items = int(by_degree["number"].sum())

    # k <= min(a, b), so k N >= lift a b leaves out every item in more than N / lift baskets.
    able = items.filter((F.col("a") >= min_count) & (F.col("a") * min_lift <= n_baskets))
    light = pairs.join(large, "u", "left_anti").join(able.select("i", "iid", "mask"), "i").select("u", "iid", "mask")
    cells = in_blocks(light, "u", "iid", sizes=sizes.withColumnRenamed("size", "__n"))
    met = cells.alias("a").join(cells.alias("b"), meeting("u", "iid")).select(F.col("a.iid").alias("ia"), F.col("b.iid").alias("ib"), F.expr("bit_count(a.mask & b.mask)").alias("h"))
    counted = met.groupBy("ia", "ib").agg(F.count("*").alias("light"), F.max("h").alias("h"))
    if len(heavy) >= min_count:
        bits = F.expr(f"filter(sequence(0, {HEAVY_BASKETS - 1}), j -> shiftrightunsigned(mask, j) % 2 != 0)")
        often = able.filter(F.expr(f"bit_count(mask) >= {min_count}")).select("iid", "mask", F.explode(F.slice(bits, min_count, HEAVY_BASKETS)).alias("bit"))
        cells = in_blocks(often, "bit", "iid")
        only = cells.alias("a").join(cells.alias("b"), meeting("bit", "iid") & F.expr(f"bit_count(a.mask & b.mask) >= {min_count}"))
        only = only.select(F.col("a.iid").alias("ia"), F.col("b.iid").alias("ib"), F.lit(0).cast("long").alias("light"), F.expr("bit_count(a.mask & b.mask)").alias("h"))
        counted = counted.unionByName(only.distinct()).groupBy("ia", "ib").agg(F.sum("light").alias("light"), F.max("h").alias("h"))
    often_enough = counted.select("ia", "ib", (F.col("light") + F.col("h")).alias("k")).filter(F.col("k") >= min_count)

    side = lambda i, n, name: able.select(F.col("iid").alias(i), F.col("a").alias(n), F.col("i").alias(name))
    named = often_enough.join(side("ia", "a", "x"), "ia").join(side("ib", "b", "y"), "ib").filter(F.col("k") * n_baskets >= min_lift * F.col("a") * F.col("b"))
    turned = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    found = named.select(pick("x", "y").alias("item_a"), pick("y", "x").alias("item_b"), "k", pick("a", "b").alias("a"), pick("b", "a").alias("b"))
    return _with_surprise(found, by_degree, by_size, n_items, n_baskets)


def _with_surprise(found: DataFrame, by_degree: pd.DataFrame, by_size: pd.DataFrame, n_items: int, n_baskets: int) -> DataFrame:
    fit_x, fit_y = fit_null(by_degree, by_size)
    place = dict(zip(by_degree["cls"].tolist(), range(len(by_degree))))
    times = by_size["number"].to_numpy(float)
    typed = found.withColumns({"n_baskets": F.lit(n_baskets).cast("long"), "lift": F.col("k") * F.lit(float(n_baskets)) / (F.col("a") * F.col("b")), "__ca": degree_class(F.col("a")), "__cb": degree_class(F.col("b"))})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in typed.schema.fields if not f.name.startswith("__")) + ", expected double, surprise double"

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int, int], tuple[float, float]] = {}
        for frame in frames:
            out = []
            for key in zip(frame["__ca"].tolist(), frame["__cb"].tolist(), frame["k"].tolist()):
                key = (min(key[:2]), max(key[:2]), key[2])
                if key not in known:
                    if len(known) > 500_000:
                        known.clear()
                    xa, xb = fit_x[place[key[0]]], fit_x[place[key[1]]]
                    p = xa * fit_y / (1 + xa * fit_y) * (xb * fit_y / (1 + xb * fit_y))
                    known[key] = float((p * times).sum()), -log_tail(p, times, key[2]) / math.log(10)
                out.append(known[key])
            values = np.array(out, dtype=float).reshape(len(out), 2)
            yield frame.drop(columns=["__ca", "__cb"]).assign(expected=values[:, 0], surprise=values[:, 1])

    scored = materialized(typed.mapInPandas(tails, schema), "pairs")
    # Benjamini-Hochberg from a histogram of the surprise, 0.01 wide and capped at 320: at most 32001 rows.
    width, top = 0.01, 32_000
    bins = scored.groupBy(F.least(F.floor(F.col("surprise") / width), F.lit(top)).cast("int").alias("bin")).count().orderBy(F.col("bin").desc()).collect()
    tested, rank, ranked = n_items * (n_items - 1) / 2, 0, []
    for row in bins:
        rank += row["count"]
        ranked.append((row["bin"], min(1.0, 10 ** (-row["bin"] * width) * tested / rank)))
    best, levels = 1.0, []
    for b, q in reversed(ranked):
        best = min(best, q)
        levels.append((b, best))
    table = F.broadcast(found.sparkSession.createDataFrame(levels, "__bin int, q_value double"))
    return scored.withColumn("__bin", F.least(F.floor(F.col("surprise") / width), F.lit(top)).cast("int")).join(table, "__bin", "left").drop("__bin")
