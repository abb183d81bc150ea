import math
import random
from collections import Counter
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest

from tessera.llm import overlap, pairing


def random_sets(seed, n=60):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        base = sets[rng.choice(list(sets))] if sets and rng.random() < 0.6 else set()
        own = {x for x in base if rng.random() < 0.9} | {rng.randrange(80) for _ in range(rng.randrange(0 if base else 1, 6))} | ({999} if rng.random() < 0.7 else set())
        sets[f"r{i:03}"] = own or {1}
    sets["hot"] = set(range(80))
    sets["copy1"] = sets["copy2"] = set(sets["r003"])
    return sets


def table(spark, sets):
    return spark.createDataFrame([(k, f"v{x}", 0) for k, s in sets.items() for x in s], "k string, v string, size int")


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold,least", [(0.3, 1), (0.5, 5), (0.8, 1), (1.0, 1)])
def test_all_similar_pairs(spark, threshold, least):
    sets = random_sets(int(threshold * 100))
    able = {k: s for k, s in sets.items() if len(s) >= least}
    expected = {(a, b) for a, b in combinations(sorted(able), 2) if jaccard(able[a], able[b]) >= threshold}
    found = overlap.similar_sets(table(spark, sets), "k", "v", threshold, least)
    out = [tuple(r) for r in overlap.expanded(found).collect()]
    assert len(out) == len(set(out)) and set(out) == expected
    for r in found.pairs.collect():
        a, b = sets[r["key_a"]], sets[r["key_b"]]
        assert (r["overlap"], r["size_a"], r["size_b"]) == (len(a & b), len(a), len(b))
    classes = {r["key"]: r["representative"] for r in found.classes.collect()}
    assert set(classes) == set(able) and all(sets[k] == sets[h] for k, h in classes.items())


def test_between_two_tables(spark):
    left, right = random_sets(4, 30), random_sets(5, 30)
    found = overlap.similar_sets(table(spark, left), "k", "v", 0.4, right=table(spark, right))
    heads = {(r["side"], r["key"]): r["representative"] for r in found.classes.collect()}
    pairs = {(r["key_a"], r["key_b"]) for r in found.pairs.collect()}
    assert {(a, b) for a, b in product(left, right) if jaccard(left[a], right[b]) >= 0.4} == {(a, b) for a, b in product(left, right) if (heads[0, a], heads[1, b]) in pairs}


def test_frequent_values_are_joined_in_combination(spark):
    rng = random.Random(9)  # few values, so that most are frequent for sets of this size
    sets = {f"r{i:03}": set(rng.sample(range(12), rng.randrange(2, 6))) for i in range(150)}
    expected = {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.6}
    assert {tuple(r) for r in overlap.expanded(overlap.similar_sets(table(spark, sets), "k", "v", 0.6)).collect()} == expected


def test_bands_hold_similar_sizes():
    for t in (0.3, 0.5, 0.8, 0.95, 1.0):
        bounds = overlap.size_bands(t, 400)
        band = lambda n: sum(b <= n for b in bounds)  # noqa: E731, B023
        assert all(band(m) - band(n) <= 1 for n in range(1, 400) for m in range(n, min(400, math.floor(n / t + 1e-9)) + 1))


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("b", None), ("c", "x")], "k string, v string")
    assert [tuple(r) for r in overlap.expanded(overlap.similar_sets(df, "k", "v", 0.5)).collect()] == [("a", "c")]
    assert overlap.expanded(overlap.similar_sets(df.limit(0), "k", "v", 0.5)).collect() == []
    assert pairing.cooccurring(df.limit(0), "k", "v").collect() == []


@pytest.mark.parametrize("floor", [3, 12, 10_000])
def test_counts_with_large_baskets(spark, floor):
    rng = random.Random(11)
    rows = {(f"u{u}", f"i{rng.randrange(30):02}") for u in range(80) for _ in range(rng.randrange(1, 6))}
    rows |= {(f"big{b}", f"i{i:02}") for b in range(7) for i in range(30) if rng.random() < 0.8}
    held = {}
    for u, i in rows:
        held.setdefault(u, set()).add(i)
    count, single = Counter(p for s in held.values() for p in combinations(sorted(s), 2)), Counter(i for _, i in rows)
    df = spark.createDataFrame([*rows, *rows, (None, "i00"), ("u1", None)], "u string, i string")
    out = pairing.cooccurring(df, "u", "i", min_count=5, min_lift=1.1, heavy_floor=floor)
    n = len(held)
    expected = {(a, b): (k, single[a], single[b]) for (a, b), k in count.items() if k >= 5 and k * n >= 1.1 * single[a] * single[b]}
    assert {(r["item_a"], r["item_b"]): (r["k"], r["a"], r["b"]) for r in out.collect()} == expected
    assert all(0 <= r["q_value"] <= 1 and r["surprise"] >= 0 and r["n_baskets"] == n for r in out.collect())


def test_tails_equal_the_exact_distribution():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p, times = rng.random(6) ** 3, rng.integers(1, 30, 6)
        exact = np.array([1.0])
        for x, m in zip(p, times):
            for _ in range(m):
                exact = np.convolve(exact, [1 - x, x])
        for k in (1, 3, 10, int(times.sum() * 0.8), int(times.sum())):
            assert pairing.log_tail(p, times.astype(float), k) == pytest.approx(math.log(exact[k:].sum()), rel=1e-6, abs=1e-9)
    assert pairing.log_tail(np.array([1e-6]), np.array([1e6]), 40) == pytest.approx(math.log(sum(math.exp(-1 - math.lgamma(j + 1)) for j in range(40, 80))), rel=1e-3)


@pytest.mark.parametrize("sizes,close", [({1: 14, 3: 3}, 1e-6), ({1: 5, 3: 1, 5: 3}, 1e-2)])
def test_null_model_keeps_degrees(sizes, close):
    """In the second case an item is in all 9 baskets: its fitness is unbounded and only approached."""
    items = pd.DataFrame({"cls": [1, 2, 9], "degree": [1.0, 2.0, 9.0], "number": [6, 4, 1]})
    baskets = pd.DataFrame({"cls": list(sizes), "degree": [float(d) for d in sizes], "number": list(sizes.values())})
    x, y = pairing.fit_null(items, baskets)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert (p * baskets["number"].to_numpy()).sum(axis=1) == pytest.approx(items["degree"].to_numpy(), rel=close)
    assert (p * items["number"].to_numpy()[:, None]).sum(axis=0) == pytest.approx(baskets["degree"].to_numpy(), rel=close)


@pytest.mark.parametrize("lengths", [(2,), (3,), (2, 3, 5)])
def test_every_length_finds_all_pairs(spark, monkeypatch, lengths):
    monkeypatch.setattr(overlap, "LENGTHS", lengths)
    sets = random_sets(77, 50)
    expected = {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.5}
    assert {tuple(r) for r in overlap.expanded(overlap.similar_sets(table(spark, sets), "k", "v", 0.5)).collect()} == expected
