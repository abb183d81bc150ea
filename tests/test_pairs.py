import math
import random
import time
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from tessera.operators import itemsets, recommend, similarity
from tessera.operators.common_pairs import in_blocks, pairs_in_common


def baskets_with_a_hot_one(seed):
    rng = random.Random(seed)
    rows = {(u, rng.randrange(25)) for u in range(40) for _ in range(rng.randrange(1, 7))}
    return sorted(rows | {(99, i) for i in range(25)} | {(98, i) for i in range(0, 25, 2)})


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_pairs_in_common(spark, least):
    rows = baskets_with_a_hot_one(least)
    held = {}
    for u, i in rows:
        held.setdefault(u, []).append(i)
    count = Counter(p for items in held.values() for p in combinations(sorted(items), 2))
    out = pairs_in_common(spark.createDataFrame([*rows, (None, 1), (1, None)], "u int, i int"), "u", "i", least)
    assert {(r["key_a"], r["key_b"]): r["n"] for r in out.collect()} == {p: n for p, n in count.items() if n >= least}


def test_repeated_ratings_meet_each_time(spark):
    rows = [("h", i, 3.0 + i % 2) for i in range(6)] + [("h", 0, 1.0), ("h", 0, 2.0), ("h", 1, 5.0), ("g", 4, 1.0), ("g", 5, 2.0), ("k", 4, 4.0), ("k", 5, 5.0)]
    ratings = spark.createDataFrame(rows, "user_id string, business_id int, stars double")
    expected = {}
    for a, b in combinations(range(6), 2):
        xs = [(x, y) for u, i, x in rows for v, j, y in rows if u == v and i == a and j == b]
        if len(xs) >= 3:
            n, mx, my = len(xs), sum(x for x, _ in xs) / len(xs), sum(y for _, y in xs) / len(xs)
            vx, vy = sum((x - mx) ** 2 for x, _ in xs), sum((y - my) ** 2 for _, y in xs)
            if vx > 1e-9 and vy > 1e-9 and (s := sum((x - mx) * (y - my) for x, y in xs) / math.sqrt(vx * vy)) > 1e-12:
                expected[b, a] = round(s, 9)
    assert {(r["b1"], r["b2"]): r["sim"] for r in recommend.item_model(ratings).collect()} == pytest.approx(expected)


def test_constant_rater_has_no_similarity(spark):
    rows = [("u", i, float(i % 5 + 1)) for i in range(4)] + [("v", i, 3.0) for i in range(4)] + [("w", i, float(i % 5 + 1)) for i in range(4)]
    model = recommend.user_model(spark.createDataFrame(rows, "user_id string, business_id int, stars double"))
    assert [tuple(r) for r in model.collect()] == [("u", "w", 1.0)]


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_itemsets_equal_fpgrowth(spark, size):
    rows = itemsets.baskets(spark.createDataFrame(baskets_with_a_hot_one(7) * 2, "basket int, item int"), "basket", "item")
    lists = rows.groupBy("basket").agg(F.collect_set("item").alias("items"))
    known = FPGrowth(minSupport=2.5 / lists.count(), itemsCol="items").fit(lists).freqItemsets
    expected = {tuple(sorted(r["items"])): r["freq"] for r in known.collect() if len(r["items"]) == size}
    found = {tuple(r["items"]): r["support"] for r in itemsets.frequent_itemsets(rows, 3, size).collect()}
    assert found == expected


def test_small_baskets_are_left_out(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "c")], "b int, i string")
    assert sorted(r["basket"] for r in itemsets.baskets(rows, "b", "i", 2).collect()) == [3, 3, 3]
    assert itemsets.all_frequent_itemsets(itemsets.baskets(rows, "b", "i"), 9).collect() == []


@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_jaccard_pairs(spark, threshold):
    sets = {}
    for u, i in baskets_with_a_hot_one(3):
        sets.setdefault(u, set()).add(i)
    expected = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    rows = spark.createDataFrame([(u, i) for u, s in sets.items() for i in s], "u int, i int")
    assert {(r["key_a"], r["key_b"]) for r in similarity.jaccard_pairs(rows, "u", "i", threshold).collect()} == expected


def test_minhash_finds_no_false_pairs_and_all_copies(spark):
    rows = spark.createDataFrame([(k, f"u{i}") for k in range(8) for i in range(k // 4 * 10, k // 4 * 10 + 6)], "k int, u string")
    found = similarity.lsh_pairs(rows, "k", "u", 0.9, similarity.hash_constants(10), 2)
    assert {(r["key_a"], r["key_b"]) for r in found.collect()} == {(0, 1), (0, 2), (0, 3), (4, 5), (4, 6), (4, 7)}


def test_equal_signatures_of_different_sets_keep_their_pairs(spark):
    base = range(300)
    sets = {0: base, 1: base, 2: base[:-1], 3: base[1:], 4: [*base, 300], 5: [*base, 300], 6: base[:150], 7: [*base[:150], 400], 8: range(500, 510)}
    rows = spark.createDataFrame([(k, f"u{i}") for k, s in sets.items() for i in s], "k int, u string")
    signed = similarity.minhash_signatures(rows, "k", "u", similarity.hash_constants(4))
    signatures = {tuple(r)[1:]: r["k"] for r in signed.collect()}
    assert len(signatures) < len({tuple(s) for s in sets.values()})  # some differ and look alike
    con = duckdb.connect()
    con.execute("CREATE TABLE s (k INT, h0 BIGINT, h1 BIGINT, h2 BIGINT, h3 BIGINT)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?, ?)", [list(r) for r in signed.collect()])
    sql = "SELECT x.k, y.k FROM s x JOIN s y ON x.k < y.k AND ((x.h0 = y.h0 AND x.h1 = y.h1) OR (x.h2 = y.h2 AND x.h3 = y.h3))"
    expected = sorted(con.execute(sql).fetchall())
    assert sorted(map(tuple, similarity.lsh_candidates(signed, "k", 2, 2).collect())) == expected
    copies = similarity.equal_sets(rows, "k", "u")
    assert {r["k"]: r["head"] for r in copies.collect()} == {k: min(j for j in sets if set(sets[j]) == set(sets[k])) for k in sets}
    assert sorted(map(tuple, similarity.with_copies(similarity.lsh_candidates(signed, "k", 2, 2, copies), copies, "k").collect())) == expected
    jaccard = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    found = similarity.with_copies(similarity.lsh_pairs(rows, "k", "u", 0.4, similarity.hash_constants(4), 2, copies), copies, "k")
    assert {(r["key_a"], r["key_b"]): r["similarity"] for r in found.collect()} == {p: jaccard(*p) for p in expected if jaccard(*p) >= 0.4}


def test_itemsets_of_more_than_ten_items(spark):
    rows = spark.createDataFrame([(b, i) for b in range(3) for i in range(11)] + [(9, 0), (9, 77)], "basket int, item int")
    found = itemsets.all_frequent_itemsets(rows, 3).groupBy("size").agg(F.count("*").alias("sets"), F.max("support").alias("most")).collect()
    assert {r["size"]: (r["sets"], r["most"]) for r in found} == {k: (math.comb(11, k), 4 if k == 1 else 3) for k in range(1, 12)}


@pytest.mark.parametrize("block", [1, 3, 7, 10_000])
@pytest.mark.parametrize("least", [1, 2, 4])
def test_pairs_in_blocks(spark, least, block):
    rows = sorted({(g, k) for g, n in ((0, 25), (1, 24), (2, 23), (3, 9), (4, 2), (5, 1)) for k in range(n)})
    count = Counter(p for g in range(6) for p in combinations([k for h, k in rows if h == g], 2))
    out = pairs_in_common(spark.createDataFrame(rows, "g int, k int"), "g", "k", least, block=block).collect()
    assert len(out) == len({(r["key_a"], r["key_b"]) for r in out})
    assert {(r["key_a"], r["key_b"]): r["n"] for r in out} == {p: n for p, n in count.items() if n >= least}


def test_no_key_of_the_join_has_more_than_a_block(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    cells = in_blocks(rows, "g", "k", 100).groupBy("g", "__lo", "__hi").count()
    assert cells.agg(F.max("count")).first()[0] < 400 and cells.count() == 2 * 25 * 26 / 2


def test_two_passes_find_the_frequent_sets(spark):
    rows = itemsets.baskets(spark.createDataFrame(baskets_with_a_hot_one(7), "basket int, item int"), "basket", "item")
    candidates, found = itemsets.son(rows, 6, 2)
    expected = {(tuple(r["items"]), r["support"]) for r in itemsets.all_frequent_itemsets(rows, 6).collect()}
    assert {(tuple(r["items"]), r["support"]) for r in found.collect()} == expected
    assert {s for s, _ in expected} < {tuple(r["items"]) for r in candidates.collect()}
    assert [x.count() for x in itemsets.son(rows.limit(0), 6)] == [0, 0]


def test_first_pass_does_not_try_all_pairs_of_frequent_items(spark):
    rows = spark.range(240_000).select(F.col("id").alias("basket"), (F.col("id") / 6).cast("int").alias("item"))
    began = time.time()
    candidates, found = itemsets.son(rows, 6, 2)
    assert candidates.count() == 40_000 and found.filter("support = 6").count() == 40_000
    assert time.time() - began < 60  # 8 * 10^8 pairs of frequent items took minutes
