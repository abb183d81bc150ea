import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import packed_pairs, recommend, similarity
from tessera.operators.packed_pairs import Packed
from tessera.plans import queries
from tests.conftest import DATA

BOUNDS = ((1, 0.0), (1, 0.2), (1, 0.5), (2, 0.0), (3, 0.1))


@pytest.mark.parametrize("size", [4_000_000, 5])
@pytest.mark.parametrize("block", [10_000, 15, 2])
def test_pairs_and_common_groups(spark, monkeypatch, block, size):
    monkeypatch.setattr(packed_pairs, "SLICE", size)
    rng = random.Random(1)
    rows = {(k, rng.randrange(30)) for k in range(60) for _ in range(rng.randrange(1, 7))}
    rows |= {(k, 100) for k in range(0, 60, 2)} | {(k, 101) for k in range(0, 60, 3)} | {(200, 100), (201, 100), (202, 101), (203, 100)}
    sets = defaultdict(set)
    for k, g in rows:
        sets[k].add(g)
    df = spark.createDataFrame([*sorted(rows), (None, 1), (1, None)], "k int, g int")
    for least, share in BOUNDS:
        packed = Packed(df, "k", "g", 8 if share else least - 1, block)
        common = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)}
        expected = {(a, b): n for (a, b), n in common.items() if n >= least and n / len(sets[a] | sets[b]) >= share}
        found = packed.named(packed.pairs(least, share)).collect()
        assert len(found) == len(expected) and {(r["key_a"], r["key_b"]): r["n"] for r in found} == expected
        assert all((r["na"], r["nb"]) == (len(sets[r["key_a"]]), len(sets[r["key_b"]])) for r in found)
        each = packed.named(packed.common(least, share)).groupBy("key_a", "key_b").count().collect()
        assert {(r["key_a"], r["key_b"]): r["count"] for r in each} == expected


def test_no_rows(spark):
    rows = spark.createDataFrame([], "k string, g string")
    assert Packed(rows, "k", "g").pairs(1, 0.1).count() == 0
    assert similarity.lsh_pairs(rows, "k", "g", 0.1, similarity.hash_constants(4), 2).count() == 0


def moved(spark, df):
    """MB written to shuffles by ``df``, a function that makes the rows, and their number."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    n = df().count()
    return sum(b for s, b in written().items() if s not in before) / 1e6, n


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 businesses that share one user, with eight users each that two share with the next."""
    own = spark.range(3000).select(F.concat(F.lit("b"), "id").alias("business_id"), F.explode(F.sequence(F.col("id") * 6, F.col("id") * 6 + 7)).alias("u"))
    rows = own.select(F.concat(F.lit("u"), F.col("u")).alias("user_id"), "business_id")
    return rows.unionByName(rows.select(F.lit("hot").alias("user_id"), "business_id").distinct()).cache()


def test_jaccard_writes_no_pairs_of_a_hot_item(spark, hot):
    mb, n = moved(spark, lambda: similarity.jaccard_pairs(hot, "business_id", "user_id", 0.1))
    assert n == 2999 and mb < 10


def test_lsh_writes_no_candidates_of_a_hot_item(spark, hot):
    mb, n = moved(spark, lambda: similarity.lsh_pairs(hot, "business_id", "user_id", 0.05, similarity.hash_constants(20)))
    assert 2700 < n <= 4498500 and mb < 40


def test_pearson_writes_no_pairs_of_a_hot_user_that_rates_twice(spark, hot):
    stars = hot.withColumn("stars", F.pmod(F.xxhash64("user_id", "business_id"), F.lit(5)) + 1.0)
    twice = stars.filter("user_id = 'hot'").withColumn("stars", F.lit(5.0))
    mb, n = moved(spark, lambda: recommend.item_model(stars.unionByName(twice).unionByName(twice)))
    assert 0 < n <= 2999 and mb < 10


def test_a_list_is_moved_once_to_a_task(spark):
    """3,000 users with ten of 30 businesses each: 15 million pairs of users meet; with a list for each user 6.6 MB were moved."""
    own = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("b"), "id")
    rows = own.filter(F.pmod(F.xxhash64("id", "b"), F.lit(3)) == 0).select("user_id", F.concat(F.lit("b"), F.col("b")).alias("business_id"), F.pmod(F.xxhash64("b", "id"), F.lit(5)) + 1.0)
    mb, n = moved(spark, lambda: recommend.user_model(rows.toDF("user_id", "business_id", "stars").cache(), min_jaccard=0.75))
    assert 0 < n < 2000 and mb < 3


@pytest.mark.parametrize("ways, most", [(1, 1), (3, 200), (24, 32_000_000)])
def test_any_number_of_tasks_gives_all_pairs(spark, monkeypatch, ways, most):
    for name, value in (("PAIRS", 50), ("WAYS", ways), ("MOST", most), ("SLICE", 40)):
        monkeypatch.setattr(packed_pairs, name, value)
    rng = random.Random(2)
    rows = {(k, rng.randrange(12)) for k in range(50) for _ in range(4)}
    sets = defaultdict(set)
    for k, g in rows:
        sets[k].add(g)
    expected = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) > 1}
    packed = Packed(spark.createDataFrame(sorted(rows), "k int, g int"), "k", "g", 0)
    found = packed.named(packed.pairs(2)).collect()
    assert len(found) == len(expected) and {(r["key_a"], r["key_b"]): r["n"] for r in found} == expected


@pytest.mark.parametrize("query", ["predict_user"])
def test_predictions_clean_the_reviews_once(spark, monkeypatch, query):
    calls, plain = [], queries._ratings
    monkeypatch.setattr(queries, "_ratings", lambda *a: calls.append(a) or plain(*a))
    assert queries.QUERIES[query](spark, DATA).count() >= 0 and len(calls) == 1
