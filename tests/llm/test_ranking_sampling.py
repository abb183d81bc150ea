import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ranking, sampling


def rows_with_a_hot_group(n=3000):
    rng = random.Random(1)
    groups = ["hot"] * 5 + ["a", "b", "c", None] + [f"g{i}" for i in range(40)]
    return [(rng.choice(groups), float(rng.randrange(4)), i) for i in range(n)]


@pytest.mark.parametrize("limit", [None, 1, 3, 500])
def test_positions_equal_a_sort(spark, limit):
    rows = rows_with_a_hot_group()
    df = spark.createDataFrame(rows, "g string, s double, id long").repartition(5)
    out = ranking.with_positions(df, ["g"], [F.col("s").desc(), F.col("id").asc()], limit)
    expected, seen = set(), Counter()
    for g, s, i in sorted(rows, key=lambda r: (r[0] or "", -r[1], r[2])):
        seen[g] += 1
        if limit is None or seen[g] <= limit:
            expected.add((g, s, i, seen[g]))
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_one_group_over_all_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(F.lit("x").alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ranking.with_positions(df, ["g"], [F.col("id").desc()])
        assert {(r["id"], r["position"]) for r in out.collect()} == {(i, 1000 - i) for i in range(1000)}
        alone = ranking.with_positions(df, [], [F.col("id").asc()], name="n")
        assert {(r["id"], r["n"]) for r in alone.collect()} == {(i, i + 1) for i in range(1000)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 7), ("a", 1.0, 7), ("a", 0.5, 7), (None, 2.0, 7)], "g string, s double, position int")
    top = ranking.top_n_per_group(df, ["g"], [F.col("s").desc()], 2)
    assert sorted((r["g"] or "", r["s"], r["position"]) for r in top.collect()) == [("", 2.0, 1), ("a", 1.0, 1), ("a", 1.0, 2)]
    assert ranking.top_n_per_group(df, ["g"], [F.col("s").desc()], 0).collect() == []
    assert ranking.top_n_per_group(df.limit(0), ["g"], [F.col("s").desc()], 2).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutation(n):
    for seed in (0, 1, -5, 2**70):
        image = sampling.permute(np.arange(n), n, seed)
        assert sorted(image.tolist()) == list(range(n))
    if n > 100:
        assert sampling.permute(np.arange(n), n, 1).tolist() != sampling.permute(np.arange(n), n, 2).tolist()


def test_every_number_is_equally_likely():
    n, k, trials = 60, 12, 3000
    hits = np.zeros(n)
    for seed in range(trials):
        hits[np.flatnonzero(sampling.permute(np.arange(n), n, seed) < k)] += 1
    expected = trials * k / n
    assert ((hits - expected) ** 2 / expected).sum() < 105  # 59 degrees of freedom


def test_sample_has_k_rows_whatever_the_pieces(spark):
    df = spark.range(0, 700).withColumnRenamed("id", "x")
    draw = lambda d, k, s: {(r["x"], r["slot"]) for r in sampling.fixed_size_sample(d, k, [F.col("x")], s).collect()}
    first = draw(df.repartition(1), 50, 3)
    assert len(first) == 50 and {s for _, s in first} == set(range(50))
    assert draw(df.repartition(9), 50, 3) == first != draw(df, 50, 4)
    assert len(draw(df, 9999, 3)) == 700
    assert draw(df, 0, 3) == set() == draw(df.limit(0), 5, 3)


def test_posts(spark):
    posts = spark.sql("""SELECT * FROM VALUES
        (1L, 0, array(named_struct('text', 'a')), timestamp'2023-01-01'), (1L, 1, array(named_struct('text', 'a')), timestamp'2023-01-02'),
        (2L, 0, array(named_struct('text', cast(null as string))), timestamp'2023-01-01'), (3L, 0, null, timestamp'2023-01-01'),
        (4L, 0, array(), timestamp'2023-01-01'), (null, 0, array(named_struct('text', 'b')), timestamp'2023-01-01')
        t(post_id, chunk_no, hashtags, arrived_at)""")
    out = sampling.sample_posts(posts, 10)
    assert sorted((r["post_id"], r["chunk_no"]) for r in out.collect()) == [(1, 0), (2, 0)]


def test_nan_is_one_group(spark):
    rows = [(float("nan"), i) for i in range(40)] + [(1.0, i) for i in range(9)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g double, i int").repartition(6)
    found = ranking.with_positions(df, ["g"], [F.col("i")]).collect()
    assert len(found) == 54 and all(r["position"] == r["i"] + 1 for r in found)


def test_a_sample_too_large_to_broadcast_is_the_same(spark, monkeypatch):
    rows = [(i, 0, [(f"t{i}",)], 0) for i in range(60)]
    posts = spark.createDataFrame(rows, "post_id long, chunk_no int, hashtags array<struct<text: string>>, arrived_at long")
    expected = sorted(tuple(r)[:2] for r in sampling.sample_posts(posts, 20, 3).collect())
    monkeypatch.setattr(sampling, "BROADCAST", 5)
    assert sorted(tuple(r)[:2] for r in sampling.sample_posts(posts, 20, 3).collect()) == expected and len(expected) == 20
