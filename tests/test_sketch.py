import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.hashing import bytes_of, linear_hash, trailing_zeros
from tessera.operators import sketch

CITIES = ["", "a", "Zürich", "São Paulo", "東京", "x" * 60, "Bivegom"]


def big(s, a, b, c):
    return (int.from_bytes(s.encode(), "big") * a + b) % c


def test_hash_equals_big_integers(spark):
    df = spark.createDataFrame([(c,) for c in CITIES], "city string")
    for a, b, c in sketch.COUNT_HASHES[:4]:
        out = {r["city"]: r["h"] for r in df.withColumn("h", linear_hash(bytes_of(F.col("city")), a, b, c)).collect()}
        assert out == {s: big(s, a, b, c) for s in CITIES}


def test_trailing_zeros(spark):
    df = spark.range(0, 17).withColumn("z", trailing_zeros(F.col("id")))
    assert {r["id"]: r["z"] for r in df.collect()} == {i: len(bin(i)) - len(bin(i).rstrip("0")) for i in range(17)}


def test_bloom_has_no_false_negatives(spark):
    known = spark.createDataFrame([(f"city{i}",) for i in range(300)] + [("",), (None,)], "city string")
    probes = spark.createDataFrame([(f"city{i}",) for i in range(0, 3000, 3)] + [("",), (None,)], "city string")
    flags = {r["city"]: r["flag"] for r in sketch.might_contain(probes, "city", sketch.bloom_filter(known, "city")).collect()}
    bits = {big(f"city{i}", a, b, c) % sketch.BITS for i in range(300) for a, b, c in sketch.BLOOM_HASHES}
    for s, flag in flags.items():
        if s:
            assert flag == all(big(s, a, b, c) % sketch.BITS in bits for a, b, c in sketch.BLOOM_HASHES)
    assert flags[""] == 1 and flags[None] == 0 and all(flags[f"city{i}"] for i in range(0, 300, 3))


@settings(max_examples=5, deadline=None)
@given(st.sets(st.text(min_size=1, max_size=8, alphabet="abcé"), min_size=1, max_size=30))
def test_distinct_estimate(spark, cities):
    ranks = [max(len(bin(v)) - len(bin(v).rstrip("0")) for v in (big(s, *h) for s in cities)) for h in sketch.COUNT_HASHES]
    expected = statistics.mean(sorted(2**r for r in ranks)[24:38])
    row = sketch.fm_distinct(spark.createDataFrame([(1, c) for c in [*cities, *cities]], "k int, c string"), ["k"], "c").first()
    assert row["distinct"] == len(cities) and abs(row["estimate"] - expected) < 1e-5
