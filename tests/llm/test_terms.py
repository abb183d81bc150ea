import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import frequency, weighting

WORDS = ["soup", "pie", "a", "the", "tea", "of", "zu", "ab"]


def texts(n=120):
    rng = random.Random(2)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 14))) for _ in range(n)]
    return [*out, None, "", "  12 !", "The THE the", "soup-pie's Crème", "soup " * 500]


@pytest.mark.parametrize("max_n,flush", [(1, 10**6), (1, 3), (3, 10**6), (3, 5)])
def test_counts_of_all_grams(spark, max_n, flush):
    rows = texts()
    cf, df = Counter(), Counter()
    for t in rows:
        if t is not None:
            w = re.findall("[a-z]+", t.lower())
            grams = [" ".join(w[i : i + s]) for s in range(1, max_n + 1) for i in range(len(w) - s + 1)]
            cf.update(grams)
            df.update(set(grams))
            df[""] += 1
            cf[""] += 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several partitions, so that n-grams cross their borders
    try:
        table = spark.createDataFrame([(t, 1) for t in rows], "text string, gram int").repartition(3)
        found = [tuple(r) for r in frequency.ngram_frequencies(table, "text", max_n, flush).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(found) == len({g for g, *_ in found})
    assert {(g, n, c, d) for g, n, c, d in found} == {(g, len(g.split()), cf[g], df[g]) for g in cf}


def test_marks(spark):
    df = spark.createDataFrame([("a b",), ("a c",), ("a c",), ("a c d",), ("a",), (None,)], "t string")
    marks = {r["gram"]: r["mark"] for r in frequency.marked_terms(df, "t", 1, 0.6).collect()}
    assert marks == {"a": "common", "b": "rare", "c": None, "d": "rare"}
    assert frequency.marked_terms(df.limit(0), "t").collect() == []


def reviews(n=300):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 4 + [f"b{i}" for i in range(15)]), " ".join(rng.choice([*WORDS, f"w{chr(97 + rng.randrange(9))}x"]) for _ in range(8))) for _ in range(n)]
    return [*rows, (None, "soup"), ("b1", None), ("empty", ""), ("b2", "!!")]


def expected(rows, top, min_letters, min_records, score):
    n = {}
    for b, t in rows:
        if b is not None and t is not None:
            n.setdefault(b, Counter()).update(w for w in re.findall("[a-z]+", t.lower()) if len(w) >= min_letters and w != "the")
    d = Counter(w for c in n.values() for w in c)
    n = {b: {w: k for w, k in c.items() if d[w] >= min_records} for b, c in n.items()}
    n = {b: c for b, c in n.items() if c}
    mean = sum(sum(c.values()) for c in n.values()) / len(n)
    out = {}
    for b, c in n.items():
        scored = [(-round(score(k, c, len(n), d[w], mean), 9), w) for w, k in c.items()]
        out[b] = [w for s, w in sorted(scored)[:top] if s < 0]
    return out


@pytest.mark.parametrize("large", [5, 20, 10**6])
def test_profiles_with_large_records_spread(spark, large):
    rows = reviews()
    stop = spark.createDataFrame([(" The ",), (None,), ("",)], "word string")
    df = spark.createDataFrame(rows, "b string, t string").withColumn("score", F.lit(1))
    run = lambda **k: weighting.characteristic_terms(df, "b", "t", 3, stop, 2, 2, large=large, **k)
    of = lambda out: {b: [w for _, w in sorted(ws)] for b, ws in {b: [(r["position"], r["term"]) for r in out if r["record"] == b] for b in {r["record"] for r in out}}.items()}
    classic = expected(rows, 3, 2, 2, lambda k, c, n, d, mean: k / max(c.values()) * math.log2(n / d))
    assert of(run(k1=float("inf"), b=1.0, length="max", idf="log2").collect()) == {b: w for b, w in classic.items() if w}
    bm25 = expected(rows, 3, 2, 2, lambda k, c, n, d, mean: math.log(1 + (n - d + 0.5) / (d + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)))
    assert of(run().collect()) == bm25


def test_no_texts(spark):
    none = spark.createDataFrame([], "b string, t string")
    assert weighting.characteristic_terms(none, "b", "t", 3).collect() == []


def test_counts_passed_on_early_are_summed(spark):
    rows = reviews()
    df = spark.createDataFrame(rows, "b string, t string")
    n = Counter((b, w) for b, t in rows if b is not None and t for w in re.findall("[a-z]+", t))
    for large, held in ((10**6, 1), (10**6, 7), (30, 7), (0, 10**6)):
        packed, hot = weighting.term_counts(df, "b", "t", large=large, held=held)
        found = [tuple(r) for r in weighting.unpacked(packed).unionByName(hot).collect()]
        assert len(found) == len(n) and {(b, t): k for b, t, k in found} == n
