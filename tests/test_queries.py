import numpy as np
import pytest

import __spark_entry__
from tessera.plans import oracle, queries
from tessera.streaming import reservoir
from tests.test_graph import brute_force_communities


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_sql(name, same):
    same(queries.QUERIES[name], oracle.ORACLE[name])


SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_partitions(spark, duck):
    reviews = spark.read.parquet(f"{SMALL}/train_review.parquet").count()
    assert queries.partition_count(spark, SMALL).first()["partitions"] >= 1
    for name, most in (("partition_sizes", 10_000), ("partition_sizes_by_business", 27), ("partition_sizes_in_turn", 15)):
        rows = queries.QUERIES[name](spark, SMALL).collect()
        assert sum(r["rows"] for r in rows) == reviews and len(rows) == len({r["partition"] for r in rows}) <= most
    assert max(r["rows"] for r in rows) - min(r["rows"] for r in rows) <= 15


def test_communities_equal_brute_force(spark, duck):
    edges = [(r["src"], r["dst"]) for r in queries.cooccurrence_edges(spark, NEXT).collect()]
    parts = {}
    for r in queries.girvan_newman(spark, NEXT).collect():
        parts.setdefault(r["component"], set()).add(r["node"])
    assert len(edges) > 50 and set(map(frozenset, parts.values())) == brute_force_communities(edges)


def test_clusters_hold_all_points(spark, duck):
    points = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    found = {r["id"]: r["cluster"] for r in queries.kmeans_clusters(spark, SMALL).collect()}
    assert found.keys() == points.keys()
    means = {c: np.mean([points[i] for i in found if found[i] == c], axis=0) for c in set(found.values())}
    nearest = {i: min(means, key=lambda c: float(((x - means[c]) ** 2).sum())) for i, x in points.items()}
    assert len(means) == queries.CLUSTERS and sum(nearest[i] == found[i] for i in points) >= 0.97 * len(points)
    labels = queries.bfr_clusters(spark, SMALL).collect()
    assert sorted(r["id"] for r in labels) == sorted(points)
    last = max(queries.bfr_rounds(spark, SMALL).collect(), key=lambda r: r["round"])
    assert last["round"] == queries.CHUNKS and last["discard_points"] + last["compressed_points"] + last["retained_points"] == len(points)


def test_stream_of_posts_equals_a_replay(spark, duck):
    posts = spark.read.parquet(f"{SMALL}/tag_stream.parquet").select("hashtags", "posted_at").collect()
    tagged = [([h["text"] for h in r["hashtags"]], r["posted_at"]) for r in posts if r["hashtags"]]
    assert all(at is not None for _, at in tagged)
    own = reservoir.Reservoir(100, 1)
    for tags, _ in sorted(tagged, key=lambda r: (r[1], "\0".join(t or "" for t in r[0]))):
        own.offer(tags)
    assert sorted((r["n"], r["tag"], r["count"]) for r in queries.reservoir_stream(spark, SMALL).collect()) == sorted((own.n, t, n) for t, n in reservoir.trending(own.counts()))


def test_every_query_is_tested():
    by_hand = {"partition_count", "partition_sizes", "partition_sizes_by_business", "partition_sizes_in_turn", "girvan_newman", "kmeans_clusters", "bfr_clusters", "bfr_rounds", "reservoir_stream"}
    assert set(queries.QUERIES) - set(oracle.ORACLE) == by_hand


def test_entry(spark, duck):
    assert __spark_entry__.entry(spark).columns == ["category", "stars"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
