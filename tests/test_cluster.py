import numpy as np
from pyspark.sql import functions as F

from tessera.operators import cluster


def blobs(spark, per=60, far=3):
    rng = np.random.default_rng(5)
    rows = [(f"p{c}_{i}", (np.array([c * 50.0, -c * 30.0, c]) + rng.normal(size=3)).tolist()) for c in range(3) for i in range(per)]
    rows += [(f"o{i}", [9999.0 + 777 * i, -5000.0 * (i + 1), 3.0]) for i in range(far)]
    return spark.createDataFrame(rows, "id string, features array<double>")


def test_kmeans_separates_blobs(spark):
    points = blobs(spark, far=0)
    found = cluster.assign(points, cluster.kmeans(points, 3))
    truth = found.withColumn("blob", F.substring("id", 2, 1))
    assert cluster.nmi(truth, "cluster", "blob").first()["nmi"] == 1.0


def test_bfr_keeps_all_points_and_marks_outliers(spark):
    points = blobs(spark, per=200).withColumn("chunk", F.pmod(F.hash("id"), F.lit(3)))
    out = cluster.bfr([points.filter(F.col("chunk") == i) for i in range(3)], 3)
    sizes = [points.filter(F.col("chunk") <= i).count() for i in range(3)]
    assert [r[2] + r[4] + r[5] for r in out.rounds] == sizes
    labels = {r["id"]: r["cluster"] for r in out.points.collect()}
    assert len(labels) == out.points.count() == points.count()
    assert all(labels[f"o{i}"] == -1 for i in range(3))
    for c in range(3):
        own = {labels[f"p{c}_{i}"] for i in range(200)} - {-1}
        assert len(own) == 1


def test_identical_points_have_no_spread(spark):
    points = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id int, features array<double>")
    held = cluster.summaries(cluster.assign(points, np.array([[1.0, 2.0]])))
    near = cluster.mahalanobis_assign(points, {"DS": [held[0]]}, 2.0)
    assert {(r["kind"], r["cluster"]) for r in near.collect()} == {("DS", 0)}


def test_nmi_of_independent_labels(spark):
    df = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(8)], "u int, v int")
    assert cluster.nmi(df, "u", "v").first()["nmi"] == 0.0
    assert cluster.nmi(df.withColumn("u", F.lit(1)).withColumn("v", F.lit(1)), "u", "v").first()["nmi"] == 1.0


def test_no_points(spark):
    none = spark.createDataFrame([], "id int, features array<double>")
    assert cluster.assign(none, cluster.kmeans(none, 3)).collect() == []


def test_kmeans_equals_plain_rounds(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5)) + 3 * rng.integers(0, 4, size=(400, 1))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>").repartition(7)
    centres = x[:6].copy()
    found = cluster.kmeans(points, 6, centres, rounds=5, tolerance=0.0)
    for _ in range(5):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == c].mean(axis=0) for c in range(6)])
    assert np.allclose(found, centres)


def test_bfr_over_many_chunks(spark):
    """Six chunks of overlapping sizes: 8 groups, a small one that only comes later, and noise far from all."""
    rng = np.random.default_rng(12)
    where = rng.uniform(-400, 400, size=(9, 4))
    rows = [(f"p{c}_{i}", (where[c] + rng.normal(size=4) * (1 + c % 3)).tolist(), i % 6 if c < 8 else 3 + i % 3) for c in range(9) for i in range(150 if c < 8 else 60)]
    rows += [(f"o{i}", (rng.choice([-1, 1], size=4) * rng.uniform(5000, 90000, size=4)).tolist(), i % 6) for i in range(12)]
    points = spark.createDataFrame(rows, "id string, features array<double>, chunk int")
    out = cluster.bfr((points.filter(F.col("chunk") == i) for i in range(6)), 8)
    sizes = [sum(r[2] <= i for r in rows) for i in range(6)]
    assert [r[2] + r[4] + r[5] for r in out.rounds] == sizes and [r[0] for r in out.rounds] == [1, 2, 3, 4, 5, 6]
    labels = {r["id"]: r["cluster"] for r in out.points.collect()}
    assert len(labels) == out.points.count() == len(rows)
    assert all(labels[f"o{i}"] == -1 for i in range(12))
    known = spark.createDataFrame([(i.split("_")[0], c) for i, c in labels.items() if i[0] == "p" and not i.startswith("p8") and c >= 0], "u string, v int")
    assert known.count() >= 0.7 * 1200 and cluster.nmi(known, "u", "v").first()["nmi"] > 0.9


def test_bfr_without_points(spark):
    none = spark.createDataFrame([], "id int, features array<double>")
    assert cluster.bfr([none], 3).points.collect() == [] and cluster.bfr([none], 3).rounds == []
