"""Collaborative filtering: Pearson models of items and users, and predictions from the nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common_pairs import LARGEST
from tessera.operators.packed_pairs import Packed
from tessera.session import materialized


def _pearson(ratings: DataFrame, key: str, other: str, min_common: int, least: int = 2, share: float = 0.0) -> DataFrame:
    """(key_a, key_b, n, sim): Pearson correlation over common ratings, where it is positive.

    A user who rated a business more than once meets another rating each time; repeated ratings
    are summed per (user, business) first and count by the product of their numbers. Pairs that share
    one user or business only have a correlation of zero, however often its ratings are repeated: every
    rating of one side meets every one of the other. So ``least`` is at least 2; it and ``share`` are the
    number and Jaccard share of the common users or businesses, those without stars among them.
    """
    r = F.when(~F.isnan("stars"), F.col("stars")).alias("r")
    cells = ratings.select("user_id", "business_id", F.col("stars").cast("double").alias("stars")).select("user_id", "business_id", r)
    cells = cells.groupBy("user_id", "business_id").agg(F.count("r").alias("c"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("q"))
    packed = Packed(cells, key, other, LARGEST if share else least - 1)
    side = lambda x: packed.cells.select(F.col("id").alias(x), "g", *[F.col(k).alias(f"{x}_{k}") for k in "csq"])
    met = packed.common(max(least, 2), share).join(side("a"), ["a", "g"]).join(side("b"), ["b", "g"])
    sums = {"n": "a_c * b_c", "sx": "a_s * b_c", "sy": "a_c * b_s", "sxy": "a_s * b_s", "sxx": "a_q * b_c", "syy": "a_c * b_q"}
    met = met.groupBy("a", "b").agg(*[F.sum(F.expr(e)).alias(k) for k, e in sums.items()]).filter(F.col("n") >= min_common)
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    # a side without variance has no correlation: the division then gives null, which no comparison keeps
    sim = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx * vy))
    met = met.filter((vx > 1e-9) & (vy > 1e-9)).withColumn("sim", F.round(sim, 9)).filter(F.col("sim") > 0)
    return packed.named(met.select("a", "b", "n", "sim")).select("key_a", "key_b", "n", "sim")


def item_model(ratings: DataFrame, min_common: int = 3) -> DataFrame:
    """(b1, b2, sim) with b1 > b2: businesses with at least ``min_common`` common ratings and a positive correlation."""
    return _pearson(ratings.select("user_id", "business_id", "stars").dropna(), "business_id", "user_id", min_common).select(F.col("key_b").alias("b1"), F.col("key_a").alias("b2"), "sim")


def user_model(ratings: DataFrame, min_common: int = 3, min_jaccard: float = 0.01) -> DataFrame:
    """(u1, u2, sim) with u1 < u2: users with enough common businesses, by number and Jaccard share, and a positive correlation."""
    return _pearson(ratings, "user_id", "business_id", min_common, min_common, min_jaccard).select(F.col("key_a").alias("u1"), F.col("key_b").alias("u2"), "sim")


def _cells(ratings: DataFrame) -> DataFrame:
    """One rating per (user, business): the mean of repeated ones."""
    return ratings.select("user_id", "business_id", "stars").dropna().groupBy("user_id", "business_id").agg(F.avg("stars").alias("stars"))


def predict_by_items(pairs: DataFrame, ratings: DataFrame, model: DataFrame, neighbours: int = 5) -> DataFrame:
    """(user_id, business_id, stars) of the pairs for which the user rated a similar business.

    The best ``neighbours`` by similarity (ties: smaller id) give the weighted mean p; with T
    ratings of the user, f = neighbours found / T and the user's mean m, the answer is
    p f + m (1 - f). Pairs without a neighbour have no row.
    """
    cells, model, wanted = materialized(_cells(ratings), "cells"), materialized(model, "model"), pairs.select("user_id", "business_id").dropna().distinct()
    means = cells.groupBy("user_id").agg(F.avg("stars").alias("m"), F.count("*").alias("t"))
    both = model.select(F.col("b1").alias("business_id"), F.col("b2").alias("other"), "sim").unionByName(model.select(F.col("b2").alias("business_id"), F.col("b1").alias("other"), "sim"))
    near = wanted.join(both, "business_id").join(cells.select("user_id", F.col("business_id").alias("other"), "stars"), ["user_id", "other"])
    best = Window.partitionBy("user_id", "business_id").orderBy(F.col("sim").desc(), "other")
    top = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= neighbours)
    p = top.groupBy("user_id", "business_id").agg((F.sum(F.col("sim") * F.col("stars")) / F.sum("sim")).alias("p"), F.count("*").alias("k"))
    f = F.col("k") / F.col("t")
    return p.join(means, "user_id").select("user_id", "business_id", F.round(F.col("p") * f + F.col("m") * (1 - f), 6).alias("stars"))


def predict_by_users(pairs: DataFrame, ratings: DataFrame, model: DataFrame, neighbours: int = 5) -> DataFrame:
    """(user_id, business_id, stars) of the pairs for which a similar user rated the business.

    The answer is the user's mean plus min(1, g) times the weighted mean of the best neighbours'
    deviations from their own means, with g = log2(users / ratings of the business) / log2(1000).
    Users without ratings have no mean, and so no row.
    """
    cells, model, wanted = materialized(_cells(ratings), "cells"), materialized(model, "model"), pairs.select("user_id", "business_id").dropna().distinct()
    means = cells.groupBy("user_id").agg(F.avg("stars").alias("m"))
    users = cells.agg(F.count_distinct("user_id").alias("users"))
    heard = cells.groupBy("business_id").agg(F.count("*").alias("ratings"))
    both = model.select(F.col("u1").alias("user_id"), F.col("u2").alias("other"), "sim").unionByName(model.select(F.col("u2").alias("user_id"), F.col("u1").alias("other"), "sim"))
    theirs = cells.join(means, "user_id").select(F.col("user_id").alias("other"), "business_id", (F.col("stars") - F.col("m")).alias("d"))
    near = wanted.join(both, "user_id").join(theirs, ["other", "business_id"])
    best = Window.partitionBy("user_id", "business_id").orderBy(F.col("sim").desc(), "other")
    top = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= neighbours)
    p = top.groupBy("user_id", "business_id").agg((F.sum(F.col("sim") * F.col("d")) / F.sum("sim")).alias("p"))
    g = F.log2(F.col("users") / F.col("ratings")) / math.log2(1000)
    out = p.join(means, "user_id").join(heard, "business_id").crossJoin(F.broadcast(users))  # users is one row
    return out.select("user_id", "business_id", F.round(F.col("m") + F.col("p") * F.least(F.lit(1.0), g), 6).alias("stars"))
