"""The driver's tables as DataFrames, cleaned by the shared rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.reviews import first_loaded, present, valid_stars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per review with ``columns``; ids are trimmed (null if empty), stars null if not 1 to 5."""
    raw = first_loaded(table(spark, sf_dir, "train_review"), [c for c in columns if c != "review_id"])
    clean = {c: present(c) for c in ("user_id", "business_id") if c in columns}
    if "stars" in columns:
        clean["stars"] = valid_stars()
    return raw.withColumns(clean) if clean else raw


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct (user_id, business_id) of all reviews that have both.

    A review sent again repeats its pair, so ``distinct`` alone counts it once.
    """
    raw = table(spark, sf_dir, "train_review").select(present("user_id").alias("user_id"), present("business_id").alias("business_id"))
    return raw.filter(F.col("user_id").isNotNull() & F.col("business_id").isNotNull()).distinct()
