"""Counts, rankings and averages over reviews and businesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import comma_list, punctuation_words


def review_counts(reviews: DataFrame, year: int) -> DataFrame:
    """One row: reviews in all, in ``year`` (by the first four characters of the date), and distinct users."""
    return reviews.agg(
        F.count("*").alias("reviews"),
        F.count_if(F.substring("review_date", 1, 4) == str(year)).alias("in_year"),
        F.count_distinct("user_id").alias("users"),
    )


def top_users(reviews: DataFrame, m: int) -> DataFrame:
    """The ``m`` users with the most reviews; among equals the smaller id first."""
    counts = reviews.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("reviews"))
    return counts.orderBy(F.col("reviews").desc(), "user_id").limit(m)


def top_words(reviews: DataFrame, stop_words: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words that aren't stop words, counted; among equals in order."""
    stop = stop_words.select(F.lower(F.trim("word")).alias("word")).distinct()
    words = reviews.select(F.explode(punctuation_words(F.col("text"))).alias("word")).filter(F.col("word") != "")
    counts = words.groupBy("word").agg(F.count("*").alias("n")).join(stop, "word", "left_anti")
    return counts.orderBy(F.col("n").desc(), "word").limit(n)


def _categories(business: DataFrame) -> DataFrame:
    return business.filter(F.col("categories").isNotNull()).select("business_id", F.explode(comma_list(F.col("categories"))).alias("category"))


def category_stars(business: DataFrame, reviews: DataFrame, n: int) -> DataFrame:
    """The ``n`` categories with the best mean stars: join, explode, mean, top n."""
    rated = reviews.filter(F.col("stars").isNotNull()).select("business_id", "stars")
    means = _categories(business).join(rated, "business_id").groupBy("category").agg(F.round(F.avg("stars"), 6).alias("stars"))
    return means.orderBy(F.col("stars").desc(), "category").limit(n)


def category_stars_eager(business: DataFrame, reviews: DataFrame, n: int) -> DataFrame:
    """As ``category_stars``, with the reviews summed per business before the join."""
    rated = reviews.filter(F.col("stars").isNotNull()).groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("*").alias("k"))
    means = _categories(business).join(rated, "business_id").groupBy("category").agg(F.round(F.sum("s") / F.sum("k"), 6).alias("stars"))
    return means.orderBy(F.col("stars").desc(), "category").limit(n)


def businesses_over(reviews: DataFrame, n: int) -> DataFrame:
    """Businesses with more than ``n`` reviews."""
    counts = reviews.filter(F.col("business_id").isNotNull()).groupBy("business_id").agg(F.count("*").alias("reviews"))
    return counts.filter(F.col("reviews") > n)


def partition_count(df: DataFrame) -> DataFrame:
    """One row: in how many partitions ``df`` is, empty ones too."""
    return df.sparkSession.createDataFrame([(df.rdd.getNumPartitions(),)], "partitions int")


def partition_sizes(df: DataFrame, partitions: int | None = None, *by: str) -> DataFrame:
    """Rows per partition, as read, after hash partitioning ``by`` columns into ``partitions``, or without columns in turn."""
    placed = df.repartition(partitions, *[F.col(c) for c in by]) if partitions else df
    return placed.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))


def user_business_of_state(business: DataFrame, reviews: DataFrame, state: str, of: Column | None = None) -> DataFrame:
    """(user_id, business_id) of every review of a business in ``state``."""
    there = business.filter(F.upper(F.trim(of if of is not None else F.col("state"))) == state.upper()).select("business_id").distinct()
    return reviews.join(there, "business_id", "left_semi").select("user_id", "business_id").dropna()
