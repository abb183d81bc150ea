"""Content-based recommendation: TF-IDF profiles of businesses, word sets of users, cosine scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import letter_words
from tessera.session import materialized

PROFILE = 200


def word_counts(reviews: DataFrame, stop_words: DataFrame, more_than: int = 30) -> DataFrame:
    """(business_id, word, n) of words that occur more than ``more_than`` times in all and aren't stop words."""
    stop = stop_words.select(F.lower(F.trim("word")).alias("word")).distinct()
    words = reviews.filter(F.col("business_id").isNotNull()).select("business_id", F.explode(letter_words(F.col("text"))).alias("word"))
    counts = materialized(words.groupBy("business_id", "word").agg(F.count("*").alias("n")), "counts")
    kept = counts.groupBy("word").agg(F.sum("n").alias("total")).filter(F.col("total") > more_than).select("word")
    return counts.join(kept.join(stop, "word", "left_anti"), "word")


def doc_frequency(counts: DataFrame) -> DataFrame:
    """(word, df): in how many businesses' texts each word is found."""
    return counts.groupBy("word").agg(F.count("*").alias("df"))


def business_profiles(counts: DataFrame, size: int = PROFILE) -> DataFrame:
    """(business_id, word, weight): the ``size`` words with the largest n / max n * log2(N / df); ties by word."""
    counts = materialized(counts, "kept")
    largest = counts.groupBy("business_id").agg(F.max("n").alias("most"))
    n = counts.select(F.count_distinct("business_id").alias("businesses"))
    weighted = counts.join(doc_frequency(counts), "word").join(largest, "business_id").crossJoin(F.broadcast(n))  # n is one row
    weighted = weighted.withColumn("weight", F.round(F.col("n") / F.col("most") * F.log2(F.col("businesses") / F.col("df")), 9))
    best = Window.partitionBy("business_id").orderBy(F.col("weight").desc(), "word")
    return weighted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).select("business_id", "word", "weight")


def user_profiles(reviews: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, word): the profile words a user has ever used.

    A text's repeated words and all words of no profile are gone before anything is shuffled by user.
    """
    words = reviews.filter(F.col("user_id").isNotNull()).select("user_id", F.explode(F.array_distinct(letter_words(F.col("text")))).alias("word"))
    return materialized(words.join(profiles.select("word").distinct(), "word", "left_semi").distinct(), "users")


def user_term_weights(reviews: DataFrame, profiles: DataFrame, size: int = 300) -> DataFrame:
    """(user_id, word, weight): of each user the ``size`` profile words used most, with their share of all profile words used; ties by word."""
    words = reviews.filter(F.col("user_id").isNotNull()).select("user_id", F.explode(letter_words(F.col("text"))).alias("word"))
    counts = words.join(profiles.select("word").distinct(), "word", "left_semi").groupBy("user_id", "word").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "word")
    used = F.sum("n").over(Window.partitionBy("user_id"))
    ranked = counts.withColumns({"rank": F.row_number().over(by_count), "weight": F.round(F.col("n") / used, 9)})
    return ranked.filter(F.col("rank") <= size).select("user_id", "word", "weight")


def cosine_scores(pairs: DataFrame, users: DataFrame, profiles: DataFrame, size: int = PROFILE, least: float = 0.01) -> DataFrame:
    """(user_id, business_id, score) of pairs with common words / sqrt(size) / sqrt(words of the user) >= ``least``.

    The pairs are extended by the business's words (at most ``size``) and these looked up among
    the user's, so that a user with very many words isn't written out per pair.
    """
    wanted = pairs.select("user_id", "business_id").dropna().distinct()
    shared = wanted.join(profiles.select("business_id", "word"), "business_id").join(users, ["user_id", "word"], "left_semi")
    common = shared.groupBy("user_id", "business_id").agg(F.count("*").alias("common"))
    used = users.groupBy("user_id").agg(F.count("*").alias("used"))
    score = F.round(F.col("common") / F.sqrt(F.lit(float(size))) / F.sqrt(F.col("used").cast("double")), 6)
    return common.join(used, "user_id").withColumn("score", score).filter(F.col("score") >= least).select("user_id", "business_id", "score")
