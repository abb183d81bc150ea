"""The queries pN_... over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import frequency, leakage, overlap, pairing, ranking, sampling, tokenizer, truncation, weighting
from tessera.plans.tables import pairs, reviews, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of businesses with at least 5 users each that share half of the union of their users."""
    found = overlap.similar_sets(pairs(spark, sf_dir), "business_id", "user_id", threshold=0.5, min_size=5)
    return overlap.expanded(found).select(F.col("key_a").alias("business_a"), F.col("key_b").alias("business_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 best-starred reviews of every user."""
    rated = reviews(spark, sf_dir, "review_id", "user_id", "stars").filter(F.col("user_id").isNotNull() & F.col("stars").isNotNull())
    best = ranking.top_n_per_group(rated, ["user_id"], [F.col("stars").desc(), F.col("review_id").asc()], 3)
    return best.select("user_id", "review_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the reviews that are too rare or too common to be useful."""
    terms = frequency.marked_terms(reviews(spark, sf_dir, "review_id", "text"), "text")
    return terms.filter(F.col("mark").isNotNull()).select(F.col("gram").alias("term"), "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the reviews with its occurrences, its reviews and its mark."""
    terms = frequency.marked_terms(reviews(spark, sf_dir, "review_id", "text"), "text")
    return terms.select(F.col("gram").alias("term"), "occurrences", "records", "mark")


def p3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-gram of 1 to 3 terms of the reviews with its occurrences, its reviews and its mark."""
    grams = frequency.marked_terms(reviews(spark, sf_dir, "review_id", "text"), "text", max_n=3)
    return grams.select("gram", "terms", "occurrences", "records", "mark")


def _business_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir, "review_id", "business_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most characteristic terms of every business, by the weighting's limit n / m * log2(N / d)."""
    best = weighting.characteristic_terms(
        _business_texts(spark, sf_dir), "business_id", "text", top=5, stop_words=table(spark, sf_dir, "stop_words"),
        min_letters=3, min_records=3, k1=float("inf"), b=1.0, length="max", idf="log2",
    )
    return best.select(F.col("record").alias("business_id"), "term")


def p4_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most characteristic terms of every business with k1 = 1.2 and b = 0.75."""
    best = weighting.characteristic_terms(_business_texts(spark, sf_dir), "business_id", "text", top=5, stop_words=table(spark, sf_dir, "stop_words"), min_letters=3, min_records=3)
    return best.select(F.col("record").alias("business_id"), "term", "n", "score", "position")


def _together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.cooccurring(pairs(spark, sf_dir), "user_id", "business_id", min_count=5, min_lift=12)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of businesses in at least 5 common baskets, 12 times as often as by chance."""
    return _together(spark, sf_dir).select(F.col("item_a").alias("business_a"), F.col("item_b").alias("business_b"))


def p5_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p5_found with counts, expectation, surprise and q-value."""
    rounded = {c: F.round(c, 6) for c in ("lift", "expected", "surprise")}
    return _together(spark, sf_dir).withColumns(rounded).withColumnsRenamed({"item_a": "business_a", "item_b": "business_b"})


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of 100 distinct posts with hashtags."""
    posts = sampling.sample_posts(table(spark, sf_dir, "tag_stream"), k=100, seed=20260101)
    return posts.select("post_id", "slot", F.size("hashtags").alias("n_tags"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the items."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked evaluation item with the number of documents that hold passages of it."""
    return leakage.leak_report(p9_found(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text lost its end."""
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the texts of each source are cut."""
    return truncation.truncation_by_source(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_terms, p3_ngrams, p4_found, p4_relevance, p5_found, p5_surprise, p7_sample, p8_ids, p9_found, p9_items, p10_found, p10_sources)}
