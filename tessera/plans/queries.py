"""Queries of the core over the driver's tables, whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cluster, explore, graph, itemsets, profiles, recommend, similarity, sketch, split_values
from tessera.operators.reviews import first_loaded
from tessera.plans.tables import pairs, reviews, table
from tessera.session import materialized, scratch_path
from tessera.sources import readers, writers
from tessera.streaming import reservoir, windows

YEAR, TOP, OVER, STATE = 2019, 20, 30, "QA"
SUPPORT, MIN_BASKET = 5, 4
JACCARD, LSH_JACCARD, BANDS, WIDTH = 0.1, 0.3, 25, 2
W3_JACCARD, W3_HASHES = 0.05, 50  # the reference's own setting, with bands of one hash
USER_HASHES = 30
THRESHOLD = 7  # common businesses that make an edge
CLUSTERS, BFR_CLUSTERS, CHUNKS = 10, 5, 2


def _business(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return first_loaded(table(spark, sf_dir, "business"), columns, key="business_id", loaded="updated_at")


def explore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.review_counts(reviews(spark, sf_dir, "review_id", "user_id", "review_date"), YEAR)


def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_users(reviews(spark, sf_dir, "review_id", "user_id"), TOP)


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_words(reviews(spark, sf_dir, "review_id", "text"), table(spark, sf_dir, "stop_words"), TOP)


def category_avg_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.category_stars(_business(spark, sf_dir, "categories"), reviews(spark, sf_dir, "review_id", "business_id", "stars"), TOP)


def category_avg_eager(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.category_stars_eager(_business(spark, sf_dir, "categories"), reviews(spark, sf_dir, "review_id", "business_id", "stars"), TOP)


def business_over_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.businesses_over(reviews(spark, sf_dir, "review_id", "business_id"), OVER)


def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.partition_sizes(table(spark, sf_dir, "train_review"))


def partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.partition_count(table(spark, sf_dir, "train_review"))


def partition_sizes_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.partition_sizes(table(spark, sf_dir, "train_review").select("business_id"), 15)


def partition_sizes_by_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.partition_sizes(table(spark, sf_dir, "train_review").select("business_id"), 27, "business_id")


def state_user_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.user_business_of_state(_business(spark, sf_dir, "state"), reviews(spark, sf_dir, "review_id", "user_id", "business_id"), STATE)


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.baskets(pairs(spark, sf_dir), "user_id", "business_id")


def _sets(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", "items").alias("items"), "support")


def frequent_items_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(_by_user(spark, sf_dir), SUPPORT, 1))


def frequent_items_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(_by_user(spark, sf_dir), SUPPORT, 2))


def frequent_items_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(_by_user(spark, sf_dir), 3, 3))


def frequent_items_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(itemsets.baskets(pairs(spark, sf_dir), "business_id", "user_id"), SUPPORT, 2))


def frequent_items_min_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(itemsets.baskets(pairs(spark, sf_dir), "user_id", "business_id", MIN_BASKET), SUPPORT, 2))


def frequent_items_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itemsets.all_frequent_itemsets(_by_user(spark, sf_dir), SUPPORT)
    return found.groupBy("size").agg(F.count("*").alias("sets"), F.max("support").alias("most"))


def son_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent itemsets of all sizes by two passes, candidates of parts first."""
    return _sets(itemsets.son(_by_user(spark, sf_dir), SUPPORT)[1])


def _similar(df: DataFrame) -> DataFrame:
    return df.select(F.col("key_a").alias("b1"), F.col("key_b").alias("b2"), F.round("similarity", 9).alias("sim"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(similarity.jaccard_pairs(pairs(spark, sf_dir), "business_id", "user_id", JACCARD))


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.minhash_signatures(pairs(spark, sf_dir), "business_id", "user_id", similarity.hash_constants(4))


def _with_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = materialized(pairs(spark, sf_dir), "rows")
    return rows, materialized(similarity.equal_sets(rows, "business_id", "user_id"), "sets")


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sets = _with_sets(spark, sf_dir)
    signed = similarity.minhash_signatures(rows, "business_id", "user_id", similarity.hash_constants(4))
    return similarity.with_copies(similarity.lsh_candidates(signed, "business_id", 2, 2, sets), sets, "business_id")


def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sets = _with_sets(spark, sf_dir)
    found = similarity.lsh_pairs(rows, "business_id", "user_id", LSH_JACCARD, similarity.hash_constants(BANDS * WIDTH), WIDTH, sets)
    return _similar(similarity.with_copies(found, sets, "business_id"))


def jaccard_pairs_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(similarity.jaccard_pairs(pairs(spark, sf_dir), "business_id", "user_id", W3_JACCARD))


def lsh_pairs_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sets = _with_sets(spark, sf_dir)
    found = similarity.lsh_pairs(rows, "business_id", "user_id", W3_JACCARD, similarity.hash_constants(W3_HASHES), 1, sets)
    return _similar(similarity.with_copies(found, sets, "business_id"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.word_counts(reviews(spark, sf_dir, "review_id", "business_id", "text"), table(spark, sf_dir, "stop_words"))


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.doc_frequency(_words(spark, sf_dir))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.business_profiles(_words(spark, sf_dir))


def binary_user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.user_profiles(reviews(spark, sf_dir, "review_id", "user_id", "text"), tfidf_topk(spark, sf_dir))


def _test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "test_review").select(F.trim("user_id").alias("user_id"), F.trim("business_id").alias("business_id"))
    return raw.filter((F.col("user_id") != "") & (F.col("business_id") != "")).distinct()


def user_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.user_term_weights(reviews(spark, sf_dir, "review_id", "user_id", "text"), tfidf_topk(spark, sf_dir))


def cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = materialized(tfidf_topk(spark, sf_dir), "profiles")
    users = profiles.user_profiles(reviews(spark, sf_dir, "review_id", "user_id", "text"), best)
    return profiles.cosine_scores(_test_pairs(spark, sf_dir), users, best)


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir, "review_id", "user_id", "business_id", "stars").dropna()


def _ratings_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings as a table, for a model and the predictions from it."""
    return materialized(_ratings(spark, sf_dir).select("user_id", "business_id", "stars"), "ratings")


def item_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.item_model(_ratings(spark, sf_dir))


def user_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.user_model(_ratings(spark, sf_dir))


def user_pearson_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User model among MinHash candidates, with ``USER_HASHES`` hashes in bands of two.

    There are many more candidates, such as all users of one business, than similar users; so these are found first.
    """
    signed = materialized(similarity.minhash_signatures(pairs(spark, sf_dir), "user_id", "business_id", similarity.hash_constants(USER_HASHES)), "signatures")
    model = recommend.user_model(_ratings(spark, sf_dir)).withColumnsRenamed({"u1": "key_a", "u2": "key_b"})
    return similarity.agreeing(model, signed, "user_id", USER_HASHES // 2, 2).withColumnsRenamed({"key_a": "u1", "key_b": "u2"})


def predict_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.predict_by_items(_test_pairs(spark, sf_dir), _ratings(spark, sf_dir), item_pearson(spark, sf_dir))


def predict_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _ratings_once(spark, sf_dir)
    return recommend.predict_by_users(_test_pairs(spark, sf_dir), ratings, recommend.user_model(ratings))


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coreview_edges(pairs(spark, sf_dir), THRESHOLD)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(cooccurrence_edges(spark, sf_dir))


def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(cooccurrence_edges(spark, sf_dir))


def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_betweenness(cooccurrence_edges(spark, sf_dir))


def girvan_newman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.girvan_newman(cooccurrence_edges(spark, sf_dir))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cooccurrence_edges(spark, sf_dir)
    return graph.modularity(edges, graph.connected_components(edges), "component")


def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _business(spark, sf_dir, "city").select("city")
    probes = table(spark, sf_dir, "city_stream").select("city", "seen_at")
    return sketch.might_contain(probes, "city", sketch.bloom_filter(known, "city")).select("city", "seen_at", "flag")


def fm_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "city_stream")
    minutes = seen.withColumn("minute", F.date_format("seen_at", "yyyy-MM-dd HH:mm"))
    return sketch.fm_distinct(minutes, ["minute"], "city")


def fm_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sliding_distinct(table(spark, sf_dir, "city_stream"), "seen_at", "city")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "distinct", "estimate")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "tag_stream").filter(F.col("post_id").isNotNull() & (F.size("hashtags") > 0))
    return posts.groupBy("post_id").agg(F.min_by("hashtags", F.struct("arrived_at", "chunk_no")).alias("hashtags"))


def trending_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.trending_tags(_posts(spark, sf_dir))


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.smallest_hashes(_posts(spark, sf_dir).select("post_id"), "post_id", 100, seed=1)


def reservoir_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, tag, count) after each micro-batch of the stream of posts, as the pieces arrive."""
    posts = table(spark, sf_dir, "tag_stream").select("hashtags", "posted_at")
    folder, out, state = (scratch_path(spark, x) for x in ("posts", "trending", "state"))
    posts.write.parquet(folder)
    stream = reservoir.trending_stream(readers.file_stream(spark, folder, posts.schema, per_trigger=64), capacity=100, seed=1)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("n long, tag string, count long").parquet(out)


def json_lines_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written as JSON lines and read again."""
    path = scratch_path(spark, "reviews")
    writers.json_lines(table(spark, sf_dir, "train_review").select("user_id", "business_id", "stars", F.col("review_date").alias("date"), "text"), path)
    return readers.reviews(spark, path).groupBy("user_id", "business_id").agg(F.count("*").alias("reviews"), F.count_if(F.col("stars") <= 5).alias("rated"), F.sum(F.length("text")).alias("letters"))


def json_lines_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "businesses")
    writers.json_lines(table(spark, sf_dir, "business").select("business_id", "categories", "state", "city"), path)
    return readers.businesses(spark, path)


def csv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct pairs of users and businesses written as CSV with a header and read again."""
    path = scratch_path(spark, "pairs")
    writers.csv_parts(pairs(spark, sf_dir), path)
    return readers.csv_rows(spark, path)


def text_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "words")
    table(spark, sf_dir, "stop_words").select(F.coalesce("word", F.lit("")).alias("word")).write.text(path)
    return readers.stop_words(spark, path)


def text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as lines of text and read again: (id, dimensions, total)."""
    path = scratch_path(spark, "points")
    _vectors(spark, sf_dir).select(F.concat_ws(",", F.col("id").cast("string"), F.transform("features", lambda x: x.cast("string"))).alias("line")).write.text(path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return readers.points(spark, path).select(F.col("id").cast("long").alias("id"), F.size("features").alias("dims"), F.round(total, 9).alias("total"))


def json_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as JSON objects id -> label, a line per label, and read again."""
    path = scratch_path(spark, "labels")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"))
    labels.select(F.to_json(F.create_map("id", "label")).alias("line")).write.text(path)
    return readers.label_map(spark, path)


def json_item_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item model written as JSON lines and read again."""
    path = scratch_path(spark, "model")
    writers.json_lines(item_pearson(spark, sf_dir), path)
    return readers.model(spark, path)


def itemset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report of frequent pairs and triples."""
    rows = materialized(_by_user(spark, sf_dir), "baskets")
    return writers.itemset_lines(itemsets.frequent_itemsets(rows, SUPPORT, 2).select("items").unionByName(itemsets.frequent_itemsets(rows, SUPPORT, 3).select("items")))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def _first_vectors(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = _vectors(spark, sf_dir).orderBy("id").limit(CLUSTERS).collect()
    return np.array([r["features"] for r in rows])


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(_vectors(spark, sf_dir), _first_vectors(spark, sf_dir)).select("id", "cluster")


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_sizes(kmeans_assign(spark, sf_dir), "cluster")


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = cluster.assign(_vectors(spark, sf_dir), _first_vectors(spark, sf_dir))
    return cluster.cluster_summaries(assigned).select("cluster", "dim", F.round(F.col("s") / F.col("n"), 12).alias("centre"))


def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = cluster.assign(_vectors(spark, sf_dir), _first_vectors(spark, sf_dir))
    return cluster.cluster_summaries(assigned).select("cluster", "dim", "n", F.round("s", 6).alias("s"), F.round("q", 6).alias("q"))


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _vectors(spark, sf_dir)
    return cluster.assign(points, cluster.kmeans(points, CLUSTERS)).select("id", "cluster")


def kmeans_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of k-means from given centres, and the assignment to the last ones."""
    points = _vectors(spark, sf_dir)
    centres = cluster.kmeans(points, CLUSTERS, _first_vectors(spark, sf_dir), rounds=3, tolerance=0.0)
    return cluster.assign(points, centres).select("id", "cluster")


def mahalanobis_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _vectors(spark, sf_dir)
    held = cluster.summaries(cluster.assign(points, _first_vectors(spark, sf_dir)))
    limit = 2 * len(next(iter(held.values())).s) ** 0.5
    return cluster.mahalanobis_assign(points, {"DS": [held[c] for c in sorted(held)]}, limit).select("id", "kind", "cluster")


def _bfr(spark: SparkSession, sf_dir: str) -> cluster.Bfr:
    points = _vectors(spark, sf_dir)
    return cluster.bfr((points.filter(F.col("id") % CHUNKS == i) for i in range(CHUNKS)), BFR_CLUSTERS)


def bfr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bfr(spark, sf_dir).points


def bfr_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_bfr(spark, sf_dir).rounds, "round int, discard_clusters int, discard_points long, compressed_clusters int, compressed_points long, retained_points long")


def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return cluster.nmi(kmeans_assign(spark, sf_dir).join(labels, "id"), "cluster", "label")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per category name of every business."""
    return split_values.business_categories(table(spark, sf_dir, "business"))


QUERIES = {
    f.__name__: f
    for f in (
        explore_counts, top_users, top_words, category_avg_stars, category_avg_eager, business_over_n, partition_count, partition_sizes, partition_sizes_by_business, partition_sizes_in_turn,
        state_user_business, frequent_items_k1, frequent_items_k2, frequent_items_k3, frequent_items_swapped, frequent_items_min_basket, frequent_items_all, son_itemsets, itemset_lines,
        jaccard_pairs, minhash_signatures, lsh_candidates, lsh_pairs, jaccard_pairs_w3, lsh_pairs_w3, doc_freq, tfidf_topk, binary_user_profile, user_term_weights, cosine_score,
        item_pearson, user_pearson, user_pearson_lsh, predict_item, predict_user, cooccurrence_edges, connected_components, label_propagation, edge_betweenness,
        girvan_newman, modularity, bloom_membership, fm_distinct, fm_sliding, trending_tags, reservoir_sample, reservoir_stream,
        kmeans_assign, kmeans_step, cluster_sizes, cluster_summaries, kmeans_rounds, kmeans_clusters, mahalanobis_assign, bfr_clusters, bfr_rounds, nmi, p6_found,
        json_lines_reviews, json_lines_businesses, csv_pairs, text_stop_words, text_points, json_label_map, json_item_model,
    )
}
