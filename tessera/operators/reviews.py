"""Cleaning rules shared by all queries over reviews: one row per review, trimmed ids, valid stars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(column: str) -> Column:
    """An id without surrounding spaces; null where it is then empty."""
    trimmed = F.trim(F.col(column))
    return F.when(trimmed != "", trimmed)


def valid_stars(column: str = "stars") -> Column:
    """Stars from 1 to 5; null for anything else. NaN sorts above all numbers, so it fails the upper bound."""
    return F.when((F.col(column) >= 1) & (F.col(column) <= 5), F.col(column))


def first_loaded(reviews: DataFrame, columns: Sequence[str], key: str = "review_id", loaded: str = "loaded_at") -> DataFrame:
    """One row per ``key``: of rows sent again, the one loaded first (ties: the smallest values).

    ``min`` over a struct combines on the map side, so a key sent very often leaves each task as
    one row. Rows without a key can't be told apart and count as one review each.
    """
    kept = reviews.groupBy(key).agg(F.min(F.struct(loaded, *columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
    return kept.filter(F.col(key).isNotNull()).unionByName(reviews.filter(F.col(key).isNull()).select(key, *columns))
