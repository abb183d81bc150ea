"""Pairs of rows that meet in at least ``min_common`` groups, without writing out the largest groups' pairs.

A pair that meets in ``min_common`` groups meets in at least one group that isn't among the
``min_common - 1`` largest. Those few are left out when pairs are formed; what they add is then
looked up for the pairs found, so that a group with a tenth of all rows costs as much as it has rows.
All other groups of more than ``BLOCK`` rows are joined in blocks: rows are cut into blocks of about
that size and every pair of blocks is a join key of its own, so no key has more pairs than a block squared.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialized

LARGEST = 8  # at most so many groups are set aside, so the set is broadcast
BROADCAST = 100_000  # large groups up to which their list is broadcast
BLOCK = 1024  # rows of a group that are joined with each other under one key


def largest_groups(rows: DataFrame, group: str, n: int) -> DataFrame:
    """The keys of the ``n`` (at most 8) largest groups, as a broadcast table."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    return F.broadcast(sizes.orderBy(F.col("__n").desc(), group).limit(min(n, LARGEST)).select(group))


def in_blocks(rows: DataFrame, group: str, key: str, block: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``__lo``, ``__hi`` and ``__own``: a row per cell, a cell being a pair of blocks of its group.

    Two rows of a group meet in exactly one cell for which ``apart`` holds. Groups of up to ``block`` rows have one cell.
    ``sizes`` (the group, ``__n`` rows at most) spares counting them.
    """
    large = (rows.groupBy(group).agg(F.count("*").alias("__n")) if sizes is None else sizes).filter(F.col("__n") > block)
    large = materialized(large.select(group, F.ceil(F.col("__n") / block).cast("int").alias("__blocks")), "large")
    if large.count() <= BROADCAST:  # so that the rows needn't be moved to learn that their group is small
        large = F.broadcast(large)
    placed = rows.join(large, group, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    placed = placed.withColumn("__own", F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int"))
    cells = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return cells.withColumns({"__lo": F.least("__own", "__other"), "__hi": F.greatest("__own", "__other")}).drop("__blocks", "__other")


def meeting(group: str, key: str) -> Column:
    """The join of two tables of ``in_blocks``, aliased ``a`` and ``b``: every pair of a group once, the smaller key first."""
    cell = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.__lo") == F.col("b.__lo")) & (F.col("a.__hi") == F.col("b.__hi"))
    apart = (F.col("a.__own") != F.col("b.__own")) | (F.col("a.__lo") == F.col("a.__hi"))
    return cell & apart & (F.col(f"a.{key}") < F.col(f"b.{key}"))


def pairs_in_common(rows: DataFrame, group: str, key: str, min_common: int, sums: Mapping[str, Column] | None = None, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key_a, key_b, n, ...) with key_a < key_b for all keys that share at least ``min_common`` groups.

    ``rows`` has one row per (group, key). With ``weight``, a column of positive whole numbers, a
    common group counts as the product of both weights: as often as repeated rows would meet.
    ``sums`` are numeric expressions over the joined sides ``a`` and ``b``, summed per pair. Rows
    with a null key or group are left out; an empty table gives no rows.
    """
    sums = dict(sums or {})
    rows = materialized(rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull()), "rows")
    if not min_common > 0:
        raise ValueError("min_common must be at least 1")
    if weight is None:
        often = rows.groupBy(key).agg(F.count("*").alias("__groups")).filter(F.col("__groups") >= min_common)
        rows = rows.join(often.select(key), key, "left_semi")
    n = F.lit(1).cast("long") if weight is None else F.col(f"a.{weight}") * F.col(f"b.{weight}")
    parts = {"n": n, **sums}
    total = [F.sum(k).alias(k) for k in parts]

    def met(light: DataFrame) -> DataFrame:
        cells = in_blocks(light, group, key, block)
        both = cells.alias("a").join(cells.alias("b"), meeting(group, key))
        return both.select(F.col(f"a.{key}").alias("key_a"), F.col(f"b.{key}").alias("key_b"), *[v.alias(k) for k, v in parts.items()])

    aside = min(min_common - 1, LARGEST)
    if aside < 1:
        return met(rows).groupBy("key_a", "key_b").agg(*total).filter(F.col("n") >= min_common)
    large = largest_groups(rows, group, aside)
    light, heavy = rows.join(large, group, "left_anti"), rows.join(large, group, "left_semi")
    found = met(light).groupBy("key_a", "key_b").agg(*total)
    wanted = found.select("key_a", "key_b")
    if weight is None:
        wanted = found.filter(F.col("n") >= min_common - aside).select("key_a", "key_b")
    else:  # a repeated row may reach min_common within the large groups alone
        repeated = heavy.filter(F.col(weight) > 1).select(F.col(group).alias("__g"), F.col(key).alias("__k"))
        near = repeated.join(heavy, F.col("__g") == F.col(group)).filter(F.col("__k") != F.col(key))
        wanted = wanted.unionByName(near.select(F.least("__k", key).alias("key_a"), F.greatest("__k", key).alias("key_b"))).distinct()
    side = lambda name, k: heavy.select(F.struct(*heavy.columns).alias(name), F.col(key).alias(k))
    both = wanted.join(side("a", "key_a"), "key_a").join(side("b", "key_b"), "key_b").filter(F.col(f"a.{group}") == F.col(f"b.{group}"))
    more = both.select("key_a", "key_b", *[v.alias(k) for k, v in parts.items()])
    return found.unionByName(more).groupBy("key_a", "key_b").agg(*total).filter(F.col("n") >= min_common)
