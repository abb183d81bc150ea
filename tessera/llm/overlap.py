"""All pairs of records whose sets of values overlap by a Jaccard threshold: extended-prefix join.

Values are ordered from rare to frequent. Two sets that share at least T values share at least
L of them within their L-prefixes, the first |x| - T + L values. A longer prefix has more keys but asks
for more of them, so L is chosen: only records of comparable size can be similar, keys are formed within
cells of neighbouring size bands, and every cell takes the L of ``LENGTHS`` for which the keys' pairs
are fewest. How a pair of records has to show its L shared prefix values adapts to their frequency, too:

* a value that is rare for the size of the sets is a join key of its own;
* a value so frequent that joining on it would give more pairs than there are combinations
  (``df > 2 * prefix length``) is only joined in combination with a second prefix value.

From the numbers of common single keys and common combinations follows how many prefix values a pair
shares; pairs with less than L, or too few values left, aren't looked at. The others are verified exactly, in
long form, so that a set of any size is never gathered into one row. Copies (equal sets) are folded
into classes before the join. Keys of many records are joined in blocks.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ranking import with_positions
from tessera.operators.common_pairs import in_blocks, meeting
from tessera.session import materialized

LENGTHS = (2, 3)  # of 1, nearly every pair of records with a common key would have to be verified
LOOKED_AT = 16  # the choice of L reads one key in so many; it changes the plan, not the result


class SimilarSets(NamedTuple):
    """``pairs`` (key_a, key_b, overlap, size_a, size_b, similarity) between class representatives
    and ``classes`` (side, key, representative, size), one row per record."""

    pairs: DataFrame
    classes: DataFrame


def size_bands(threshold: float, largest: int) -> list[int]:
    """Lower bounds of size bands such that similar sets lie in the same band or in neighbours."""
    bounds = [1, 2]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, math.floor((bounds[-1] - 1) / threshold + 1e-9) + 1))
    return bounds


def similar_sets(left: DataFrame, key: str, item: str, threshold: float = 0.8, min_size: int = 1, right: DataFrame | None = None) -> SimilarSets:
    """All pairs of records of ``left`` (or: of ``left`` with ``right``) with Jaccard similarity >= ``threshold``.

    Both tables are in long form, a row per (record ``key``, value ``item``); other columns are
    ignored. Rows with a null key or value are left out, repeated rows count once; a record with
    fewer than ``min_size`` values (so every empty one) has no pairs. Within one table ``key_a`` <
    ``key_b``; between two, ``key_a`` is of ``left``. Ties need no rule, as all pairs come out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    between = right is not None
    rows = left.select(F.lit(0).alias("side"), F.col(key).alias("key"), F.col(item).alias("item"))
    if between:
        rows = rows.unionByName(right.select(F.lit(1).alias("side"), F.col(key).alias("key"), F.col(item).alias("item")))
    members = materialized(rows.dropna().distinct(), "members")

    # One row per record, with the class of records of an equal set (128 bits of fingerprint and the size).
    marks = members.groupBy("side", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("f2"))
    marks = marks.filter(F.col("n") >= min_size)
    heads = marks.groupBy("side", "n", "f1", "f2").agg(F.min("key").alias("representative"))
    records = materialized(marks.join(heads, ["side", "n", "f1", "f2"]).select("side", "key", "n", "representative").withColumn("rid", F.monotonically_increasing_id() + F.col("side") * F.lit(1 << 62)), "records")  # of two tables, the left one's come first
    classes = records.select("side", "key", "representative", F.col("n").alias("size"))

    largest = records.agg(F.max("n")).first()[0] or 0
    bounds = size_bands(threshold, largest)
    at = F.array(*[F.lit(x).cast("long") for x in bounds])
    reps = records.filter(F.col("key") == F.col("representative")).select("rid", "side", "key", "n", (F.size(F.filter(at, lambda b: b <= F.col("n"))) - 1).alias("band"))

    # Values of the representatives; those of one record only can't be shared.
    owned = members.join(reps, ["side", "key"]).select("rid", "side", "n", "band", "item")
    counted = materialized(owned.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1").withColumn("tok", F.monotonically_increasing_id()), "items")
    tokens = owned.join(counted, "item").select("rid", "side", "n", "band", "tok", "df")
    # r counts from the most frequent value of a record: 1 is the last one in the order.
    placed = with_positions(tokens, ["rid"], [F.col("df").desc(), F.col("tok").desc()], name="r")

    plen = [math.ceil((1 - threshold) * (bounds[i + 1] if i + 1 < len(bounds) else bounds[-1] / threshold)) for i in range(len(bounds) + 1)]
    chosen = _chosen_lengths(placed, threshold, plen)
    keys = materialized(reduce(DataFrame.unionByName, [_keys(placed, threshold, plen, n, cells=F.broadcast(chosen.filter(F.col("length") == n).select("cell"))) for n in LENGTHS]), "keys")

    key = F.struct("cell", "k1", "k2")
    cells = in_blocks(keys.withColumn("key", key), "key", "rid")
    order = (F.col("a.side") < F.col("b.side")) if between else F.lit(True)
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9
    here = ~((F.col("a.band") < F.col("a.cell")) & (F.col("b.band") < F.col("b.cell")))
    needed = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    shared = cells.alias("a").join(cells.alias("b"), meeting("key", "rid") & order & sizes & here).select(
        F.col("a.rid").alias("ra"), F.col("b.rid").alias("rb"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.length").alias("length"),
        (F.col("a.k2") < 0).cast("int").alias("one"), F.least("a.r", "b.r").alias("left"),
    )
    candidates = shared.groupBy("ra", "rb", "na", "nb", "length").agg(F.sum("one").alias("s"), F.sum(1 - F.col("one")).alias("t"), F.max("left").alias("left"))
    # s single values and t = s f + f (f - 1) / 2 combinations of f frequent ones
    f = F.sqrt(F.pow(F.col("s") - 0.5, 2) + 2 * F.col("t")) - (F.col("s") - 0.5)
    shown = F.col("s") + F.when(F.col("t") > 0, F.round(f)).otherwise(0)
    candidates = candidates.filter((shown >= F.least("length", needed)) & (F.col("left") >= needed)).select("ra", "rb", "na", "nb")

    # Exact overlap, value by value.
    held = placed.select("rid", "tok")
    of_a = candidates.join(held.withColumnRenamed("rid", "ra"), "ra")
    both = of_a.join(held.withColumnRenamed("rid", "rb"), ["rb", "tok"])
    exact = both.groupBy("ra", "rb", "na", "nb").agg(F.count("*").alias("overlap"))
    exact = exact.withColumn("similarity", F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).filter(F.col("similarity") >= threshold)
    named = reps.select("rid", "key")
    out = exact.join(named.select(F.col("rid").alias("ra"), F.col("key").alias("x")), "ra").join(named.select(F.col("rid").alias("rb"), F.col("key").alias("y")), "rb")
    turned = F.lit(False) if between else F.col("x") > F.col("y")
    pick = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    pairs = out.select(pick("x", "y").alias("key_a"), pick("y", "x").alias("key_b"), "overlap", pick("na", "nb").alias("size_a"), pick("nb", "na").alias("size_b"), "similarity")
    return SimilarSets(pairs, classes)


def _keys(placed: DataFrame, threshold: float, plen: list[int], length: int, cells: DataFrame | None = None, looked_at: int = 1) -> DataFrame:
    """(cell, rid, side, n, band, r, length, k1, k2) for prefixes of ``length`` extra values; k2 is -1 for single values.

    Of all cells or those in ``cells`` (a row per size band), with every k1 or one in ``looked_at``.
    """
    need = F.ceil(F.col("n") * threshold - 1e-9)
    prefix = placed.withColumn("need", need).filter(F.col("r") > F.col("need") - length)
    prefix = prefix.withColumn("cell", F.explode(F.array("band", F.col("band") + 1))).withColumn("length", F.lit(length))
    prefix = prefix if cells is None else prefix.join(cells, "cell")
    long = F.element_at(F.array(*[F.lit(x + length) for x in plen]), F.col("cell") + 1)
    prefix = prefix.withColumn("frequent", F.col("df") > 2 * long)
    first = prefix if looked_at == 1 else prefix.filter(F.pmod(F.xxhash64("tok"), F.lit(looked_at)) == 0)
    names, none = ["cell", "rid", "side", "n", "band", "r", "length"], F.lit(-1).cast("long")
    singles = first.filter(~F.col("frequent") | (F.col("need") < length)).select(*names, F.col("tok").alias("k1"), none.alias("k2"))
    second = prefix.filter("frequent").select("cell", "rid", F.col("r").alias("r2"), F.col("tok").alias("k2"))
    return singles.unionByName(first.select(*names, F.col("tok").alias("k1")).join(second, ["cell", "rid"]).filter(F.col("r") > F.col("r2")).select(*names, "k1", "k2"))


def pairs_by_length(placed: DataFrame, threshold: float, plen: list[int], looked_at: int = LOOKED_AT) -> DataFrame:
    """(cell, length, pairs): an estimate of how many pairs the keys of each length have, from one value in ``looked_at``."""
    counts = []
    for length in LENGTHS:
        keys = _keys(placed, threshold, plen, length, looked_at=looked_at)
        held = keys.groupBy("cell", "length", "k1", "k2").agg(F.count("*").cast("double").alias("c"))
        counts.append(held.groupBy("cell", "length").agg((F.sum(F.col("c") * (F.col("c") - 1) / 2) * looked_at).alias("pairs"), (F.sum("c") * looked_at).alias("keys")))
    return reduce(DataFrame.unionByName, counts)


def _chosen_lengths(placed: DataFrame, threshold: float, plen: list[int]) -> DataFrame:
    """(cell, length): the length with the fewest pairs and keys together, ties to the shorter one; a row per size band."""
    cost = pairs_by_length(placed, threshold, plen).groupBy("cell").agg(F.min(F.struct((F.col("pairs") + F.col("keys")).alias("cost"), "length")).alias("best"))
    bands = placed.select(F.explode(F.array("band", F.col("band") + 1)).alias("cell")).distinct()
    return materialized(bands.join(cost, "cell", "left").select("cell", F.coalesce("best.length", F.lit(LENGTHS[0])).alias("length")), "lengths")


def expanded(found: SimilarSets) -> DataFrame:
    """Every similar pair of records (key_a < key_b), copies written out.

    The number of rows is that of the pairs asked for; use the classes where it needn't be.
    """
    of = found.classes.select("representative", "key")
    a, b = of.select(F.col("representative").alias("key_a"), F.col("key").alias("x")), of.select(F.col("representative").alias("key_b"), F.col("key").alias("y"))
    across = found.pairs.select("key_a", "key_b").join(a, "key_a").join(b, "key_b").select("x", "y")
    repeated = found.classes.groupBy("representative").count().filter("count > 1").select("representative")
    copies = of.join(repeated, "representative")
    cells = in_blocks(copies, "representative", "key")
    within = cells.alias("a").join(cells.alias("b"), meeting("representative", "key")).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
