"""Approximate membership (Bloom filter) and distinct counts (Flajolet-Martin) with fixed hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import bytes_of, linear_hash, trailing_zeros
from tessera.operators.similarity import hash_constants
from tessera.session import materialized

BITS = 8000
# (a, b, modulus) of the two hashes of the membership filter: constants by rule, the modulus the first prime from 2^31 on.
BLOOM_HASHES = tuple((a, b, 2147483659) for a, b in hash_constants(2, seed=11))
# Fixed values: (a, b, modulus) of the 60 hashes of the distinct counter.
COUNT_HASHES = (
    (-5784, 4242, 475528612), (-7445, -8117, 847707908), (5345, -3322, 53081982), (-9547, 1981, 491735196), (-925, -4122, 893730636),
    (-122, 1759, 536417856), (6497, -465, 932890129), (9193, 7930, 277364510), (2021, -5166, 209345494), (6752, -5263, 61839592),
    (-2580, 6295, 804406008), (8098, -4693, 747435679), (-7988, 4892, 804824051), (-8854, -9631, 324150832), (-9088, -7386, 137283939),
    (3161, 4684, 275333552), (1971, 6509, 296193269), (-9310, 9038, 261085849), (9245, -9898, 959071148), (7350, 4179, 392855097),
    (-4838, 5287, 24670986), (610, 5836, 50023043), (9453, 3586, 1200548), (-6172, 7805, 264695806), (-75, -98, 177749096),
    (-1481, -9319, 515114864), (1538, -4513, 459014124), (-427, 3347, 105394153), (9563, 6773, 346529937), (-9007, 5215, 833170048),
    (-5316, -3153, 701832096), (-7881, 6554, 211851653), (8047, 5316, 653508160), (3615, -969, 408839209), (1678, -5874, 964232482),
    (-9603, -7771, 612835737), (-2613, -7682, 999683604), (-3867, -206, 73595183), (-4841, -1371, 4259718), (-2310, 3912, 775274868),
    (7567, 9614, 646354995), (-8238, 8253, 844226086), (4501, -1611, 498009778), (9240, 2000, 694905063), (7650, 4727, 68326721),
    (6351, 1386, 280839009), (-6909, 3520, 957821259), (-1581, -8095, 885523760), (1090, 5516, 254267011), (4288, -7581, 325047909),
    (-4262, 7348, 3784554), (-7613, -3920, 724353002), (-384, -2708, 395489622), (-8840, 4115, 303185341), (6212, -1195, 991066480),
    (1213, 4812, 498566989), (-640, -7705, 182088090), (-4553, 5934, 452918094), (2513, 6315, 355348464), (3426, 1234, 304757776),
)


def bloom_positions(text: Column, hashes: Sequence[tuple[int, int, int]] = BLOOM_HASHES, bits: int = BITS) -> Column:
    """The positions that a string sets."""
    codes = bytes_of(text)
    return F.array(*[F.pmod(linear_hash(codes, a, b, c), F.lit(bits)) for a, b, c in hashes])


def bloom_filter(values: DataFrame, column: str) -> DataFrame:
    """The filter of a column as one row ``bits``, an array of the positions set; '' and null set none.

    Positions are made distinct before they are collected: every task sends at most ``BITS``.
    """
    given = values.select(column).filter(F.col(column) != "").distinct()
    positions = given.select(F.explode(bloom_positions(F.col(column))).alias("bit")).distinct()
    return positions.agg(F.array_sort(F.collect_list("bit")).alias("bits"))


def might_contain(probes: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """``probes`` with ``flag``: 1 if the filter may hold the value, surely 1 if it does; '' is always 1, null 0."""
    # the filter is one row of at most BITS positions
    held = probes.crossJoin(F.broadcast(bits))
    hit = F.size(F.array_except(bloom_positions(F.col(column)), "bits")) == 0
    return held.withColumn("flag", F.when(F.col(column) == "", 1).when(F.col(column).isNull(), 0).otherwise(hit.cast("int"))).drop("bits")


def fm_rank_columns(text: Column) -> Column:
    """For each hash the zeros at the end of its value, as an array."""
    codes = bytes_of(text)
    return F.array(*[trailing_zeros(linear_hash(codes, a, b, c)) for a, b, c in COUNT_HASHES])


def fm_estimate(ranks: Sequence[Column]) -> Column:
    """The mean of 2^R over the middle part of the sorted estimates: places 25 to 38 of 60."""
    third = len(ranks) // 3
    low, high = int(1.2 * third), int(1.9 * third)
    ordered = F.array_sort(F.array(*[F.pow(F.lit(2.0), r) for r in ranks]))
    return F.aggregate(F.slice(ordered, low + 1, high - low), F.lit(0.0), lambda s, x: s + x) / (high - low)


def fm_distinct(events: DataFrame, keys: Sequence[Column | str], column: str) -> DataFrame:
    """(keys, distinct, estimate): exact and estimated number of distinct values per group.

    Values are made distinct before they are hashed, once for all groups; '' is a value, null isn't.
    """
    values = materialized(events.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("value")).distinct(), "values")
    names = values.columns[:-1]
    hashed = values.join(values.select("value").distinct().withColumn("z", fm_rank_columns(F.col("value"))), "value")
    largest = hashed.groupBy(*names).agg(F.count("*").alias("distinct"), *[F.max(F.col("z")[i]).alias(f"r{i}") for i in range(len(COUNT_HASHES))])
    return largest.select(*names, "distinct", F.round(fm_estimate([F.col(f"r{i}") for i in range(len(COUNT_HASHES))]), 6).alias("estimate"))
