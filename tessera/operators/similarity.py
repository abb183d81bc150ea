"""Jaccard similarity of businesses by their users: exact by prefixes, and MinHash with banding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import number_of
from tessera.operators.common_pairs import in_blocks, meeting
from tessera.operators.packed_pairs import Packed
from tessera.session import dropped, materialized

PRIME = 4294967311  # the first prime above 2^32


def jaccard_pairs(rows: DataFrame, key: str, item: str, threshold: float) -> DataFrame:
    """All pairs of keys whose item sets have a Jaccard similarity of at least ``threshold``.

    Common items are counted exactly by ``Packed``; the most frequent items are not joined on.
    ``rows`` holds distinct (key, item).
    """
    packed = Packed(rows.select(key, item), key, item)
    found = packed.named(packed.pairs(1, threshold))
    return found.select("key_a", "key_b", F.col("n").cast("long").alias("overlap"), (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("similarity"))


def hash_constants(n: int, seed: int = 7) -> list[tuple[int, int]]:
    """``n`` pairs (a, b) for the hashes (x a + b) mod PRIME, from a fixed rule."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 48271 + 11) % 2147483647
        y = (x * 48271 + 11) % 2147483647
        out.append((x % 9998 + 1, y % 1000003))
        x = y
    return out


def minhash_signatures(rows: DataFrame, key: str, item: str, constants: Sequence[tuple[int, int]]) -> DataFrame:
    """(key, h0, h1, ...): for each hash the smallest value over the key's items. One pass, combined on the map side."""
    x = number_of(F.col(item))
    mins = [F.min(F.pmod(x * a + b, F.lit(PRIME).cast("long"))).alias(f"h{i}") for i, (a, b) in enumerate(constants)]
    return rows.groupBy(key).agg(*mins)


def equal_sets(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, head): the smallest key with the same item set, itself for most; sets are equal by size and 128 bits of fingerprint.

    ``rows`` holds distinct (key, item).
    """
    marks = rows.groupBy(key).agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64(item)).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), item)).alias("f2"))
    heads = marks.groupBy("size", "f1", "f2").agg(F.min(key).alias("head"))
    return marks.join(heads, ["size", "f1", "f2"]).select(key, "head")


def lsh_candidates(signatures: DataFrame, key: str, bands: int, width: int, sets: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b) of keys that agree in all ``width`` hashes of at least one of ``bands`` bands.

    An equal signature is not an equal set, so every key is paired by itself. With ``sets``, the
    membership from ``equal_sets``, only exact copies are folded: their head is paired with other
    heads, each copy with its head only, and ``with_copies`` gives the other pairs.
    """
    copies = None
    if sets is not None:
        signatures = signatures.join(sets.filter(F.col(key) == F.col("head")).select(key), key)
        copies = sets.filter(F.col(key) != F.col("head")).select(F.col("head").alias("key_a"), F.col(key).alias("key_b"))
    band = F.array(*[F.struct(F.lit(b).alias("band"), F.array(*[F.col(f"h{i}") for i in range(b * width, (b + 1) * width)]).alias("value")) for b in range(bands)])
    cells = in_blocks(signatures.select(F.col(key).alias("key"), F.explode(band).alias("bucket")), "bucket", "key")
    pairs = cells.alias("a").join(cells.alias("b"), meeting("bucket", "key"))
    found = pairs.select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).distinct()
    return found if copies is None else found.unionByName(copies)


def with_copies(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """All pairs of keys (key_a < key_b) that pairs of heads, and of heads with their copies, stand for; other columns stay."""
    rest = [c for c in pairs.columns if c not in ("key_a", "key_b")]
    a, b = (sets.select(F.col("head").alias(k), F.col(key).alias(x)) for k, x in (("key_a", "x"), ("key_b", "y")))
    across = pairs.join(a, "key_a").join(b, "key_b").select("x", "y", *rest)  # a copy is no head
    copies = pairs.join(sets.select(F.col("head").alias("key_a"), F.col(key).alias("key_b")), ["key_a", "key_b"])
    within = copies.join(a, "key_a").filter(F.col("x") < F.col("key_b")).select("x", F.col("key_b").alias("y"), *rest)
    return across.unionByName(within).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), *rest)


def agreeing(pairs: DataFrame, signatures: DataFrame, key: str, bands: int, width: int, chunk: int = 8) -> DataFrame:
    """Those of ``pairs`` (key_a, key_b, ...) that agree in all ``width`` hashes of at least one of ``bands`` bands.

    The result is that of ``lsh_candidates``, for pairs that are known. ``chunk`` hashes are looked up at once, and only
    for pairs that agree in no earlier band, so a pair never carries a whole signature.
    """
    out, left, step = [], materialized(pairs, "pairs"), max(1, chunk // width)
    for lo in range(0, bands, step):
        hi = min(lo + step, bands)
        names = [f"h{i}" for i in range(lo * width, hi * width)]
        a, b = (signatures.select(F.col(key).alias(k), *[F.col(h).alias(f"{x}{h}") for h in names]) for k, x in (("key_a", "a"), ("key_b", "b")))
        bandwise = [reduce(Column.__and__, [F.col(f"ah{i}") == F.col(f"bh{i}") for i in range(n * width, (n + 1) * width)]) for n in range(lo, hi)]
        met = left.join(a, "key_a").join(b, "key_b").select(*pairs.columns, reduce(Column.__or__, bandwise).alias("__met"))
        met = materialized(met, "met")
        dropped(left)
        out.append(met.filter("__met").drop("__met"))
        left = met.filter("NOT __met").drop("__met")
    return reduce(DataFrame.unionByName, out)


def lsh_pairs(rows: DataFrame, key: str, item: str, threshold: float, constants: Sequence[tuple[int, int]], width: int = 1, sets: DataFrame | None = None) -> DataFrame:
    """MinHash candidates with their exact similarity, where it reaches ``threshold``: no false pairs, some missed.

    Exact copies have one pair with their head; ``with_copies`` writes the others out. ``sets`` is
    their membership from ``equal_sets``, found here if it isn't given (``rows`` is then written once).
    Of the candidates, many times as many as similar pairs where an item is in many sets, none is written
    out: the pairs that reach ``threshold`` are counted first, and kept where their signatures agree.
    """
    if sets is None:
        rows = materialized(rows, "rows")
        sets = materialized(equal_sets(rows, key, item), "sets")
    own = materialized(rows.join(sets.filter(F.col(key) == F.col("head")).select(key), key, "left_semi"), "heads")
    signed = materialized(minhash_signatures(own, key, item, constants), "signatures")
    found = agreeing(jaccard_pairs(own, key, item, threshold), signed, key, len(constants) // width, width)
    size = rows.groupBy(F.col(key).alias("key_b")).agg(F.count("*").alias("overlap"))
    copies = sets.filter(F.col(key) != F.col("head")).select(F.col("head").alias("key_a"), F.col(key).alias("key_b")).join(size, "key_b")
    return found.unionByName(copies.withColumn("similarity", F.lit(1.0)).filter(F.col("similarity") >= threshold))
