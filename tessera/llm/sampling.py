"""A uniform sample of fixed size from data of unknown length, by a seeded permutation.

Records get dense numbers 0..N-1 through partition offsets (see ranking.with_positions). A
Feistel network over the smallest power of two that holds N permutes them; numbers that fall
outside 0..N-1 are permuted again (cycle walking), which keeps it a permutation of 0..N-1.
Records whose permuted number is below k are the sample: exactly min(k, N) of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.ranking import with_positions

ROUNDS = 8
BROADCAST = 100_000  # sampled ids up to which they are broadcast


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ _mix(np.array([seed % 2**64], dtype=np.uint64)))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of ``numbers`` (each in 0..n-1) under a seeded permutation of 0..n-1."""
    if n <= 1:
        return numbers.astype(np.uint64)
    bits = max(2, int(n - 1).bit_length())
    keys = round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left_bits, right_bits = bits // 2, bits - bits // 2
        left, right = x >> np.uint64(right_bits), x & np.uint64((1 << right_bits) - 1)
        for k in keys:  # the halves change places, and widths with them
            mixed = _mix(right ^ k) & np.uint64((1 << left_bits) - 1)
            left, right = right, left ^ mixed
            left_bits, right_bits = right_bits, left_bits
        return (left << np.uint64(right_bits)) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out


def fixed_size_sample(df: DataFrame, k: int, order: Sequence[Column], seed: int = 0) -> DataFrame:
    """Exactly min(k, N) rows of ``df``, every row equally likely; a column ``slot`` (0..k-1) is added.

    ``order`` is a total order of the rows that fixes their numbers, so that a sample depends on
    data and seed alone, not on how the data was cut into pieces. Repeated rows are rows of
    their own: remove them before, if a record must count once. ``k`` below 1 and empty input
    give no rows.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("slot", T.LongType())])
    numbered = with_positions(df, [], order, name="__number")
    total = numbered.count() if k > 0 else 0
    if not total:
        return df.sparkSession.createDataFrame([], schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__number")
            slot = permute(batch.column(at).to_numpy(zero_copy_only=False) - 1, total, seed)
            rows = pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(slot.astype(np.int64))], names=[*[x for x in batch.schema.names if x != "__number"], "slot"])
            yield rows.filter(pa.array(slot < k))

    return numbered.mapInArrow(keep, schema)


def sample_posts(posts: DataFrame, k: int = 100, seed: int = 0) -> DataFrame:
    """A sample of ``k`` distinct posts with at least one entry in ``hashtags``.

    A post delivered more than once counts once (its earliest arrival); null ids, null lists and
    empty lists are no posts to draw from. Only ids are numbered and permuted; the k rows drawn
    are then broadcast, or joined by shuffle if ``k`` is above ``BROADCAST``, to fetch the rest of each post.
    """
    drawable = posts.filter(F.col("post_id").isNotNull() & (F.size("hashtags") > 0))
    drawn = fixed_size_sample(drawable.select("post_id").distinct(), k, [F.col("post_id")], seed)
    arrivals = drawable.join(F.broadcast(drawn) if k <= BROADCAST else drawn, "post_id").groupBy("post_id", "slot")
    return arrivals.agg(F.min_by(F.struct("chunk_no", "hashtags"), F.struct("arrived_at", "chunk_no")).alias("p")).select("post_id", "slot", "p.chunk_no", "p.hashtags")
