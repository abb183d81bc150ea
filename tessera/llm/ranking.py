"""Exact positions by a global range-partitioned sort, and the first N items of every group.

The rows are range-partitioned on (group, order) together, so that a group of any size is
spread over as many partitions as it needs. Each partition numbers its own rows; what is
missing is only how many rows of its first group lie in earlier partitions. One summary row
per partition (its first and last group and their counts) is prefix-summed on the driver, a
result bounded by the number of partitions, and added to the local positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpointed

PART, LOCAL = "__tessera_part", "__tessera_local"


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row's group differs from that of the row before; the first row is True."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, dtype=bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(c.type):  # NaN is one group
            differs = pc.and_not(differs, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        nulls = pc.xor(pc.is_null(a), pc.is_null(b))
        out[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    if n:
        out[0] = True
    return out


def _number(group: Sequence[str], limit: int | None):
    """Per partition: local positions from 1 within the group, rows beyond ``limit`` dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if group:
                keys = [batch.column(batch.schema.get_field_index(g)) for g in group]
                start = _changes(keys)
                if last is not None and repr([k[0].as_py() for k in keys]) == repr(last):
                    start[0] = False
                last = [k[n - 1].as_py() for k in keys]
            else:
                start = np.zeros(n, dtype=bool)
            row = np.arange(n, dtype=np.int64)
            begin = np.maximum.accumulate(np.where(start, row, -1))
            local = np.where(begin >= 0, row - begin + 1, row + 1 + seen)
            seen = int(local[-1])
            extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(local)]
            out = pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=pa.schema([*batch.schema, pa.field(PART, pa.int32()), pa.field(LOCAL, pa.int64())]))
            yield out if limit is None else out.filter(pa.array(local <= limit))

    return run


def _edges(group: Sequence[str]):
    """Per partition one row: its first and last group (as text) and the rows of the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        n_last = part = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column(batch.schema.get_field_index(PART))[0].as_py()
            keys = [batch.column(batch.schema.get_field_index(g)) for g in group]
            first = repr([k[0].as_py() for k in keys]) if first is None else first
            last, n_last = repr([k[n - 1].as_py() for k in keys]), batch.column(batch.schema.get_field_index(LOCAL))[n - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [last], "n_last": [n_last]})

    return run


def with_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int | None = None, name: str = "position") -> DataFrame:
    """``df`` with the exact 1-based position of every row within its group, as a long column ``name``.

    ``group`` names the grouping columns (none: one position over all rows); ``order`` must be a
    total order within the group, else tied rows get adjacent positions in any order. With
    ``limit`` only rows up to that position are kept; the earlier of them are enough to tell that
    a later row lies beyond, so each partition drops the others before they are written.
    Null is a group of its own, and so is NaN. An empty input gives an empty result. A column ``name`` that
    ``df`` already has is replaced; other extra columns come along.
    """
    df = df.drop(name) if name in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(LOCAL, T.LongType())])
    keys = [F.col(g) for g in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    local = checkpointed(placed.mapInArrow(_number(list(group), limit), schema))
    edges = local.select(*group, PART, LOCAL).mapInArrow(_edges(list(group)), "part int, first string, last string, n_last long").collect()
    moved, carried, open_group = {}, 0, None  # rows that earlier partitions hold of a partition's first group
    for e in sorted(edges, key=lambda r: r["part"]):
        before = carried if e["first"] == open_group else 0
        if before:
            moved[e["part"]] = before
        carried = e["n_last"] + (before if e["first"] == e["last"] else 0)
        open_group = e["last"]
    out = df.schema.fields

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_first = True
        previous = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column(batch.schema.get_field_index(PART))[0].as_py()
            at = batch.column(batch.schema.get_field_index(LOCAL)).to_numpy(zero_copy_only=False)
            if part in moved and in_first:
                # the first group ends where the local position starts again
                falls = np.flatnonzero(np.diff(at, prepend=previous) <= 0)
                end = int(falls[0]) if len(falls) else n
                in_first = end == n
                at = at.copy()
                previous = int(at[-1])
                at[:end] += moved[part]
            position = pa.array(at)
            rows = pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(out))], position], names=[*[f.name for f in out], name])
            yield rows if limit is None else rows.filter(pa.array(at <= limit))

    return local.mapInArrow(shift, T.StructType([*out, T.StructField(name, T.LongType())]))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order``, with their ``position``.

    Groups smaller than ``n`` come whole; repeated rows count as often as they occur; ties are
    as total as ``order`` is. ``n`` below 1 gives no rows.
    """
    if n < 1:
        return df.withColumn("position", F.lit(0).cast("long")).limit(0)
    return with_positions(df, group, order, limit=n)
