"""Pairs of keys by the number of groups they share, with keys as numbers and the pairs of a group as lists.

Writing out every pair of every group as a row costs some hundred bytes a pair. Here keys are numbered densely, a group is the
sorted list of its numbers, and a list is moved once to each task that counts pairs of its keys, however many of them it has there:
four bytes a number, and never more than four bytes a pair. All lists of a key meet in one task, which makes its pairs in slices and
counts them by sorting. The few largest groups are not written as lists at all: they are bits
of a mask by key. Numbers are in the order of (mask, size), so both follow from a number by a table of steps, which is small,
and pairs that share large groups only are ranges of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common_pairs import BLOCK, LARGEST
from tessera.session import dropped, materialized

PAIRS = 2_000_000  # pairs that fall to a task while there are few tasks; pairs of ranges, which a task holds at once
WAYS, MOST = 24, 32_000_000  # from so many tasks on, so many pairs of lists fall to a task: each one more moves the lists once more
SLICE = 2_000_000  # pairs that are sorted at once, if they are of more than one key, and numbers of lists that are sent on at once
POP = np.array([bin(i).count("1") for i in range(1 << LARGEST)], dtype=np.int64)


class Packed:
    """``rows`` (distinct key and group, nulls left out) with numbered keys and groups; ``cells`` has (id, g) and the other columns."""

    def __init__(self, rows: DataFrame, key: str, group: str, aside: int = LARGEST, block: int = BLOCK):
        rows = materialized(rows.filter(F.col(group).isNotNull() & F.col(key).isNotNull()), "rows")
        sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
        heavy = sizes.filter(F.col("__n") > block).orderBy(F.col("__n").desc(), group).limit(min(aside, LARGEST))
        # at most LARGEST rows: numbered -1, -2, ...
        heavy = materialized(heavy.select(group, (-F.row_number().over(Window.orderBy(F.col("__n").desc(), group))).cast("long").alias("__h")), "heavy")
        self.bits = heavy.count()
        marked = rows.join(F.broadcast(heavy), group, "left")
        keys = marked.groupBy(key).agg(F.count("*").cast("int").alias("size"), F.coalesce(F.bit_or(F.expr("shiftleft(1, cast(-__h - 1 as int))")), F.lit(0)).alias("mask"))
        self.keys = _numbered(keys.withColumnRenamed(key, "__key"), ["mask", "size", "__key"], "id")
        groups = rows.select(group).distinct().join(F.broadcast(heavy), group, "left_anti")
        light = materialized(groups.withColumn("__g", F.monotonically_increasing_id()), "groups")
        groups = light.unionByName(heavy.withColumnRenamed("__h", "__g"))
        self.cells = materialized(rows.join(self.keys.select(F.col("__key").alias(key), F.col("id").alias("__id")), key).join(groups, group).drop(key, group).withColumnsRenamed({"__id": "id", "__g": "g"}), "cells")
        dropped(rows, light)
        steps = self.keys.groupBy("mask", "size").agg(F.min("id").alias("first"), F.max("id").alias("last")).orderBy("first").collect()
        self.steps = {k: np.array([r[k] for r in steps], dtype=np.int64) for k in ("mask", "size", "first", "last")}

    def _ranges(self, least: int, share: float) -> list[tuple[int, int, int, int]]:
        """Ranges of numbers (from, to, from, to) whose pairs meet both bounds by the large groups alone."""
        mask, size, first, last = (self.steps[k] for k in ("mask", "size", "first", "last"))
        may = np.flatnonzero((mask > 0) & (POP[mask] >= least) & (POP[mask] >= share * size - 1e-9))
        out = []
        for x in may:
            y = may[may >= x]
            n = POP[mask[x] & mask[y]]
            y = y[(n >= max(least, 1)) & (n / (size[x] + size[y] - n) >= share)]
            out += [(int(first[x]), int(last[x]), int(first[i]), int(last[i])) for i in y]
        return out

    def _met(self, least: int, share: float, groups: bool) -> DataFrame:
        spark, steps = self.keys.sparkSession, self.steps
        lists = materialized(self.cells.filter("g >= 0").groupBy("g").agg(F.sort_array(F.collect_list("id")).alias("l")).filter(F.size("l") > 1), "lists")
        listed = lists.agg(F.sum(F.size("l").cast("double") * (F.size("l") - 1) / 2)).first()[0] or 0
        ranges = self._ranges(least, share)
        ranged = sum((b - a + 1) * (d - c + 1) for a, b, c, d in ranges)
        tasks = max(1, -int(-(listed + ranged) // PAIRS))
        if tasks > WAYS:
            tasks = max(WAYS, -int(-listed // MOST), -int(-ranged // PAIRS))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _spread(batch, tasks)

        moved = lists.repartition("g").mapInArrow(spread, "t int, g long, own array<int>, l array<int>").withColumns({"first": F.lit(0), "last": F.lit(-1)})
        if ranges:
            r = spark.createDataFrame(ranges, "x int, y int, first int, last int").withColumn("a", F.explode(F.sequence("x", "y")))
            r = r.select((F.col("a") % tasks).alias("t"), F.lit(-1).cast("long").alias("g"), F.array(F.lit(0)).alias("own"), F.array("a").alias("l"), F.greatest("first", F.col("a") + 1).alias("first"), "last")
            moved = moved.unionByName(r)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _count(batches, steps, least, share, groups)

        return moved.repartitionById(tasks, "t").mapInArrow(count, "a int, b int, g long" if groups else "a int, b int, n int")

    def pairs(self, least: int = 1, share: float = 0.0) -> DataFrame:
        """(a, b, n), numbers of keys with ``least`` common groups or more that are ``share`` of all groups of both."""
        return self._met(least, share, False)

    def common(self, least: int = 1, share: float = 0.0) -> DataFrame:
        """(a, b, g): the same pairs with a row for each group they share."""
        return self._met(least, share, True)

    def named(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with key_a < key_b and their sizes na, nb instead of the numbers a and b."""
        for x in "ab":
            pairs = pairs.join(self.keys.select(F.col("id").alias(x), F.col("__key").alias(f"__{x}"), F.col("size").cast("long").alias(f"__n{x}")), x)
        rest = [c for c in pairs.columns if c not in ("a", "b", "__a", "__b", "__na", "__nb")]
        turned = F.col("__a") > F.col("__b")
        swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
        return pairs.select(swap("__a", "__b").alias("key_a"), swap("__b", "__a").alias("key_b"), swap("__na", "__nb").alias("na"), swap("__nb", "__na").alias("nb"), *rest)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in a total order; written to the shared folder."""
    placed = materialized(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, before, offsets = F.shiftright("__at", 33), 0, []
    for p, n in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row per partition
        offsets.append((p, before))
        before += n
    if before >= 1 << 31:
        raise ValueError("more than 2^31 keys")
    starts = rows.sparkSession.createDataFrame(offsets, "__p long, __before long")
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return placed.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn(name, at.cast("int")).drop("__p", "__before", "__at")


def _spread(batch: pa.RecordBatch, tasks: int) -> Iterator[pa.RecordBatch]:
    """(t, g, own, l) of lists (g, l): for each task t = number % tasks the list from its first number on, and where its numbers are in it."""
    g, lists = batch.column("g").to_numpy(zero_copy_only=False), batch.column("l")
    m = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(m)), m)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(m) - m, m)
    has = np.flatnonzero(at < m[row] - 1)  # behind the last number there is none
    by = has[np.argsort(row[has] * tasks + flat[has] % tasks, kind="stable")]
    heads = np.flatnonzero(np.append(True, np.diff(row[by] * tasks + flat[by] % tasks) != 0)) if len(by) else by
    head, sizes = by[heads], np.diff(np.append(heads, len(by)))
    own = (at[by] - np.repeat(at[head], sizes)).astype(np.int32)
    left = m[row[head]] - at[head]
    ends, lo = np.cumsum(left), 0
    while lo < len(head):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        n = left[lo:hi]
        numbers = flat[np.repeat(head[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        mine = own[heads[lo] : heads[lo] + sizes[lo:hi].sum()]
        parts = [pa.ListArray.from_arrays(np.append(0, np.cumsum(k)).astype(np.int32), pa.array(v)) for k, v in ((sizes[lo:hi], mine), (n, numbers))]
        yield pa.RecordBatch.from_arrays([pa.array((flat[head[lo:hi]] % tasks).astype(np.int32)), pa.array(g[row[head[lo:hi]]]), *parts], ["t", "g", "own", "l"])
        lo = hi


def _count(batches: Iterator[pa.RecordBatch], steps: dict, least: int, share: float, groups: bool) -> Iterator[pa.RecordBatch]:
    """Counts the pairs of a partition, which holds all lists of its keys, in slices of whole keys."""
    held, size = [], 0
    for batch in batches:
        g, first, last = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("g", "first", "last"))
        (own, q), (m, flat) = ((x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), x.flatten().to_numpy(zero_copy_only=False)) for x in (batch.column("own"), batch.column("l")))
        row = np.repeat(np.arange(len(g)), own)
        start = (np.cumsum(m) - m)[row] + q
        a, n = flat[start].astype(np.int64), m[row] - q - 1
        start += 1
        span = np.maximum(last.astype(np.int64) - first + 1, 0)[row]
        if span.any():  # a range instead of a list
            start = np.where(span > 0, len(flat) + np.cumsum(span) - span, start)
            flat = np.concatenate([flat, np.repeat(first[row] - (np.cumsum(span) - span), span) + np.arange(span.sum())])
            n += span
        held.append((a, g[row].astype(np.int64), n, start + size, flat.astype(np.int32), (span == 0).astype(np.int64)))
        size += len(flat)
    if not held:
        return
    a, g, n, start, flat, weight = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(a, kind="stable")
    ends = np.cumsum(n[order])
    turns = np.append(np.flatnonzero(np.diff(a[order])) + 1, len(order))  # where a key ends
    lo = 0
    while lo < len(order):
        before = ends[lo - 1] if lo else 0
        fit = turns[(turns > lo)]
        fit = fit[max(0, np.searchsorted(ends[fit - 1], before + SLICE, "right") - 1)]
        w = order[lo:fit]
        lo = fit
        m = n[w]
        if not m.sum():
            continue
        row = np.repeat(w, m)
        b = flat[np.repeat(start[w] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        codes = (a[row] << 32) | b
        by = np.argsort(codes, kind="stable")
        codes = codes[by]
        heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        x, y = codes[heads] >> 32, codes[heads] & 0xFFFFFFFF
        i, j = (np.searchsorted(steps["first"], v, "right") - 1 for v in (x, y))
        both = steps["mask"][i] & steps["mask"][j]
        common = np.add.reduceat(weight[row][by], heads) + POP[both]
        ok = (common >= least) & (common / (steps["size"][i] + steps["size"][j] - common) >= share)
        if not groups:
            yield pa.RecordBatch.from_arrays([pa.array(v[ok].astype(np.int32)) for v in (x, y, common)], ["a", "b", "n"])
            continue
        pair = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(codes))))
        listed = ok[pair] & (weight[row][by] > 0)
        out = [(x[pair[listed]], y[pair[listed]], g[row][by][listed])]
        for bit in range(LARGEST):
            has = ok & (both >> bit & 1 > 0)
            out.append((x[has], y[has], np.full(has.sum(), -1 - bit)))
        ab_g = [np.concatenate(v) for v in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(ab_g[0].astype(np.int32)), pa.array(ab_g[1].astype(np.int32)), pa.array(ab_g[2].astype(np.int64))], ["a", "b", "g"])
