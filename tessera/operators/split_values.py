"""Several values packed in one field, split into one row per value with its position.

Works on the bytes of a whole Arrow string column at once. Masks over the bytes say where quotes
stand that count (parity of double quotes, depth of curly ones, single quotes at the borders of
list elements), and so which delimiters lie outside quotes. These cut the buffer into values,
whose ends are then moved over blanks and quotes by index arrays; counts of values per row give
the offsets of a list array, which is flattened with the rows' ordinals.

Rules (all results are defined for any input):
* delimiters: ``, ; | / TAB LF CR`` and the characters ``、 ， ； ｜ ·``, inside brackets of a list as outside;
* a value is quoted by ``"``, by curly quotes or, in list notation ``[...]``, by ``'``; what is
  quoted is one value; a doubled quote or one after a backslash is part of it;
* a field with an odd number of double quotes, or curly ones that don't match, has no valid
  quoting of that kind: these quotes are then ordinary characters of its values;
* blanks of any kind around a value are dropped, empty values take no position;
* null, empty and blank fields, and an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", ";", "|", "/", "\t", "\n", "\r", "、", "，", "；", "｜", "·")
# The blanks of Unicode, with the zero-width space and the byte-order mark.
BLANKS = tuple(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
BATCH = 100_000
QUOTE, SINGLE, BACKSLASH, OPEN, CLOSE = b'"'[0], b"'"[0], b"\\"[0], b"["[0], b"]"[0]


def _where(data: np.ndarray, characters: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the first byte, and of all bytes, of each occurrence of the characters."""
    first, whole = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    by_length: dict[int, list[bytes]] = {}
    for c in characters:
        by_length.setdefault(len(c.encode()), []).append(c.encode())
    for size, forms in by_length.items():
        if len(data) < size:
            continue
        if size == 1:
            table = np.zeros(256, dtype=bool)
            table[[f[0] for f in forms]] = True
            first |= table[data]
            whole |= table[data]
            continue
        for form in forms:
            at = data[: len(data) - size + 1] == form[0]
            for i in range(1, size):
                at &= data[i : len(data) - size + 1 + i] == form[i]
            found = np.flatnonzero(at)
            first[found] = True
            for i in range(size):
                whole[found + i] = True
    return first, whole


def split_buffer(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of a string column: (values, row of each value, its position from 1)."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    base, end = int(raw[0]), int(raw[-1])
    offsets = raw - base
    if end == base:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[base:end]
    size = len(data)
    index = np.arange(size, dtype=np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    starts, ends = offsets[:-1], offsets[1:]

    _, blank = _where(data, BLANKS)
    # The next and the previous byte that isn't blank, from each place on.
    after = np.minimum.accumulate(np.where(blank, size, index)[::-1])[::-1]
    after = np.append(after, size)
    before = np.maximum.accumulate(np.where(blank, -1, index))
    full = after[starts] < ends  # rows that aren't blank
    head, tail = np.where(full, after[starts], 0), np.where(full, before[np.maximum(ends - 1, 0)], 0)
    listed = full & (data[head] == OPEN) & (data[tail] == CLOSE) & (head < tail)

    def counted(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per byte, how many of the mask come before it in its row; and per row, how many in all."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[:-1] - total[starts][row], total[ends] - total[starts]

    # Quotes after an odd run of backslashes belong to the value.
    slash = data == BACKSLASH
    run = index - np.maximum.accumulate(np.where(slash, -1, index))
    escaped = np.zeros(size, dtype=bool)
    escaped[1:] = (run[:-1] % 2 == 1) & (row[1:] == row[:-1])
    double = (data == QUOTE) & ~escaped
    n_before, n_all = counted(double)
    double &= (n_all % 2 == 0)[row]
    parity = np.where((n_all % 2 == 0)[row], n_before, 0) % 2
    in_double = parity == 1

    left, left_all = _where(data, ("“",))
    right, right_all = _where(data, ("”",))
    lefts, n_left = counted(left & ~in_double)
    rights, n_right = counted(right & ~in_double)
    matched = (n_left == n_right)[row]
    in_curly = matched & (lefts > rights)

    delimiter, delimiter_all = _where(data, DELIMITERS)
    # Single quotes count in lists only, next to a bracket or a delimiter.
    single = (data == SINGLE) & ~escaped & listed[row] & ~in_double
    if single.any():
        at = np.flatnonzero(single)
        p, q = before[np.maximum(at - 1, 0)], np.minimum(after[at + 1], size - 1)
        opens = (p == head[row[at]]) | ((p >= 0) & delimiter_all[np.maximum(p, 0)])
        closes = (q == tail[row[at]]) | delimiter_all[q]
        single[at] = opens | closes
    s_before, s_all = counted(single)
    in_single = (s_all % 2 == 0)[row] & (s_before % 2 == 1)

    cut = delimiter & ~in_double & ~in_curly & ~in_single
    bracket = np.zeros(size, dtype=bool)
    bracket[head[listed]] = True
    bracket[tail[listed]] = True
    cut |= bracket
    # A value begins at the start of its row and after every cut, and ends before the next of them.
    width = np.ones(size, dtype=np.int64)
    for c in DELIMITERS:
        if (w := len(c.encode())) > 1:
            width[np.flatnonzero(_where(data, (c,))[0])] = w
    at = np.flatnonzero(cut)
    begin = np.concatenate([starts, at + width[at]])
    owner = np.concatenate([np.arange(n), row[at]])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    stop = np.append(begin[1:], size)
    last = np.append(owner[1:] != owner[:-1], True)
    stop = np.where(last, ends[owner], stop)
    inner = ~last
    # the next value begins after a delimiter, whose bytes aren't part of this one
    cuts_in_order = at[np.argsort(row[at], kind="stable")]
    stop[inner] = cuts_in_order

    def trimmed(b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.minimum(after[np.minimum(b, size)], e)
        e2 = np.where(e > 0, before[np.maximum(e - 1, 0)] + 1, 0)
        return b, np.maximum(b, np.minimum(e, np.where(e2 > b, e2, b)))

    begin, stop = trimmed(begin, stop)
    filled = begin < stop
    begin, stop, owner = begin[filled], stop[filled], owner[filled]
    if not len(begin):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    final = stop - 1
    long_enough = stop - begin >= 2
    by_double = long_enough & double[begin] & double[final]
    by_single = long_enough & single[begin] & single[final]
    by_curly = (stop - begin >= 6) & left[begin] & right[np.maximum(stop - 3, 0)] & matched[begin]
    begin = begin + np.where(by_double | by_single, 1, 0) + np.where(by_curly, 3, 0)
    stop = stop - np.where(by_double | by_single, 1, 0) - np.where(by_curly, 3, 0)
    begin, stop = trimmed(begin, stop)
    filled = begin < stop
    begin, stop, owner, by_double, by_single = begin[filled], stop[filled], owner[filled], by_double[filled], by_single[filled]

    # Within quotes, of a doubled quote the first and of an escape the backslash is dropped.
    def within(quoted: np.ndarray) -> np.ndarray:
        depth = np.zeros(size + 1, dtype=np.int64)
        np.add.at(depth, begin[quoted], 1)
        np.add.at(depth, stop[quoted], -1)
        return np.cumsum(depth[:-1]) > 0

    inside = within(by_double | by_single)
    drop = within(by_double) & double & in_double
    escape = np.zeros(size, dtype=bool)
    escape[:-1] = slash[:-1] & ~escaped[:-1] & ((data[1:] == QUOTE) | (data[1:] == SINGLE) | (data[1:] == BACKSLASH))
    drop |= inside & escape

    lengths = stop - begin
    sums = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(sums[-1]) - np.repeat(sums[:-1] - begin, lengths)
    kept = ~drop[source]
    kept_sums = np.concatenate([[0], np.cumsum(kept)])
    value_offsets = kept_sums[sums].astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(value_offsets.tobytes()), pa.py_buffer(data[source[kept]].tobytes())).cast(pa.string())
    # Children per row give the offsets of the list array; its flattening gives the rows' ordinals.
    child_offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    lists = pa.LargeListArray.from_arrays(pa.array(child_offsets, pa.int64()), values)
    parent = np.repeat(np.arange(n), np.diff(child_offsets))
    return lists.flatten(), parent, np.arange(len(parent)) - child_offsets[parent] + 1


def split_values(df: DataFrame, field: str, value: str = "value", position: str = "pos") -> DataFrame:
    """One row per value packed in ``field``, with its ``position`` from 1; the other columns are repeated.

    The field itself is left out. No shuffle: every row is split where it is. An existing column
    ``value`` or ``position`` is replaced. A field of any length is split whole; its row gives
    batches of at most ``BATCH`` values.
    """
    keep = [c for c in df.columns if c not in (field, value, position)]
    rows = df.select(*keep, F.col(field).cast("string").alias("__field"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(position, T.IntegerType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, parent, at = split_buffer(batch.column(len(keep)))
            for i in range(0, len(parent), BATCH):
                part = slice(i, i + BATCH)
                rows = pa.array(parent[part])
                columns = [c.take(rows) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at[part].astype(np.int32)), values.slice(i, len(rows))], names=[*keep, position, value])

    return rows.mapInArrow(run, schema)



def business_categories(business: DataFrame) -> DataFrame:
    """(business_id, pos, category) of every business, which counts once: its first row, for rows sent again."""
    once = business.groupBy("business_id").agg(F.min_by("categories", F.struct("updated_at", "categories")).alias("categories"))
    return split_values(once, "categories", "category", "pos").select("business_id", "pos", "category")
