"""How characteristic a term is of a record, by probabilistic relevance weighting.

    score = idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length))

The term frequency saturates with k1, and b normalises it by the length of the record. With
``k1=inf`` the saturation is gone and the fraction becomes tf / (1 - b + b * length / average);
with b = 1, the largest term count as the length and an average of 1 that is tf / max tf. With
``idf="log2"`` this limit of the weighting is the classic n / m * log2(N / d).

Terms are counted where the texts are read, before anything is moved by record: a task passes on a
row of packed counts per record. The counts of a record are then brought together by its key. Records of
more than ``LARGE`` counts to be summed (a number bounded by size, however many rows a record has)
are summed by (record, term) instead, so that no task holds such a record whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialized

PACK = 4096  # counts in a row of packed counts
HELD = 300_000  # counts a task holds before it passes them on
LARGE = 1_000_000  # counts of a record that are summed within one task
BROADCAST_RECORDS, BROADCAST_TERMS = 100_000, 400_000  # tables of up to so many rows are broadcast, larger ones joined by shuffle: some 10 MB


PACKED = "terms string, counts string, size int"  # terms and counts with blanks between, as compact as the text they are from


def _packed(kind: pa.DataType, rows: list[tuple[object, dict[str, int]]]) -> pa.RecordBatch:
    keys, terms, counts, sizes = [], [], [], []
    for key, counted in rows:
        held, numbers = list(counted), list(counted.values())
        for i in range(0, len(held), PACK):
            part = numbers[i : i + PACK]
            keys.append(key)
            terms.append(" ".join(held[i : i + PACK]))
            counts.append(" ".join(map(str, part)))
            sizes.append(len(part))
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(terms, pa.string()), pa.array(counts, pa.string()), pa.array(sizes, pa.int32())], names=["record", "terms", "counts", "size"])


def _count_terms(pattern: str, held: int):
    """Rows (record, text) in any order to packed term counts, one row per record as far as ``held`` counts reach."""
    term = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[object, Counter] = {}
        size, kind = 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted = counts.get(record)
                if counted is None:
                    counted = counts[record] = Counter()
                size -= len(counted)
                counted.update(term.findall(text.lower()))
                size += len(counted)
                if size >= held:
                    yield _packed(kind, list(counts.items()))
                    counts.clear()
                    size = 0
        if counts:
            yield _packed(kind, list(counts.items()))

    return run


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts sorted by record to those of each record summed."""
    out, size, now, counted, kind = [], 0, None, None, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for record, terms, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if counted is None or (record != now and (record == record or now == now)):  # NaN is one record
                if counted is not None:
                    out.append((now, counted))
                    size += len(counted)
                    if size > 100_000:
                        yield _packed(kind, out)
                        out, size = [], 0
                now, counted = record, dict(zip(terms.split(" "), map(int, counts.split(" "))))
            else:
                for t, n in zip(terms.split(" "), map(int, counts.split(" "))):
                    counted[t] = counted.get(t, 0) + n
    if counted is not None:
        yield _packed(kind, [*out, (now, counted)])


def _small(table: DataFrame, most: int) -> DataFrame:
    """A table to be joined: broadcast if it has at most ``most`` rows, which is counted."""
    return F.broadcast(table) if table.count() <= most else table


def term_counts(texts: DataFrame, record: str, text: str, min_letters: int = 1, large: int = LARGE, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Term counts of ordinary records as packed rows (record, terms, counts) and of large records as
    rows (record, term, n). Rows with a null record or text are left out."""
    rows = texts.select(F.col(record).alias("record"), F.col(text).alias("text")).dropna()
    kind = rows.schema["record"].dataType.simpleString()
    schema = f"record {kind}, {PACKED}"
    local = materialized(rows.mapInArrow(_count_terms("[a-z]{%d,}" % min_letters, held), schema), "counts")
    sizes = local.groupBy("record").agg(F.sum("size").alias("size")).filter(F.col("size") > large).select("record")
    hot = _small(materialized(sizes, "large"), BROADCAST_RECORDS)
    packed = local.join(hot, "record", "left_anti").repartition("record").sortWithinPartitions("record").mapInArrow(_merge_counts, schema)
    return packed, unpacked(local.join(hot, "record", "left_semi")).groupBy("record", "term").agg(F.sum("n").alias("n"))


def unpacked(packed: DataFrame) -> DataFrame:
    both = F.arrays_zip(F.split("terms", " ").alias("term"), F.split("counts", " ").alias("n"))
    return packed.select("record", F.inline(both)).select("record", "term", F.col("n").cast("long").alias("n"))


def characteristic_terms(
    texts: DataFrame, record: str, text: str, top: int, stop_words: DataFrame | None = None, min_letters: int = 1, min_records: int = 1,
    k1: float = 1.2, b: float = 0.75, length: str = "sum", idf: str = "bm25", large: int = LARGE,
) -> DataFrame:
    """The ``top`` terms of every record with a score above 0: (record, term, n, length, records, score, position).

    ``texts`` has any number of rows per record. Stop words (column ``word``, trimmed and
    lower-cased here), terms of fewer than ``min_letters`` letters or in fewer than ``min_records``
    records are no terms at all: they count neither for lengths nor for the number of records.
    ``length`` is the record's number of terms (``sum``) or its largest term count (``max``).
    Scores are rounded to 9 decimals; among equals the term first in order comes first. Records
    without terms, and an empty table, give no rows; null records or texts are left out; other
    columns are ignored and repeated rows count as often as they occur.
    """
    packed, hot = term_counts(texts, record, text, min_letters, large)
    packed, hot = materialized(packed, "packed"), materialized(hot, "hot")
    vocabulary = unpacked(packed).select("term").unionByName(hot.select("term")).groupBy("term").agg(F.count("*").alias("records")).filter(F.col("records") >= min_records)
    if stop_words is not None:
        vocabulary = vocabulary.join(stop_words.select(F.lower(F.trim("word")).alias("term")).distinct(), "term", "left_anti")
    vocabulary = materialized(vocabulary, "vocabulary")
    # By a 64-bit number of the term a broadcast table takes some 30 bytes a row, whatever the terms' length.
    numbered = vocabulary.select(F.xxhash64("term").alias("number"), "records")
    few = vocabulary.count() <= BROADCAST_TERMS and numbered.select("number").distinct().count() == vocabulary.count()

    def known(rows: DataFrame) -> DataFrame:
        if not few:
            return rows.join(vocabulary, "term")
        return rows.withColumn("number", F.xxhash64("term")).join(F.broadcast(numbered), "number").drop("number")

    ordinary = lambda rows: known(unpacked(rows))
    extreme = known(hot)
    of = F.max("n") if length == "max" else F.sum("n")
    lengths = lambda rows: rows.groupBy("record").agg(of.alias("length"))
    n_records, mean = lengths(ordinary(packed)).unionByName(lengths(extreme)).agg(F.count("*"), F.avg("length")).first()
    unit = 1.0 if length == "max" else float(mean or 1.0)
    score = _score(float(n_records), unit, k1, b, idf)
    best = Window.partitionBy("record").orderBy(F.col("score").desc(), F.col("term"))

    def ranked(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("score", F.round(score, 9)).filter("score > 0")
        return scored.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= top).select("record", "term", "n", "length", "records", "score", "position")

    in_place = ordinary(packed.repartition("record")).withColumn("length", of.over(Window.partitionBy("record")))
    return ranked(in_place).unionByName(ranked(extreme.join(_small(materialized(lengths(extreme), "lengths"), BROADCAST_RECORDS), "record")))


def _score(n_records: float, unit: float, k1: float, b: float, idf: str) -> Column:
    n, d, rel = F.col("n").cast("double"), F.col("records").cast("double"), F.col("length").cast("double") / unit
    norm = rel if b == 1 else (1 - b) + b * rel
    tf = n / norm if math.isinf(k1) else n * (k1 + 1) / (n + k1 * norm)
    if idf == "log2":
        return tf * F.log2(F.lit(n_records) / d)
    return tf * F.log1p((F.lit(n_records) - d + 0.5) / (d + 0.5))
