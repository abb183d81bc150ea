"""How often every term (or n-gram of terms) occurs, and in how many records.

Suffix sorting: every record gives, at each term, the suffix that starts there, cut to ``max_n``
terms. Equal suffixes are summed before they are routed by their first terms and sorted in
reverse lexicographic order; a stack then holds the terms of the suffix at hand and emits each
n-gram, with all counts of the suffixes it begins, as soon as no later suffix can begin with it.

Record counts need no sets of record ids: a suffix remembers from which length on its prefixes
are new to its record (a longer prefix of a new one is new, too). The records of an n-gram are
then the suffixes that begin with it and for which it is new, which is a sum like the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialized

TERM = re.compile("[a-z]+")
FLUSH = 200_000  # distinct suffixes held by a task before it passes on their counts


def _suffixes(max_n: int, flush: int):
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"suffix": pa.array([s for s, _ in counts], pa.string()), "new_from": pa.array([f for _, f in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts["", 0] += 1  # the empty n-gram: one per record
                terms = TERM.findall(text.lower())
                if max_n == 1:
                    for t, k in Counter(terms).items():
                        counts[t, 1] += 1
                        if k > 1:
                            counts[t, 2] += k - 1
                else:
                    seen: set[str] = set()
                    for i in range(len(terms)):
                        window = terms[i : i + max_n]
                        new_from = len(window) + 1
                        for size in range(len(window), 0, -1):
                            gram = " ".join(window[:size])
                            if gram in seen:
                                break
                            seen.add(gram)
                            new_from = size
                        counts[" ".join(window), new_from] += 1
                if len(counts) >= flush:
                    yield out(counts)
                    counts.clear()
            if len(counts) >= flush:
                yield out(counts)
                counts.clear()
        if counts:
            yield out(counts)

    return run


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all n-grams of one partition, whose rows come in reverse lexicographic order.

    An n-gram that begins the first or the last suffix of the partition may go on in a
    neighbouring one; it is marked open, and open ones are summed once more.
    """
    stack: list[list] = [[[], 0, 0]]  # per depth: the terms so far, occurrences, records
    out: list[tuple] = []
    first: list[str] | None = None

    def pop(last: bool) -> None:
        terms, occurrences, records = stack.pop()
        begins = first[: len(terms)] == terms
        out.append((" ".join(terms), len(terms), occurrences, records, begins or last))
        stack[-1][1] += occurrences

    def table() -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())], names=["gram", "terms", "occurrences", "records", "open"])

    for batch in batches:
        for suffix, new_from, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            terms = suffix.split(" ") if suffix else []
            if first is None:
                first = terms
            if not terms:
                out.append(("", 0, n, n, True))
                continue
            same = 0
            while same < len(terms) and same + 1 < len(stack) and stack[same + 1][0][-1] == terms[same]:
                same += 1
            while len(stack) > same + 1:
                pop(False)
            for size in range(same + 1, len(terms) + 1):
                stack.append([terms[:size], 0, 0])
            stack[-1][1] += n
            for size in range(max(new_from, 1), len(terms) + 1):
                stack[size][2] += n
        if len(out) > 50_000:
            yield table()
            out.clear()
    while len(stack) > 1:
        pop(True)
    if out:
        yield table()


def ngram_frequencies(records: DataFrame, text: str, max_n: int = 1, flush: int = FLUSH) -> DataFrame:
    """(gram, terms, occurrences, records) of every n-gram of 1 to ``max_n`` terms.

    A term is a longest run of letters a-z in the lower-cased text; a row of ``records`` is a
    record. A null text is no record; an empty one, or one without letters, is a record without
    terms. The row with 0 terms and the empty gram counts all records. Repeated rows are records
    of their own; other columns are ignored. An empty table gives no rows.
    """
    texts = records.select(F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    local = texts.mapInArrow(_suffixes(max_n, flush), "suffix string, new_from int, n long")
    summed = local.groupBy("suffix", "new_from").agg(F.sum("n").alias("n"))
    routed = summed.repartitionByRange(F.col("suffix").desc()).sortWithinPartitions(F.col("suffix").desc(), "new_from")
    grams = routed.mapInArrow(_stack, "gram string, terms int, occurrences long, records long, open boolean")
    return _closed(grams)


def _closed(grams: DataFrame) -> DataFrame:
    done = grams.filter(~F.col("open")).drop("open")
    open_ = grams.filter("open").groupBy("gram", "terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return done.unionByName(open_)


def marked_terms(records: DataFrame, text: str, rare: int = 2, common: float = 0.2, max_n: int = 1) -> DataFrame:
    """``ngram_frequencies`` without the row of 0 terms, with ``mark``: ``rare`` (in at most ``rare``
    records), ``common`` (in more than the share ``common`` of all records with a text) or null.

    In a collection so small that both hold, a term is ``rare``.
    """
    counted = materialized(ngram_frequencies(records, text, max_n), "grams")
    total = counted.filter("terms = 0").agg(F.sum("records")).first()[0] or 0
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common * total), "common")
    return counted.filter("terms > 0").withColumn("mark", mark)
