"""Which documents contain passages of held-out evaluation items, and of which items.

The items have an inverted index, a table of postings that is queried with every passage of every
document in one pass. Its terms are shingles of five words, its impacts BM25 weights, and all items above a
threshold are retrieved. The threshold loses nothing: in a passage that holds ``span`` words of an item,
each edited word takes away five shingles at most, so the passage scores at least the lightest such
stretch of the item without its heaviest shingles, five for each edit. Impacts are divided by that bound,
so that 1 is the threshold of every item. As in WAND, the terms of a passage are put in order of their
largest impact in any item, and the pivot is the first at which their sum reaches 1: an item that holds
none of the terms from the pivot on can't reach the threshold. So only the postings from the pivot on are
joined, and an item is kept if its impacts there and the bound of all terms before reach 1.

Before that, a passage must hold enough shingles of any item at all, by a Bloom filter of at most
2^26 bits; what it lets through wrongly finds no postings. What is retrieved is then verified by alignment:
does the passage hold ``span`` consecutive words of the item, question and answer alike, with at most one in
ten changed, dropped or added?
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialized

SHINGLE = 5  # words
FILTER_BITS = 26  # the filter has 2^26 bits (8 MB) at most
BROADCAST_ITEMS = 20_000  # items whose words are broadcast, at most 2,000 words each; more are joined by shuffle
KNOWN = 500_000  # words whose numbers a task keeps

# Cyrillic and Greek letters that look like Latin ones, and Latin letters that decomposition leaves alone.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝвкмнтαοενιρτυχκ", "aeopcyxijshdqwbkmhtaoeviptyxk")
SPECIAL = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "ß": "ss"})
INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|font|a|mark|small|sub|sup|code)\b[^<>]*>|\*\*|~~|`", re.I)
TAG = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->", re.I | re.S)
BROKEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, accents and other ways to write the same letters."""
    if not text:
        return []
    if "<" in text or "*" in text or "~" in text or "`" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not (c > "\x7f" and unicodedata.category(c) in ("Mn", "Me", "Cf")))
        text = text.lower().translate(SPECIAL)
        if not text.isascii():
            text = " ".join(w if w.isascii() else _latin(w) for w in text.split(" "))
        text = text.replace("’", "'")
    if "\n" in text:
        text = BROKEN.sub("", text)
    return WORD.findall(text.lower().replace("'", ""))


def _latin(word: str) -> str:
    """Look-alikes as Latin letters, in words that hold Latin letters or consist of look-alikes only."""
    latin = word.translate(LOOKALIKES)
    return latin if latin.isascii() or re.search("[a-z]", word) else word


class Numbers(dict):
    """A 64-bit number for every word; a task keeps those of the last ``KNOWN`` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self[w] for w in words(text)], dtype=np.uint64)


def shingles(numbers: np.ndarray) -> np.ndarray:
    """A 64-bit number for every five consecutive word numbers; equal shingles have equal numbers."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(numbers) - SHINGLE + 1), dtype=np.uint64)
        for k in range(SHINGLE):
            out = (out ^ numbers[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _signed(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _unsigned(column: pa.ListArray) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])]


def stretches(span: int, share: float) -> list[tuple[int, int]]:
    """(edits, words): for every number of edits that can decide, the length of the shortest stretch that may have so many."""
    first, last = int(span * share + 1e-9), int((2 * span - 1) * share + 1e-9)
    return [(e, max(span, math.ceil(e / share - 1e-9) if e else 0)) for e in range(first, last + 1)]


def _item_words(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            coded = [numbers.of(t) for t in batch.column(1).to_pylist()]
            long = [i for i, c in enumerate(coded) if len(c) >= span]  # a shorter item can't be found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long, pa.int64())), _signed([coded[i] for i in long]), _signed([shingles(coded[i]) for i in long])], names=["item", "words", "shingles"])

    return run


def _impacts(span: int, share: float):
    """Per item its terms' weights divided by the item's bound: the least that any stretch keeps after its edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry, order, terms, weights in zip(*(batch.column(i).to_pylist() for i in range(4))):
                of, least = dict(zip(terms, weights)), math.inf
                for edits, length in stretches(span, share):
                    length -= SHINGLE - 1
                    for s in range(len(order) - length + 1):
                        held = sorted((of[t] for t in set(order[s : s + length])), reverse=True)
                        least = min(least, sum(held[SHINGLE * edits :]))
                bound = max(least * (1 - 1e-9), 1e-6)
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.int64()), "entry": pa.array([entry] * len(terms), pa.int64()), "impact": pa.array([w / bound for w in weights], pa.float64())})

    return run


def build_index(items: DataFrame, item_id: str, text: str, span: int = 20, share: float = 0.1, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(entry, item, words) of the items of at least ``span`` words, and the postings (term, entry, impact)."""
    kind = items.schema[item_id].dataType.simpleString()
    given = items.select(item_id, text).dropna().distinct()
    entries = given.mapInArrow(_item_words(span), f"item {kind}, words array<long>, shingles array<long>").withColumn("entry", F.monotonically_increasing_id())
    entries = materialized(entries, "items")
    n, mean = entries.agg(F.count("*"), F.avg(F.size("shingles"))).first()
    held = entries.select("entry", F.size("shingles").alias("length"), F.explode("shingles").alias("term")).groupBy("entry", "length", "term").agg(F.count("*").cast("double").alias("tf"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean or 1.0))))
    weighted = held.join(df, "term").groupBy("entry").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("w"))  # the terms of one item's text
    ready = weighted.join(entries, "entry").select("entry", "shingles", "w.term", "w.weight")
    postings = materialized(ready.mapInArrow(_impacts(span, share), "term long, entry long, impact double"), "postings")
    return entries.select("entry", "item", "words"), postings


def _positions(shift: int, bits: int) -> Column:
    return F.shiftrightunsigned("term", shift).bitwiseAND(F.lit((1 << bits) - 1))


def term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms, three bits each: 16 bits for every term up to 2^``FILTER_BITS``."""
    bits = min(FILTER_BITS, max(10, (16 * terms.count()).bit_length()))
    at = terms.select(F.explode(F.array(*[_positions(s, bits) for s in (0, 21, 38)])).alias("at"))
    words_ = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for part in words_.toLocalIterator():  # at most 2^20 rows, whatever the number of terms
        out[part["word"]] = part["bits"] % 2**64
    return out


def _passing(table: np.ndarray, terms: np.ndarray) -> np.ndarray:
    mask, keep = np.uint64(64 * len(table) - 1), np.ones(len(terms), dtype=bool)
    for shift in (0, 21, 38):
        at = (terms >> np.uint64(shift)) & mask
        keep &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return keep


def holds(passage: np.ndarray, item: np.ndarray, span: int = 20, share: float = 0.1) -> bool:
    """Does ``passage`` hold at least ``span`` consecutive words of ``item`` with at most ``share`` of them edited?

    A longer stretch can be halved until it is shorter than two spans, one half being no worse
    than the whole, so stretches of 20 to 39 words with 2 or 3 edits decide. From every pair of equal words that doesn't continue another, the stretch is
    extended as far as each number of edits allows, diagonal by diagonal. Edits that are left
    over may stand for changed words at either end.
    """
    n, m = len(item), len(passage)
    equal = item[:, None] == passage[None, :]
    if equal.any(axis=1).sum() < span * (1 - share) - 1:
        return False
    begins = equal.copy()
    begins[1:, 1:] &= ~equal[:-1, :-1]
    most = int((2 * span - 1) * share + 1e-9)
    # run[i, j]: how many equal words follow from (i, j) on along the diagonal
    run = np.zeros((n + 1, m + 1), dtype=np.int32)
    for i in range(n - 1, -1, -1):
        run[i, :m] = np.where(equal[i], run[i + 1, 1:] + 1, 0)

    def enough(length: int, used: int) -> bool:
        return any(length + min(e - used, n - length) >= max(span, math.ceil(e / share - 1e-9)) for e in range(used, most + 1))

    for i0, j0 in zip(*(x.tolist() for x in np.nonzero(begins))):
        reach = {0: i0 + int(run[i0, j0])}  # by diagonal (passage minus item), the item word after the stretch
        for used in range(most + 1):
            if enough(max(reach.values()) - i0, used):
                return True
            if used == most:
                break
            further: dict[int, int] = {}
            for d, i in reach.items():
                for nd, ni in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # changed, dropped, added
                    j = j0 + (ni - i0) + nd
                    if ni > n or j > m or j < 0:
                        continue
                    ni += int(run[ni, j])
                    if ni > further.get(nd, -1):
                        further[nd] = ni
            reach = {**reach, **{d: max(i, reach.get(d, -1)) for d, i in further.items()}}
    return False


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = 20, share: float = 0.1) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least ``span`` consecutive words of an item.

    At most ``share`` of these words may be changed, dropped or added. Items that share a passage
    are all found. Documents are read once, whole, passage by passage; what is moved are the passages
    that hold words of some item. Null and empty texts, and texts of fewer words, are no
    cases; empty tables give no rows; rows repeated give one row.
    """
    kinds = [documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    entries, postings = build_index(items, item_id, text, span, share)
    terms = materialized(postings.groupBy("term").agg(F.max("impact").alias("most")), "terms")
    schema = f"doc {kinds[0]}, words array<long>, terms array<long>"
    found = documents.select(doc_id, text).mapInArrow(_passages(term_filter(terms), span, share), schema)
    passages = materialized(found.withColumn("passage", F.monotonically_increasing_id()), "passages")

    hits = passages.select("passage", F.explode("terms").alias("term")).join(terms, "term")
    rising = Window.partitionBy("passage").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)  # the terms of one passage
    bounded = hits.withColumn("bound", F.sum("most").over(rising))
    before = F.max(F.when(F.col("bound") < 1, F.col("bound"))).over(Window.partitionBy("passage"))
    pivoted = bounded.withColumn("before", F.coalesce(before, F.lit(0.0))).filter(F.col("bound") >= 1)
    scored = pivoted.join(postings, "term").groupBy("passage", "entry").agg((F.sum("impact") + F.max("before")).alias("most"))
    candidates = scored.filter(F.col("most") >= 1 - 1e-6)

    of_item = entries.select("entry", "item", F.col("words").alias("item_words"))
    few = entries.filter(F.size("words") > 2000).isEmpty() and entries.count() <= BROADCAST_ITEMS
    pairs = candidates.join(passages.select("passage", "doc", "words"), "passage").join(F.broadcast(of_item) if few else of_item, "entry")
    ordered = pairs.repartition("doc", "entry").sortWithinPartitions("doc", "entry", F.col("most").desc(), "passage")
    verified = ordered.select("doc", "item", "entry", "words", "item_words").mapInArrow(_verified(span, share, [doc_id, item_id]), f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}")
    return verified.distinct()


def _passages(table: np.ndarray, span: int, share: float):
    step = span + 2
    width = 2 * span - 1 + int((2 * span - 1) * share) + step  # holds any stretch of up to 39 words and its edits whole
    need = max(1, min(length - SHINGLE + 1 - SHINGLE * edits for edits, length in stretches(span, share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            docs, held, terms = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                coded = numbers.of(t)
                hashed = shingles(coded)
                at = np.flatnonzero(_passing(table, hashed))
                if len(at) < need:
                    continue
                # passage p holds the shingles that start at p * step ... p * step + width - SHINGLE
                for p in np.unique(at // step):
                    for q in range(max(0, int(p) - width // step), int(p) + 1):
                        low, high = np.searchsorted(at, [q * step, q * step + width - SHINGLE + 1])
                        if high - low >= need and (not docs or (docs[-1], last) < (i, q)):
                            docs.append(i)
                            held.append(coded[q * step : q * step + width])
                            terms.append(np.unique(hashed[at[low:high]]))
                            last = q
            if docs:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), _signed(held), _signed(terms)], names=["doc", "words", "terms"])

    return run


def _verified(span: int, share: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the pair found last; its other passages needn't be aligned
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            keep = []
            for i, (passage, item) in enumerate(zip(_unsigned(batch.column(3)), _unsigned(batch.column(4)))):
                if keys[i] != last and holds(passage, item, span, share):
                    keep.append(i)
                    last = keys[i]
            if keep:
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=names)

    return run


def leak_report(found: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """How many documents hold passages of each leaked item."""
    return found.groupBy(item_id).agg(F.count_distinct(doc_id).alias("documents"))
