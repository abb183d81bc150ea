"""Byte-level BPE of a public tokenizer, exact and in linear time per piece.

The token sequence that the merges of byte-level BPE give is the only one in which every pair of
adjacent tokens is compatible: re-encoding the two tokens' bytes together gives those two tokens.
So a piece is encoded from left to right by the longest token that begins at each place (found
with an Aho-Corasick trie over the tokens, their bytes mapped to Latin-1); where a token isn't
compatible with the one before, the next shorter one is tried, and where none is left the token
before is taken back and its place marked as a dead end, so that no place is tried twice.
Compatibility follows from the merge table and is memoised, as are the encodings of short pieces.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pattern by which the tokenizer cuts texts into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_PIECES, MEMO_LENGTH, MEMO_PAIRS = 200_000, 64, 1_000_000


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its public rule:
    printable Latin-1 characters stand for themselves, the other bytes, in order, for 256 and up."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names = {chr(b): b for b in own}
    for i, b in enumerate(x for x in range(256) if x not in set(own)):
        names[chr(256 + i)] = b
    return names


class BytePairEncoder:
    def __init__(self, path: str = DEFAULT_VOCABULARY):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names = _byte_names()
        raw = lambda token: "".join(chr(names[c]) for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.text = {i: t for t, i in self.ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = (self.ids[raw(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = self.ids[self.text[left] + self.text[right]]
            self.merged.setdefault((left, right), r)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), r
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.trie.add_word(t, i)
        self.widest = max(map(len, self.ids))
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.find = regex.compile(PIECES).findall

    def longest(self, piece: str, at: int, limit: int | None = None) -> int:
        """The id of the longest token that begins at ``at``; -1 if there is none (shorter than ``limit``)."""
        end = at + self.trie.longest_prefix(piece[at : at + self.widest])
        if limit is not None:
            end = min(end, at + limit - 1)
        while end > at:
            if (i := self.ids.get(piece[at:end])) is not None:
                return i
            end -= 1
        return -1

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if it is a single byte."""
        if (known := self.shorter.get(token)) is None:
            t = self.text[token]
            known = self.shorter[token] = next((self.ids[t[:e]] for e in range(len(t) - 1, 0, -1) if t[:e] in self.ids), -1)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Do the bytes of the two tokens, encoded together, give these two tokens?

        The border between them stays if no merge across it comes earlier than both tokens are
        complete. Undoing the later of the two last merges walks back through all pairs of
        tokens that ever met at the border.
        """
        if (known := self.pairs.get((left, right))) is not None:
            return known
        a, b = left, right
        # A merge across the border happens if its rank is below that of the merge that next changes either side.
        limit = len(self.merged) + 1
        fits = True
        while True:
            if (r := self.merged.get((a, b))) is not None and r < limit:
                fits = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # Merges run by rank, equal ones from the left: the later of the two is undone first.
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = fits
        return fits

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters for its bytes."""
        if (i := self.ids.get(piece)) is not None:
            return [i]
        out: list[int] = []
        text, at, n = self.text, 0, len(piece)
        open_ = bytearray(b"\x01") * (n + 1)
        token = self.longest(piece, 0)
        while token >= 0:
            before = out[-1] if out else -1
            while True:
                end = at + len(text[token])
                if open_[end] and (before < 0 or self.compatible(before, token)):
                    out.append(token)
                    at = end
                    token = self.longest(piece, at) if at < n else -1
                    break
                if (shorter := self.next_shorter(token)) >= 0:
                    token = shorter
                    continue
                open_[at] = 0  # no token fits here after the one before: take that back
                out.pop()
                at -= len(text[before])
                token = self.next_shorter(before)
                while token < 0 and out:
                    open_[at] = 0
                    before = out.pop()
                    at -= len(text[before])
                    token = self.next_shorter(before)
                break
        return out

    def encode(self, value: str | None) -> list[int]:
        """Ids of a text; null and empty texts have the empty list."""
        ids: list[int] = []
        memo = self.memo
        for piece in self.find(value) if value else ():
            if (known := memo.get(piece)) is None:
                known = self.piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = known
            ids += known
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per Python worker and vocabulary."""
    return BytePairEncoder(path)


def encoded(documents: DataFrame, text: str = "text", ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``documents`` with the column ``text`` replaced by ``ids``, the list of its token ids.

    Texts are encoded as they are and whole; strings that look like special tokens are ordinary
    text. Null and empty texts have the empty list. Other columns come along; an existing column
    ``ids`` is replaced. ``path`` is the vocabulary file, which every executor must be able to read.
    """
    keep = [c for c in documents.columns if c not in (text, ids)]
    rows = documents.select(*keep, F.col(text).alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1]) + f"`{ids}` array<int>"
    where = os.fspath(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(where)
        for batch in batches:
            lists = pa.array([own.encode(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, ids])

    return rows.mapInArrow(run, schema)
