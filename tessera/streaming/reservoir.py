"""Trending tags of a fixed-size sample of an unbounded stream."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import ASCII_WORD, ascii_word
from tessera.streaming.sinks import appending

ASCII = re.compile(ASCII_WORD)
TOP = 3
# Fixed value: the head line of a report.
HEADLINE = "The number of tweets with tags from the beginning: "


def trending(counts: dict[str, int]) -> list[tuple[str, int]]:
    """Tags whose count is among the 3 largest distinct counts and at least 1, by count and name."""
    best = sorted({n for n in counts.values() if n > 0}, reverse=True)[:TOP]
    return sorted(((t, n) for t, n in counts.items() if n in best), key=lambda x: (-x[1], x[0]))


class Reservoir:
    """Keeps up to ``capacity`` tagged posts, every post being equally likely to be kept.

    Posts without tags don't count. The first ``capacity`` posts are kept if they have an ASCII tag,
    else they don't count either; the n-th later one is kept with probability capacity / n, in place
    of a random other. Random draws come from the seed and n alone, so a replay gives the same.
    """

    def __init__(self, capacity: int = 100, seed: int = 0, n: int = 0, kept: list[list[str]] | None = None):
        self.capacity, self.seed, self.n, self.kept = capacity, seed, n, kept or []

    def _draw(self, salt: int) -> int:
        x = (self.seed * 0x9E3779B97F4A7C15 + self.n * 0xD1B54A32D192ED03 + salt * 0x8CB92BA72F3D8DD7) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) % 2**64
        return x ^ (x >> 31)

    def offer(self, tags: list[str | None] | None) -> bool:
        """Takes in a post; tells whether it was kept or at least drawn for (which makes a report)."""
        if not tags:
            return False
        own = [t for t in tags if t and ASCII.fullmatch(t)]
        self.n += 1
        if self.n <= self.capacity:
            if not own:
                self.n -= 1
                return False
            self.kept.append(own)
            return True
        if self._draw(1) % self.n < self.capacity:
            self.kept[self._draw(2) % self.capacity] = own
        return True

    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for tags in self.kept:
            for t in tags:
                out[t] = out.get(t, 0) + 1
        return out


def trending_stream(posts: DataFrame, capacity: int = 100, seed: int = 0, each_post: bool = False) -> DataFrame:
    """(n, tag, count) after each micro-batch of a stream of (hashtags, posted_at): the reservoir is the state.

    With ``each_post`` there is a report after every post that was kept or drawn for, numbered by ``n``.

    A reservoir is one sequence, so its state has one key: at most ``capacity`` posts and a counter. The posts
    of a micro-batch are brought together, which the trigger bounds (``maxFilesPerTrigger``), and taken in
    the order of ``posted_at``; posts of the same time are taken in the order of their tags.
    """
    rows = posts.select(F.lit(0).alias("key"), F.transform("hashtags", lambda h: h["text"]).alias("tags"), F.col("posted_at").cast("timestamp").alias("at")).filter(F.size("tags") > 0)

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = state.get if state.exists else (0, [])
        reservoir = Reservoir(capacity, seed, n, [list(x) for x in kept])
        report = lambda: [(reservoir.n, t, c) for t, c in trending(reservoir.counts())]
        whole = pd.concat(list(pieces))  # Arrow pieces are no order; only the batch as a whole can be sorted
        whole["tie"] = ["\0".join(t or "" for t in tags) for tags in whole["tags"]]
        rows = []
        for tags in whole.sort_values(["at", "tie"], kind="stable")["tags"]:
            if reservoir.offer(list(tags)) and each_post:
                rows += report()
        if rows:
            yield pd.DataFrame(rows, columns=["n", "tag", "count"])
        state.update((reservoir.n, reservoir.kept))
        if not each_post:
            yield pd.DataFrame(report(), columns=["n", "tag", "count"])

    return rows.groupBy("key").applyInPandasWithState(step, "n long, tag string, count long", "n long, kept array<array<string>>", "append", GroupStateTimeout.NoTimeout)


def append_blocks(reports: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a block of text per report: how many posts with tags there were, and the trending tags with their counts.

    A restart from the checkpoint goes on with the file; a batch that is tried again replaces its first try.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = None
        with appending(path, number) as f:
            for r in batch.orderBy("n", F.col("count").desc(), "tag").toLocalIterator():
                if r["n"] != last:
                    f.write(("" if last is None else "\n") + f"{HEADLINE}{r['n']}\n")
                    last = r["n"]
                f.write(f"{r['tag']}: {r['count']}\n")
            f.write("\n" if last is not None else "")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", os.fspath(checkpoint)).outputMode("append").trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def trending_tags(posts: DataFrame) -> DataFrame:
    """(tag, n): the ASCII tags of a table of posts with one of the 3 largest distinct counts."""
    tags = posts.select(F.explode("hashtags").alias("h")).select(F.col("h.text").alias("tag")).filter(ascii_word(F.col("tag")))
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    best = F.broadcast(counts.select("n").distinct().orderBy(F.col("n").desc()).limit(TOP))
    return counts.join(best, "n", "left_semi").select("tag", "n")


def smallest_hashes(posts: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """A sample of ``k`` rows that can be merged: those whose seeded hash is smallest.

    Every task keeps k rows and two samples give one by taking the k smallest again, so that the
    state of a stream and the result of a table are the same.
    """
    return posts.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("__hash", key).limit(k).drop("__hash")
