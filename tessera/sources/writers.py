"""Writers of results in the formats of the engine's programs.

Those that give one file of an order of its own take results that are small by design (reports,
top lists); large results are written as part files by Spark.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def json_object(result: dict[str, Any], path: str, indent: int | None = None) -> None:
    """One JSON object, pretty with ``indent`` or compact."""
    Path(path).write_text(json.dumps(result, indent=indent, ensure_ascii=False), encoding="utf-8")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_single(df: DataFrame, path: str) -> None:
    """CSV with a header, in one part file; the rows stream through a single task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def csv_parts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def quoted_tuple(items: Column) -> Column:
    """An array of strings as ``('a', 'b')``."""
    return F.concat(F.lit("('"), F.concat_ws("', '", items), F.lit("')"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(size, line): the itemsets of each size on one line, in order."""
    lines = itemsets.groupBy(F.size("items").alias("size")).agg(F.array_sort(F.collect_list("items")).alias("sets"))
    return lines.select("size", F.concat_ws(",", F.transform("sets", quoted_tuple)).alias("line")).orderBy("size")


def itemset_text(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """The blocks ``Candidates:`` and ``Frequent Itemsets:``, a line per size with blank lines between."""
    blocks = []
    for title, sets in (("Candidates:", candidates), ("Frequent Itemsets:", frequent)):
        blocks.append(title + "\n" + "\n\n".join(r["line"] for r in itemset_lines(sets).collect()))
    Path(path).write_text("\n\n".join(blocks) + "\n", encoding="utf-8")


def community_text(communities: DataFrame, path: str) -> None:
    """A line ``'a', 'b'`` per community, by size and first member."""
    rows = communities.orderBy("size", F.col("members")[0]).select(F.concat(F.lit("'"), F.concat_ws("', '", "members"), F.lit("'")).alias("line"))
    _lines((r["line"] for r in rows.toLocalIterator()), path)


def betweenness_text(values: DataFrame, path: str) -> None:
    """A line ``('a', 'b'), 1.0`` per edge, highest first."""
    rows = values.orderBy(F.col("value").desc(), "src", "dst").select(F.concat(quoted_tuple(F.array("src", "dst")), F.lit(", "), F.col("value").cast("string")).alias("line"))
    _lines((r["line"] for r in rows.toLocalIterator()), path)


def flags_text(flagged: DataFrame, order: str, path: str) -> None:
    """The column ``flag`` in the order of a column, blanks between; the flags go to the file as they come."""
    rows = flagged.orderBy(order).select(F.col("flag").cast("string").alias("flag"))
    with open(path, "w", encoding="utf-8") as f:
        for i, r in enumerate(rows.toLocalIterator()):
            f.write(f" {r['flag']}" if i else r["flag"])


def round_stats(rounds: DataFrame, path: str) -> None:
    """The rounds of out-of-core clustering as CSV, a line per round; there are as many rounds as chunks."""
    # Fixed value: the first line of the file.
    header = "round_id,nof_cluster_discard,nof_point_discard,nof_cluster_compression,nof_point_compression,nof_point_retained"
    names = ("round", "discard_clusters", "discard_points", "compressed_clusters", "compressed_points", "retained_points")
    _lines([header, *(",".join(str(r[c]) for c in names) for r in rounds.orderBy("round").toLocalIterator())], path)


def profile_lines(businesses: DataFrame, users: DataFrame, path: str) -> None:
    """A file of two JSON lines: businesses -> words in order of their weight, users -> word weights.

    ``businesses`` is (business_id, word, weight), ``users`` (user_id, word, weight). Each key's entry is made
    in parallel; the entries go to the file as they come.
    """
    best = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "word")))["word"]
    of_business = businesses.groupBy(F.col("business_id").alias("k")).agg(F.to_json(best).alias("v"))
    of_user = users.groupBy(F.col("user_id").alias("k")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "weight"))))).alias("v"))
    with open(path, "w", encoding="utf-8") as f:
        for table in (of_business, of_user):
            f.write("{")
            for i, r in enumerate(table.orderBy("k").toLocalIterator()):
                f.write((", " if i else "") + json.dumps(r["k"], ensure_ascii=False) + ": " + r["v"])
            f.write("}\n")


def table(df: DataFrame, path: str) -> None:
    """Parquet: models and profiles."""
    df.write.mode("overwrite").parquet(path)


def _lines(lines: Iterable[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)


class Diagnostics:
    """Rows and seconds of steps: ``watched`` counts a step's rows while it runs, without a job of its own."""

    def __init__(self) -> None:
        self.began, self.steps = time.time(), {}

    def watched(self, df: DataFrame, step: str) -> DataFrame:
        self.steps[step] = Observation(step)
        return df.observe(self.steps[step], F.count(F.lit(1)).alias("rows"))

    def report(self) -> dict[str, Any]:
        """The rows of each step that has run, and ``seconds`` since the start; also logged."""
        out = {step: seen.get["rows"] for step, seen in self.steps.items()}
        out["seconds"] = round(time.time() - self.began, 3)
        logging.getLogger("tessera").info("%s", out)
        return out
