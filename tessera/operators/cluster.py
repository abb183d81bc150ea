"""Clustering: k-means, cluster summaries, out-of-core clustering over chunks, and how two labelings agree.

Points are rows (id, features array<double>). Centroids and summaries (n, sum and sum of squares
per dimension) are bounded by the number of clusters; they live on the driver and go to the tasks
as constants. Points never leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import dropped, materialized, scratch_path

EPSILON = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(points: np.ndarray, centres: np.ndarray, sigma: np.ndarray | None = None) -> np.ndarray:
    """Euclidean, or with ``sigma`` per centre and dimension diagonal Mahalanobis, distances."""
    out = np.empty((len(points), len(centres)))
    for j, c in enumerate(centres):
        d = points - c if sigma is None else (points - c) / np.maximum(sigma[j], EPSILON)
        out[:, j] = np.sqrt((d * d).sum(axis=1))
    return out


def assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with ``cluster``: the nearest centre, ties to the smaller number. Without centres no rows."""
    kept = points.select("id", "features")
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                near = distances(_matrix(batch.column(1)), centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "features", "cluster"])

    return kept.mapInArrow(run, f"id {kind}, features array<double>, cluster int")


class Summary(NamedTuple):
    """Number of points, sum and sum of squares per dimension of one cluster."""

    n: int
    s: np.ndarray
    q: np.ndarray

    def plus(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.s + other.s, self.q + other.q)

    @property
    def centre(self) -> np.ndarray:
        return self.s / self.n

    @property
    def sigma(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.q / self.n - (self.s / self.n) ** 2, 0))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per cluster and task: sums over the task's points."""
    held: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, c = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for k in np.unique(c).tolist():
            own = x[c == k]
            sums = held.setdefault(k, [0, 0.0, 0.0])
            sums[0] += len(own)
            sums[1] = sums[1] + own.sum(axis=0)
            sums[2] = sums[2] + (own * own).sum(axis=0)
    if held:
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(held), pa.int32()), "n": [v[0] for v in held.values()], "s": [v[1].tolist() for v in held.values()], "q": [v[2].tolist() for v in held.values()]})


def cluster_summaries(assigned: DataFrame) -> DataFrame:
    """(cluster, dim, n, s, q): points, sum and sum of squares of each cluster and dimension."""
    part = assigned.select("features", "cluster").mapInArrow(_partial, "cluster int, n long, s array<double>, q array<double>")
    long = part.select("cluster", "n", F.posexplode(F.arrays_zip("s", "q")).alias("dim", "v"))
    return long.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.s").alias("s"), F.sum("v.q").alias("q"))


def summaries(assigned: DataFrame) -> dict[int, Summary]:
    """The summaries on the driver: clusters x dimensions numbers."""
    out: dict[int, list] = {}
    for r in cluster_summaries(assigned).orderBy("cluster", "dim").collect():
        out.setdefault(r["cluster"], []).append((r["n"], r["s"], r["q"]))
    return {c: Summary(v[0][0], np.array([x[1] for x in v]), np.array([x[2] for x in v])) for c, v in out.items()}


def _draw(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """``k`` points by a seeded order of their ids."""
    rows = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("features").collect()
    return np.array([r["features"] for r in rows], dtype=float)


def farthest_first(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """A seeded first point and then, again and again, the point farthest from those chosen; ties to the smaller id."""
    centres = _draw(points, 1, seed)
    while 0 < len(centres) < k:
        chosen, kind = centres.copy(), points.schema["id"].dataType.simpleString()

        def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if batch.num_rows:
                    d = distances(_matrix(batch.column(1)), chosen).min(axis=1)
                    ids = batch.column(0).to_pylist()
                    i = max(range(len(d)), key=lambda j: d[j])
                    if best is None or d[i] > best[0] or (d[i] == best[0] and ids[i] < best[1]):
                        best = (float(d[i]), ids[i], batch.column(1)[i].as_py())
            if best is not None:
                yield pa.RecordBatch.from_pydict({"d": [best[0]], "id": [best[1]], "features": [best[2]]})

        top = points.select("id", "features").mapInArrow(farthest, f"d double, id {kind}, features array<double>").orderBy(F.col("d").desc(), "id").first()
        if top is None or top["d"] <= 0:
            break
        centres = np.vstack([centres, np.array(top["features"], dtype=float)])
    return centres


def kmeans(points: DataFrame, k: int, centres: np.ndarray | None = None, rounds: int = 10, tolerance: float = 0.1, seed: int = 0, restarts: int = 3) -> np.ndarray:
    """The centres of k-means: farthest-first start up to k = 16, a seeded draw beyond; rounds until they move little.

    A cluster that becomes empty starts the run again from another draw, ``restarts`` times; then
    it is left out. Points are to be assigned with the centres returned.
    """
    if centres is None:
        centres = farthest_first(points, k, seed) if k <= 16 else _draw(points, k, seed)
    if not len(centres):
        return centres
    tries = 0
    for _ in range(rounds):
        held = summaries(assign(points, centres))
        if len(held) < len(centres):
            tries += 1
            if tries <= restarts:
                centres = _draw(points, len(centres), seed + tries)
                continue
            return np.array([held[c].centre for c in sorted(held)])
        moved = np.array([held[c].centre for c in range(len(centres))])
        shift = float(np.sqrt(((moved - centres) ** 2).sum(axis=1)).sum())
        centres = moved
        if shift <= tolerance:
            break
    return centres


def mahalanobis_assign(points: DataFrame, groups: dict[str, list[Summary]], limit: float) -> DataFrame:
    """(id, features, kind, cluster): the nearest summary of the first group in which one is nearer than ``limit``.

    Points near no summary get the kind ``RS`` and cluster -1.
    """
    table = [(kind, np.array([s.centre for s in held]), np.array([s.sigma for s in held])) for kind, held in groups.items() if held]
    kind_of_id = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            kind, cluster = np.full(len(x), "RS", dtype=object), np.full(len(x), -1, dtype=np.int32)
            for name, centre, sigma in table:
                d = distances(x, centre, sigma)
                near = (kind == "RS") & (d.min(axis=1) < limit)
                kind[near], cluster[near] = name, d.argmin(axis=1)[near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind.tolist()), pa.array(cluster)], names=["id", "features", "kind", "cluster"])

    return points.select("id", "features").mapInArrow(run, f"id {kind_of_id}, features array<double>, kind string, cluster int")


class Bfr(NamedTuple):
    """``points`` (id, cluster; -1 for outliers) and ``rounds`` (round, clusters and points discarded, compressed, points retained)."""

    points: DataFrame
    rounds: list[tuple[int, int, int, int, int, int]]


def bfr(chunks: Iterable[DataFrame], k: int, seed: int = 0, few: int = 10, fewer: int = 5, small: int = 10) -> Bfr:
    """Out-of-core clustering: chunk after chunk, keeping summaries of points instead of points.

    1. Of the first chunk, k-means with 3 k; clusters of at most ``few`` points are outliers. k-means
       with k of the rest, moving clusters of at most ``fewer`` points to the outliers until there
       are none: the discard set. k-means of the outliers with at most k clusters: single points
       are retained, others compressed.
    2. Every later point goes to the nearest discarded, else compressed cluster within 2 sqrt(d) by
       Mahalanobis distance, else is retained. The retained are clustered into at most ``small``
       clusters; those of several points are compressed, and compressed clusters merged whose sum
       of sigmas is at most the mean of the discarded and compressed sigmas.
    3. In the end compressed clusters within 2 sqrt(d) of a discarded one join it; all other points
       are outliers. A sigma of 0 counts as a very small one.

    ``chunks`` may be an iterator: each is read when its turn comes, and only its points' labels, a row
    (id, kind, cluster) appended to one table, stay. No chunks, or an empty first one, give no points.
    """
    remaining = iter(chunks)
    first = next(remaining, None)
    if first is None:
        raise ValueError("there must be a chunk")
    spark, kind_of_id = first.sparkSession, first.schema["id"].dataType.simpleString()
    labels = scratch_path(spark, "labels")
    spark.createDataFrame([], f"id {kind_of_id}, kind string, cluster int").write.parquet(labels)
    read = lambda chunk: materialized(chunk.select("id", F.col("features").cast("array<double>").alias("features")), "chunk")
    first = read(first)
    head = first.first()
    if head is None:
        return Bfr(first.select("id", F.lit(-1).cast("int").alias("cluster")), [])
    limit = 2 * math.sqrt(len(head["features"]))

    def note(points: DataFrame, kind: str, numbers: dict[int, int]) -> None:
        """Appends the label of points already summarised; the numbers of clusters are stable."""
        if numbers:
            named = F.create_map(*[F.lit(x) for c, i in numbers.items() for x in (c, i)])
            points.select("id", F.lit(kind).alias("kind"), named[F.col("cluster")].cast("int").alias("cluster")).write.mode("append").parquet(labels)

    placed = materialized(assign(first, kmeans(first, 3 * k, seed=seed)), "placed")
    crowded = lambda a, n: [r["cluster"] for r in a.groupBy("cluster").count().filter(F.col("count") > n).collect()]
    keep = crowded(placed, few)
    inner, outer = placed.filter(F.col("cluster").isin(keep)).select("id", "features"), placed.filter(~F.col("cluster").isin(keep)).select("id", "features")
    while True:
        assigned = materialized(assign(inner, kmeans(inner, k, seed=seed)), "inner")
        keep = crowded(assigned, fewer)
        lost = assigned.filter(~F.col("cluster").isin(keep)).select("id", "features")
        if lost.isEmpty():
            break
        outer = outer.unionByName(lost)
        inner = assigned.filter(F.col("cluster").isin(keep)).select("id", "features")
    discard = dict(enumerate(s for _, s in sorted(summaries(assigned).items())))
    note(assigned, "DS", {c: i for i, c in enumerate(sorted(keep))})
    compressed: dict[int, Summary] = {}
    merged: dict[int, int] = {}
    rounds = []

    def compress(points: DataFrame, most: int) -> DataFrame:
        """Clusters the retained points; returns those that stay retained."""
        count = points.count()
        if not count:
            return points
        own = materialized(assign(points, kmeans(points, min(most, count), seed=seed)), "retained")
        several = {c: s for c, s in summaries(own).items() if s.n > 1}
        new = {c: len(merged) + i for i, c in enumerate(sorted(several))}
        for c, i in new.items():
            compressed[i], merged[i] = several[c], i
        note(own.filter(F.col("cluster").isin(list(new))), "CS", new)
        stay = materialized(own.filter(~F.col("cluster").isin(list(new))).select("id", "features"), "retained")
        dropped(own)
        return stay

    def report() -> None:
        rounds.append((len(rounds) + 1, len(discard), sum(s.n for s in discard.values()), len(compressed), sum(s.n for s in compressed.values()), retained.count()))

    retained = compress(materialized(outer, "outliers"), k)
    dropped(first, placed, assigned)
    report()
    for chunk in map(read, remaining):
        ds, cs = sorted(discard), sorted(compressed)
        means = ([float(np.mean([discard[i].sigma for i in ds]))] if ds else []) + ([float(np.mean([compressed[i].sigma for i in cs]))] if cs else [])
        found = materialized(mahalanobis_assign(chunk, {"DS": [discard[i] for i in ds], "CS": [compressed[i] for i in cs]}, limit), "found")
        for kind, ids, table in (("DS", ds, discard), ("CS", cs, compressed)):
            own = found.filter(F.col("kind") == kind)
            for c, s in summaries(own).items():
                table[ids[c]] = table[ids[c]].plus(s)
            note(own, kind, dict(enumerate(ids)))
        new = found.filter(F.col("kind") == "RS").select("id", "features")
        if not new.isEmpty():
            before, retained = retained, compress(retained.unionByName(new), small)
            dropped(before)
            _merge(compressed, merged, sum(means))
        dropped(found, chunk)
        report()
    joins = {}
    for i, s in list(compressed.items()) if discard else ():
        d = distances(s.centre[None, :], np.array([discard[j].centre for j in sorted(discard)]), np.array([discard[j].sigma for j in sorted(discard)]))[0]
        if d.min() < limit:
            joins[i] = sorted(discard)[int(d.argmin())]
            discard[joins[i]] = discard[joins[i]].plus(compressed.pop(i))
    rounds[-1] = (rounds[-1][0], len(discard), sum(s.n for s in discard.values()), len(compressed), sum(s.n for s in compressed.values()), rounds[-1][5])

    def final(i: int) -> int:
        while merged[i] != i:
            i = merged[i]
        return joins.get(i, -1)

    cluster = F.col("cluster")
    if merged:
        last = F.create_map(*[F.lit(x) for i in merged for x in (i, final(i))])
        cluster = F.when(F.col("kind") == "DS", cluster).otherwise(last[cluster])
    noted = spark.read.schema(f"id {kind_of_id}, kind string, cluster int").parquet(labels)
    return Bfr(noted.select("id", cluster.cast("int").alias("cluster")).unionByName(retained.select("id", F.lit(-1).cast("int").alias("cluster"))), rounds)


def _merge(compressed: dict[int, Summary], merged: dict[int, int], most: float) -> None:
    """Merges compressed clusters; every partner of one is tested against its sums at the start of its turn."""
    for a in sorted(compressed):
        if a not in compressed:
            continue
        own, gained = compressed[a], []
        for b in sorted(compressed):
            if b > a and float(own.plus(compressed[b]).sigma.sum()) <= most:
                gained.append(b)
        for b in gained:
            compressed[a] = compressed[a].plus(compressed.pop(b))
            merged[b] = a


def cluster_sizes(labels: DataFrame, label: str) -> DataFrame:
    """(label, points), the smallest label first when sorted: how many points each label has."""
    return labels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("points"))


def nmi(labels: DataFrame, u: str, v: str) -> DataFrame:
    """One row ``nmi``: mutual information of two labelings over the mean of their entropies; 1 if both have one label."""
    cells = labels.filter(F.col(u).isNotNull() & F.col(v).isNotNull()).groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count("*").alias("n"))
    total = F.broadcast(cells.agg(F.sum("n").cast("double").alias("t")))  # one row
    of = lambda c: cells.groupBy(c).agg(F.sum("n").alias(f"n{c}"))
    h = lambda c: of(c).crossJoin(total).agg(F.sum(-F.col(f"n{c}") / F.col("t") * F.log(F.col(f"n{c}") / F.col("t"))).alias(f"h{c}"))
    joint = cells.join(of("u"), "u").join(of("v"), "v").crossJoin(total)
    info = joint.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nu") * F.col("nv")))).alias("i"))
    both = info.crossJoin(h("u")).crossJoin(h("v"))  # three rows of one
    return both.select(F.round(F.when(F.col("hu") + F.col("hv") < 1e-12, 1.0).otherwise(2 * F.col("i") / (F.col("hu") + F.col("hv"))), 6).alias("nmi"))
