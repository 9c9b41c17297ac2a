"""Approximate nearest neighbours by a hash-prefix forest.

In each tree a vector has a string of `letters` letters out of 16. A letter is the one of
16 directions, drawn for that tree and place alone, along which the vector less the mean
reaches furthest; the directions are random mixtures of the vectors of a bounded sample, so
they lie where the vectors do. Every row is indexed.

The rows are dealt over shards of about `shard_rows` by a hash of their ids; each shard
keeps, for every tree, the sorted array of its rows' strings. Queries are broadcast in
batches of at most about QUERIES and visit each shard. A query descends in every tree, by
binary search, to its longest matching prefix and then ascends in all trees at once, letter
by letter, until the distinct rows that share a prefix of that length with it in some tree
are `share` of the shard's rows and more than k. These rows are compared once each, by
Euclidean distance in double precision. There is no cap: what shares the prefix is
compared, however much it is. `share` is, unless given, the least of SHARES that finds
ENOUGH of the true neighbours of queries of the sample among the sample.

A batch shuffles the rows once, by shard; a task, of which there are as many as the cluster
has room for, indexes one shard after the other and keeps the best k of each query over all
of them, so a query leaves as many rows as there are tasks, whatever the table holds.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; of rows with one vec_id the smallest vector counts; a
null vec_id takes no part; identical vectors are candidates like others, ties going to the
smaller vec_id; with fewer candidates than k all are returned; empty tables give none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path
from . import base

LETTERS = 16

#: Queries broadcast at once; the shares that are tried, the recall that is enough, and the sample's queries by which it is told.
QUERIES, SHARES, ENOUGH, TRIED = 131_072, (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4), 0.93, 100


@dataclass(frozen=True)
class Directions:
    """of: dimensions x (trees * letters * 16), of length 1."""

    mean: np.ndarray
    of: np.ndarray
    trees: int
    letters: int

    def strings(self, x: np.ndarray) -> np.ndarray:
        """trees x rows: the strings as numbers, the first letter highest."""
        out = np.zeros((len(x), self.trees), np.int64)
        for k in range(0, len(x), 256):  # bounded memory
            near = ((x[k : k + 256] - self.mean).astype(np.float32) @ self.of).reshape(-1, self.trees, self.letters, LETTERS).argmax(-1)
            for j in range(self.letters):
                out[k : k + 256] = out[k : k + 256] * LETTERS + near[:, :, j]
        return out.T


def fit(sample: np.ndarray, trees: int, letters: int, seed: int = 7) -> Directions:
    rng, mean = np.random.default_rng(seed), sample.mean(0)
    parts = [(sample - mean).T @ rng.normal(size=(len(sample), letters * LETTERS)) for _ in range(trees)]
    of = np.concatenate(parts, 1)
    return Directions(mean, (of / np.maximum(np.linalg.norm(of, axis=0), 1e-12)).astype(np.float32), trees, letters)


class Shard:
    """Some rows with, for each tree, the sorted array of their strings."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, directions: Directions):
        self.ids, self.x, self.directions = ids, x, directions
        codes = directions.strings(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def descend(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For strings (trees x queries): where the rows begin and end that share their first 1 to `letters` letters; letters x trees x queries."""
        begin = np.zeros((self.directions.letters, *codes.shape), np.int64)
        end = begin.copy()
        for t, (stored, own) in enumerate(zip(self.sorted, codes, strict=True)):
            for n in range(1, self.directions.letters + 1):
                width = np.int64(LETTERS) ** (self.directions.letters - n)
                low = own // width * width
                begin[n - 1, t], end[n - 1, t] = np.searchsorted(stored, low), np.searchsorted(stored, low + width)
        return begin, end

    def candidates(self, begin: np.ndarray, end: np.ndarray, enough: int) -> np.ndarray:
        """The rows (a mask) met on the way up from the deepest prefixes (letters x trees) until they are enough; at the root, every row."""
        met = np.zeros(len(self.ids), bool)
        most = (end - begin).sum(1)
        for n in range(len(begin) - 1, -1, -1):
            if most[n] < enough:
                continue  # not even if all of them were distinct; they are met again one letter higher
            for order, a, b in zip(self.order, begin[n].tolist(), end[n].tolist(), strict=True):
                met[order[a:b]] = True
            if np.count_nonzero(met) >= enough:
                return met
        return np.ones(len(self.ids), bool)

    def nearest(self, ids: np.ndarray, x: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest found of each query."""
        begin, end = self.descend(self.directions.strings(x))
        enough = max(k + 1, int(np.ceil(share * len(self.ids))))
        out = []
        for j, (q, v) in enumerate(zip(ids.tolist(), x, strict=True)):
            met = np.flatnonzero(self.candidates(begin[:, :, j], end[:, :, j], enough) & (self.ids != q))
            d = np.sqrt(((self.x[met] - v) ** 2).sum(1))
            if len(d) > k:
                best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                met, d = met[best], d[best]
            own = self.ids[met]
            best = np.lexsort((own, d))[:k]
            out.append((np.full(len(best), q), own[best], d[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, row, distance) from several shards the k nearest of each query, ties to the smaller row."""
    q, row, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((row, d, q))
    q, row, d = q[order], row[order], d[order]
    begins = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return q[place < k], row[place < k], d[place < k]


def fitting_share(sample: np.ndarray, directions: Directions, k: int) -> float:
    """The least of SHARES with which queries of the sample find ENOUGH of their true k nearest in it, else 1."""
    shard = Shard(np.arange(len(sample)), sample, directions)
    asked = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(np.int64)
    begin, end = shard.descend(directions.strings(sample[asked]))
    reached = []  # for each query the rows met and the share of its neighbours among them, from the deepest letter up to the root
    for j, q in enumerate(asked):
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        true = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        met, own = np.zeros(len(sample), bool), []
        for n in range(directions.letters - 1, -1, -1):
            for order, low, high in zip(shard.order, begin[n, :, j].tolist(), end[n, :, j].tolist(), strict=True):
                met[order[low:high]] = True
            own.append((np.count_nonzero(met), met[true].mean() if len(true) else 1.0))
        reached.append([*own, (len(sample), 1.0)])
    for share in SHARES:
        enough = max(k + 1, int(np.ceil(share * len(sample))))
        if np.mean([next((r for n, r in own if n >= enough), 1.0) for own in reached]) >= ENOUGH:
            return share
    return 1.0


def usable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(key, value) of the rows that take part, one for each key."""
    v = F.col(value)
    rows = vectors.select(key, value).filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(ok)
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size(v) == sizes[0]["d"]).groupBy(key).agg(F.min(value).alias(value)) if sizes else rows


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a float64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: Column, k: int = 10, trees: int = 128, letters: int = 6, share: float | None = None, sample: int = 4096, shard_rows: int = 4096, key: str = "vec_id", value: str = "embedding", batch: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `queries` holds."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = base.written(usable(vectors, key, value).select(F.col(key).cast("long").alias(key), value), "vectors")
    count, asking = rows.count(), rows.filter(queries)
    batches = -(-asking.count() // batch) if count else 0
    if not batches:
        return spark.createDataFrame([], result)
    fitted = _matrix(base.bounded_sample(rows, sample, key).toArrow().column(value).combine_chunks())
    forest = fit(fitted, trees, letters)
    part = fitting_share(fitted, forest, k) if share is None else share
    directions = spark.sparkContext.broadcast(forest)
    shards = -(-count // shard_rows)
    tasks = min(shards, 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).alias("id"), F.col(value).alias("vector")).repartition(tasks, "shard").sortWithinPartitions("shard")
    path = new_path(spark, "nearest")
    for b in range(batches):
        asked = asking.filter(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(batches)) == b).select(key, value).toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        shared = spark.sparkContext.broadcast((asked.column(0).to_numpy(), _matrix(asked.column(1).combine_chunks()).astype(np.float32)))
        found = dealt.mapInArrow(_nearest(directions, shared, k, part), "query_id long, vec_id long, score double")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
    base.forget(rows)
    return spark.read.schema(result).parquet(path)


def _nearest(directions, shared, k: int, share: float):
    """A task's shards, one after the other; it holds one shard, one batch of queries and their best k so far."""

    def run(batches):
        import pyarrow as pa

        ids, x = shared.value
        best = None

        def asked(held):
            nonlocal best
            shard = Shard(*(np.concatenate(c) for c in zip(*held, strict=True)), directions.value)
            for start in range(0, len(ids), 512):  # bounded memory
                found.append(shard.nearest(ids[start : start + 512], x[start : start + 512].astype(np.float64), k, share))
            best = best_of(found if best is None else [best, *found], k)
            found.clear()

        at, held, found = None, [], []
        for whole in batches:
            of = whole.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if of[a] != at and held:
                    asked(held)
                    held = []
                at = of[a]
                held.append((whole.column(1)[a:b].to_numpy(), _matrix(whole.column(2)[a:b])))
        if held:
            asked(held)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query_id", "vec_id", "score"])

    return run


def recall(found: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", value: str = "embedding") -> float:
    """The share of the true k nearest that were found, over the queries in `found`; by brute force, for tests on small tables."""
    table = usable(vectors, key, value).toArrow()
    ids, x = table.column(key).to_numpy(), _matrix(table.column(value).combine_chunks())
    where = {int(v): n for n, v in enumerate(ids)}
    got: dict[int, set[int]] = {}
    for row in found.select("query_id", "vec_id").collect():
        got.setdefault(row[0], set()).add(row[1])
    hit = total = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[where[q]]) ** 2).sum(1))
        d[where[q]] = np.inf
        best = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        hit += len(near & {int(ids[b]) for b in best})
        total += len(best)
    return hit / max(1, total)
