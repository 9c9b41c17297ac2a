"""Hard negatives by exact integer inner products of tiles of anchors and candidates.

Vectors become whole numbers. Candidates lie in a written table that tasks read as a
stream; anchors are broadcast in batches of at most about ANCHORS, so the work is a stated
query set against all rows, in blocks, and nothing grows with the table but the number of
batches. A task multiplies tiles of TILE_ANCHORS by TILE_ROWS by Strassen's recursion in
64-bit integers, padded with zeros to halves that stay even; its sums and differences are
exact, so the scores are.

Each task keeps heaps that merge in any order: for an anchor the best rows of its label,
in a first pass, and for each pair of anchor and positive the best rows of other labels
inside the window of scores that the positive sets, in a second one. They leave the task
once, when its rows are done. There are as many tasks as the cluster has room for, and
therefore as many heaps of an anchor, whatever the size of the table or of a label.

Defined cases: rows whose id, label or vector is null, whose vector is empty, of another
length than most, or holds null or non-finite components take no part, nor do vectors so
large that an inner product could leave a long; of rows with one id the least by label and
vector counts; equal scores go to the smaller id; a positive of a negative score has no
window and gives no row; an anchor without another row of its label gives none; empty
tables and tables without anchors give none. Columns beyond the three named are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, new_path
from . import base

#: Anchors broadcast at once, rows and anchors of a tile, and the side below which tiles are multiplied plainly.
ANCHORS, TILE_ROWS, TILE_ANCHORS, LEAF = 32_768, 2048, 256, 16

#: The place of a heap that is not taken; every score is greater.
EMPTY = -(2**63 - 1)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(value: Column) -> Column:
    """floor(256 * x) of each component, as long; x as double."""
    return F.transform(value, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(vectors: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """(key, label, x): whole-number vectors of the rows that take part, one for each key."""
    v = F.col(value)
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(label).cast("long").alias(label), value)
    rows = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usual = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 1
    most = math.isqrt((2**63 - 2) // d) - 1  # d products of two such numbers stay above EMPTY and inside a long
    rows = rows.filter((F.size(v) == d) & F.forall(v, lambda x: F.abs(x.cast("double")) * 256 <= F.lit(float(most))))
    return rows.groupBy(key).agg(F.min(F.struct(F.col(label).alias("label"), whole(v).alias("x"))).alias("row")).select(key, F.col("row.label").alias(label), F.col("row.x").alias("x"))


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a times b for 64-bit integers, by Strassen's seven products down to sides of `leaf`."""
    (m, d), n = a.shape, b.shape[1]
    halvings = 0
    while min(m, d, n) >> halvings > leaf:
        halvings += 1
    if not halvings:
        return a @ b
    even = lambda side: -(-side >> halvings) << halvings
    left, right = np.zeros((even(m), even(d)), np.int64), np.zeros((even(d), even(n)), np.int64)
    left[:m, :d], right[:d, :n] = a, b
    return _strassen(left, right, halvings)[:m, :n]


def _strassen(a: np.ndarray, b: np.ndarray, halvings: int) -> np.ndarray:
    if not halvings:
        return a @ b
    m, d, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    b11, b12, b21, b22 = b[:d, :n], b[:d, n:], b[d:, :n], b[d:, n:]
    times = lambda x, y: _strassen(x, y, halvings - 1)
    both, low, high = times(a11 + a22, b11 + b22), times(a21 + a22, b11), times(a11, b12 - b22)
    back, top = times(a22, b21 - b11), times(a11 + a12, b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = both + back - top + times(a12 - a22, b21 + b22)
    out[:m, n:], out[m:, :n] = high + top, low + back
    out[m:, n:] = both - low + high + times(a21 - a11, b11 + b12)
    return out


class Heaps:
    """For each of many groups the k best (score, id): greater scores first, ties by smaller id. Pushing is associative, so heaps of different tasks merge."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score, self.id = np.full((groups, k), EMPTY, np.int64), np.zeros((groups, k), np.int64)

    def push(self, first: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """scores, allowed: groups from `first` on by rows; ids: of the rows."""
        groups, k = len(scores), self.k
        last = slice(first, first + groups)
        fits = allowed & (scores >= self.score[last, -1:])  # equal scores may have a smaller id
        if scores.shape[1] > k and np.count_nonzero(fits) > 4 * k * groups:
            held = np.where(fits, scores, EMPTY)
            fits &= held >= np.partition(held, -k, axis=1)[:, -k, None]
        group, row = np.nonzero(fits)
        if not len(group):
            return
        old = np.repeat(np.arange(groups), k)
        g = np.concatenate([old, group])
        s, i = np.concatenate([self.score[last].ravel(), scores[group, row]]), np.concatenate([self.id[last].ravel(), ids[row]])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        place = np.arange(len(g)) - np.searchsorted(g, np.arange(groups))[g]
        best = place < k
        self.score[last], self.id[last] = s[best].reshape(groups, k), i[best].reshape(groups, k)

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, score) of the places that are taken."""
        group, place = np.nonzero(self.score != EMPTY)
        return group, self.id[group, place], self.score[group, place]


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(batches, anchors: np.ndarray):
    """(ids, labels, first anchor, scores) of each tile; columns of a batch: id, label, x."""
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, TILE_ROWS):
            part = whole_batch.slice(start, TILE_ROWS)
            ids, labels, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2)).T
            for first in range(0, len(anchors), TILE_ANCHORS):
                yield ids, labels, first, product(anchors[first : first + TILE_ANCHORS], x)


def _positives(shared, k: int):
    def run(batches):
        import pyarrow as pa

        own, label, x = shared.value
        heaps = Heaps(len(own), k)
        for ids, labels, first, scores in _tiles(batches, x):
            mine = slice(first, first + len(scores))
            heaps.push(first, scores, ids, (label[mine, None] == labels) & (own[mine, None] != ids))
        group, found, score = heaps.taken()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[group], found, score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(shared, pairs, k: int):
    """pairs: (place of the anchor, positive id, least score, greatest score, positive score), in the anchors' order."""

    def run(batches):
        import pyarrow as pa

        own, label, x = shared.value
        at, positive, least, most, score = pairs.value
        heaps = Heaps(len(at), k)
        for ids, labels, first, scores in _tiles(batches, x):
            a, b = np.searchsorted(at, [first, first + len(scores)])
            for start in range(a, b, TILE_ANCHORS):  # a few pairs to an anchor; bounded memory
                mine = slice(start, min(b, start + TILE_ANCHORS))
                s = scores[at[mine] - first]
                heaps.push(start, s, ids, (s >= least[mine, None]) & (s <= most[mine, None]) & (label[at[mine], None] != labels))
        group, found, got = heaps.taken()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[at[group]], positive[group], found, score[group], got)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), key: str = "vec_id", value: str = "embedding", label: str = "label", batch: int = ANCHORS) -> DataFrame:
    """Columns of RESULT. anchors: which rows ask; window: per cents of the positive's score that a negative's may have."""
    spark = vectors.sparkSession
    rows = base.written(usable(vectors, key, value, label), "candidates")
    asking = rows.filter(anchors)
    batches = -(-asking.count() // batch)
    if not batches:
        forget(rows)
        return spark.createDataFrame([], RESULT)
    tasks = 2 * spark.sparkContext.defaultParallelism
    spread = rows.coalesce(tasks) if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
    path = new_path(spark, "negatives")
    best = lambda df, by, score, other, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))).filter(F.col("rank") <= k)
    for b in range(batches):
        asked = asking.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == b).toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        asked = asked.sort_by(key)
        own = asked.column(0).to_numpy()
        shared = spark.sparkContext.broadcast((own, asked.column(1).to_numpy(), _matrix(asked.column(2).combine_chunks())))
        found = spread.mapInArrow(_positives(shared, positives), "anchor_id long, positive_id long, positive_score long")
        pairs = best(found, ["anchor_id"], "positive_score", "positive_id", positives).select("anchor_id", "positive_id", "positive_score").toArrow().sort_by([("anchor_id", "ascending"), ("positive_score", "descending"), ("positive_id", "ascending")])
        score = pairs.column(2).to_numpy()
        bounds = [[-(-window[0] * s // 100), window[1] * s // 100] for s in score.tolist()]  # in Python's whole numbers
        bounds = np.clip(np.array(bounds, object).reshape(-1, 2), EMPTY, 2**63 - 1).astype(np.int64)
        held = spark.sparkContext.broadcast((np.searchsorted(own, pairs.column(0).to_numpy()), pairs.column(1).to_numpy(), bounds[:, 0], bounds[:, 1], score))
        met = spread.mapInArrow(_negatives(shared, held, negatives), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        best(met, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        held.destroy()
        shared.destroy()
    forget(rows)
    return spark.read.schema(RESULT).parquet(path)
