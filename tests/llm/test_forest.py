"""The forest against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import base, forest, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall(spark, sf_dir):
    vectors = base.table(spark, sf_dir, "embeddings")
    found = queries.op6_forest(spark, sf_dir)
    assert forest.recall(found, vectors) >= 0.9
    counts = {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert set(counts.values()) == {10} and len(counts) == vectors.filter("vec_id % 100 = 0").count()


def compared(x, share, k=10, **options):
    """The mean share of rows that queries compare, and whether none ends at the root."""
    shard = forest.Shard(np.arange(len(x)), x, forest.fit(x[:4096], **options))
    begin, end = shard.descend(shard.directions.strings(x[::100]))
    met = [shard.candidates(begin[:, :, j], end[:, :, j], max(k + 1, int(share * len(x)))).mean() for j in range(begin.shape[2])]
    return float(np.mean(met)), max(met) < 1


def test_prefixes_decide(spark, sf_dir):
    """With the query's own parameters no query compares every row, and on average under half of them."""
    x = np.stack([np.array(r.embedding) for r in base.table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()])
    share = forest.fitting_share(x[:4096], forest.fit(x[:4096], trees=128, letters=6), 10)
    assert share < 1
    mean, below = compared(x, share, trees=128, letters=6)
    assert below and mean < 0.5


def test_clustered_vectors_need_few_comparisons(spark):
    """10,000 rows in 200 clusters: a hundredth of the rows is enough."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(200, 32))[rng.integers(200, size=10_000)] + 0.2 * rng.normal(size=(10_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    found = forest.search(df, F.col("vec_id") % 100 == 0, trees=32, share=0.01, shard_rows=3000)
    assert forest.recall(found, df) >= 0.9
    mean, below = compared(x.astype(np.float64), 0.01, trees=32, letters=6)
    assert below and mean < 0.1
    rows = found.orderBy("query_id", "rank").collect()
    wide = x.astype(np.float64)
    for r in rows:
        assert np.isclose(r.score, np.linalg.norm(wide[r.query_id] - wide[r.vec_id]), rtol=0, atol=1e-12) and r.vec_id != r.query_id
    for q in {r.query_id for r in rows}:
        own = [(r.score, r.vec_id) for r in rows if r.query_id == q]
        assert own == sorted(own) and len(own) == 10


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (6, [1.0, 0.0, 0.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (200, [0.0, 2.0], None), (300, None, 1)]
    got = forest.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(100, 1, 7), (100, 2, 8), (100, 3, 200), (200, 1, 7), (200, 2, 8), (200, 3, 100)]
    empty = spark.createDataFrame([], SCHEMA)
    assert forest.search(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert forest.search(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_one_hot_vector(spark):
    """A third of the rows are one vector: all of its links are exact, ties going to the smaller id."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = [(r.query_id, r.vec_id, r.score) for r in forest.search(df, F.col("vec_id") % 300 == 0, shard_rows=200).orderBy("query_id", "rank").collect()]
    for q in (0, 300, 600):
        assert [(v, s) for i, v, s in got if i == q] == [(v, 0.0) for v in range(0, 33, 3) if v != q][:10]


@pytest.mark.parametrize("rows", [2000, 10_000])
def test_recall_of_the_query_on_larger_tables(spark, rows):
    """Production parameters on vectors without structure, and with it: 0.9 or more of the true ten."""
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, 64))
    if rows == 10_000:
        x = x * 0.3 + rng.normal(size=(100, 64))[rng.integers(100, size=rows)]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    found = forest.search(df, F.col("vec_id") % 100 == 0)
    assert found.count() == rows // 10 and forest.recall(found, df) >= 0.9


def test_share_follows_the_sample():
    """Clusters need a small share; vectors without structure a larger one; what can't be found by prefixes is compared in full."""
    rng = np.random.default_rng(1)
    clusters = rng.normal(size=(100, 16))[rng.integers(100, size=2000)] + 0.05 * rng.normal(size=(2000, 16))
    plain = rng.normal(size=(2000, 64))
    of = lambda x, trees: forest.fitting_share(x, forest.fit(x, trees, 6), 10)
    assert of(clusters, 32) <= 0.05 < of(plain, 128) < 1
    assert of(plain[:1], 4) == forest.SHARES[0]


def test_batches_of_queries_give_the_same(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(1500, 8)).astype(np.float32))], SCHEMA)
    one, many = (sorted(map(tuple, forest.search(df, F.col("vec_id") % 50 == 0, shard_rows=400, batch=n).collect())) for n in (forest.QUERIES, 7))
    assert one == many and len(one) == 300


def test_best_of_shards():
    parts = [(np.array([1, 1, 2]), np.array([5, 6, 7]), np.array([0.5, 0.1, 0.3])), (np.array([1, 1]), np.array([4, 9]), np.array([0.5, 0.2]))]
    assert [list(c) for c in forest.best_of(parts, 3)] == [[1, 1, 1, 2], [6, 9, 4, 7], [0.1, 0.2, 0.5, 0.3]]
