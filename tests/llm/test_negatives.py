"""Hard negatives against SQL, plain products and brute force."""

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import base, negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 16]))
def test_products_are_exact(m, d, n, seed, leaf):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**27), 2**27, (m, d)), rng.integers(-(2**27), 2**27, (d, n))
    assert np.array_equal(negatives.product(a, b, leaf), a @ b)


def test_products_at_the_end_of_a_long():
    """Sums that wrap on the way come back: the last value alone has to fit."""
    most = negatives.math.isqrt((2**63 - 2) // 64) - 1
    a, b = np.full((40, 64), most), np.full((64, 40), -most)
    assert (negatives.product(a, b) == -64 * most * most).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.integers(1, 4))
def test_heaps_merge_in_any_order(seed, k, parts):
    rng = np.random.default_rng(seed)
    scores, ids, allowed = rng.integers(-3, 4, (5, 60)), rng.permutation(60), rng.random((5, 60)) < 0.7
    heaps = negatives.Heaps(7, k)
    for part in np.array_split(rng.permutation(60), parts):
        heaps.push(1, scores[:, part], ids[part], allowed[:, part])
    group, found, score = heaps.taken()
    for g in range(7):
        best = sorted((-int(s), int(i)) for s, i, ok in zip(scores[g - 1], ids, allowed[g - 1], strict=True) if ok)[:k] if 1 <= g < 6 else []
        assert [(-int(s), int(i)) for a, i, s in zip(group, found, score, strict=True) if a == g] == best


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    theirs = con.execute(queries.ORACLES["op11_negatives"]).fetchall()
    ours = [tuple(r) for r in queries.op11_negatives(spark, sf_dir).collect()]
    assert sorted(ours) == sorted(theirs) and len(ours) > 100


def brute(rows, window=(30, 90), positives=5, negatives_=10):
    x = {i: (lab, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, lab in rows}
    score = lambda a, b: sum(p * q for p, q in zip(x[a][1], x[b][1], strict=True))
    out = []
    for a in (i for i in x if i % 100 == 0):
        best = sorted((-score(a, b), b) for b in x if b != a and x[b][0] == x[a][0])[:positives]
        for p, b in best:
            fits = sorted((-s, c) for c in x if x[c][0] != x[a][0] and window[0] * -p <= 100 * (s := score(a, c)) <= window[1] * -p)[:negatives_]
            out += [(a, b, n, c, -p, -s) for n, (s, c) in enumerate(fits, 1)]
    return sorted(out)


def test_against_brute_force_with_ties_and_hot_label(spark):
    """Coarse vectors tie all the time, a third of the rows have one label, and anchors come in several batches."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 6, 5) / 4).tolist(), 0 if i % 3 == 0 else int(rng.integers(1, 5))) for i in range(0, 2400, 4)]
    rows += [(i + 1, v, lab) for i, v, lab in rows[::5]]  # copies
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, batch=7)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.0], 2), (200, [-1.0, 0.0], 9), (5, [0.0, 1.0], 9), (300, [1.0, 1.0], 4)]
    bad = [(4, None, 2), (6, [nan, 0.5], 2), (7, [inf, 0.5], 2), (8, [0.5, None], 2), (9, [0.5], 2), (10, [], 2), (11, [0.5, 0.0], None), (None, [0.5, 0.0], 2), (12, [3e37, 0.5], 2), (400, None, 1)]
    repeated = [(2, [0.5, 0.0], 2), (3, [0.6, 0.0], 2)]
    df = spark.createDataFrame([(*r, 7, 8) for r in good + bad + repeated], SCHEMA + ", x int, score int")
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(good) == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 3, 65536, 32768)]
    nothing = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(nothing, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0
    assert dict(negatives.mine(nothing, F.lit(True)).dtypes) == dict(negatives.mine(df, F.lit(True)).dtypes)


def test_heaps_not_rows_are_shuffled(spark, sf_dir):
    """What the last pass hands on is a window over heaps; vectors are dealt by round robin alone."""
    rows = base.table(spark, sf_dir, "embeddings")
    found = negatives.mine(rows, F.col("vec_id") % 100 == 0)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
