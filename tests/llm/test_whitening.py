"""Whitening against numpy's eigenvalues and exact whole numbers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import base, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def wholes(values):
    return np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in values])


def check(got, rows, count=4):
    """Whitened rows, up to one sign for each component, and the figures that go with them."""
    x = wholes([v for _, v in rows])
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(0)
    centred = listed - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(rows) * min(count, int((values > 1e-10 * values[0]).sum()))
    by_row = {}
    for r in got:
        by_row.setdefault(r.component, {}).setdefault(r.vec_id, r)
    for component, of in by_row.items():
        expected = (x - sums / n) @ vectors[:, component - 1] / np.sqrt(values[component - 1])
        whitened = np.array([of[i].whitened for i, _ in rows])
        sign = np.sign(expected @ whitened)
        assert np.allclose(whitened, sign * expected, rtol=0, atol=1e-8)
        for k, (i, _) in enumerate(rows):
            assert of[i].n == n and of[i].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))
        assert abs(of[rows[0][0]].explained / (values[component - 1] / values.sum()) - 1) < 1e-10
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in base.table(spark, sf_dir, "embeddings").collect()]
    check(queries.op12_whitening(spark, sf_dir).collect(), rows)


def test_copies_weigh_once(spark):
    """A third of the rows are one vector; the fit list has it once."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 6)) * [1, 2, 3, 4, 5, 6]).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(whitening.whiten(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect(), rows)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 2**32 - 1), st.sampled_from(["full", "equal", "close", "thin"]))
def test_components(d, seed, kind):
    """Unit, orthogonal and with small residuals, for clusters of equal and of close eigenvalues as well."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = {"full": rng.random(d) * 10, "equal": np.repeat([5.0, 2.0], [(d + 1) // 2, d // 2]), "close": 3 + 1e-9 * rng.random(d), "thin": np.r_[7.0, np.zeros(d - 1)]}[kind]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    found, vectors = whitening.components(v, 5)
    expected = np.linalg.eigvalsh(v)[::-1][:5]
    size = max(1.0, abs(expected[0]))
    assert np.allclose(found, expected, rtol=0, atol=1e-12 * size)
    assert np.allclose(v @ vectors, vectors * found, rtol=0, atol=1e-10 * size)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), rtol=0, atol=1e-9)


def test_sturm_counts():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(9, 9))
    v += v.T
    diagonal, off, _ = whitening.tridiagonal(v)
    values = np.linalg.eigvalsh(v)
    for x in np.linspace(values[0] - 1, values[-1] + 1, 50):
        assert whitening.below(diagonal, off, x) == (values < x).sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.25]), (5, [-1.0, 0.001])]
    bad = [(6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (11, [])]
    df = spark.createDataFrame([(i, v, None, 1, 2.0) for i, v in [*good, *bad, (None, [0.5, 0.25]), (3, [0.5, 0.25])]], SCHEMA + ", component int, n double")
    got = whitening.whiten(df).collect()
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 3 for r in got) == 4
    seen = set()
    check([r for r in got if r.vec_id is not None and (r.vec_id, r.component) not in seen and not seen.add((r.vec_id, r.component))], good)
    for rows in ([], good[:1], [good[0], (4, good[0][1])], bad):
        assert whitening.whiten(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).count() == 0


def test_entries_beyond_a_long(spark):
    """They become the nearest long; what then exceeds a long as a deviation is null."""
    df = spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 2.0], 0)], SCHEMA)
    got = whitening.whiten(df).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, deviation_of(3))}
    assert whitening.deviations(np.array([[2**40, 0]]), 2, [2**41 - 3, 5]) == [9 + 25]
    assert whitening.deviations(np.array([[2**62, 0]]), 2, [2**63 - 3, 5]) == [9 + 25]
    assert whitening.deviations(np.array([[2**62, 0]]), 2, [0, 0]) == [None]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 10**6), st.integers(0, 45), st.integers(0, 2**32 - 1))
def test_deviations_are_exact(d, n, bits, seed):
    """Sums of squares far below, about and far above the end of a long, against Python's whole numbers."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-(2**bits), 2**bits + 1, (8, d))
    sums = [int(s) for s in rng.integers(-(2**bits) * n, 2**bits * n + 1, d)]
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == [y if y < 2**63 else None for y in want]


@pytest.mark.parametrize("apart", [3037000498, 3037000499, 3037000500, 2147483648])
def test_deviations_at_the_end_of_a_long(apart):
    """3037000499 is the greatest number whose square is a long; two squares of 2^31 are one too many."""
    for row in ([apart, 0, 0], [apart, 1, 0], [apart, apart, 0], [apart, 77936, 0], [2147483648, 2147483648, 1]):
        want = sum(a * a for a in row)
        assert whitening.deviations(np.array([row]), 1, [0, 0, 0]) == [want if want < 2**63 else None]


def deviation_of(row):
    x = [[2**63 - 1, 0], [-(2**63), 256], [0, 512]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    return sum((3 * a - s) ** 2 for a, s in zip(x[row - 1], sums, strict=True))


def test_too_many_dimensions_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LARGEST", 1)
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA))
