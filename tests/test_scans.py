"""Running numbers and sums against plain loops, with groups that are cut into blocks."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics, sampling, scans

HOT = {"share": 16, "least": 20}


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds a third of the rows, another many equal times, one is null, and there are nulls in order and value."""
    draw = random.Random(4)
    data = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else "tied" if i % 3 == 1 and i % 2 else None if i % 7 == 0 else f"g{i % 50}"
        t = 5 if g == "tied" and i % 4 else None if i % 29 == 0 else draw.randrange(900)
        data.append((g, t, i, None if i % 31 == 0 else draw.random() * 10))
    draw.shuffle(data)
    return data, spark.createDataFrame(data, "g string, t int, i int, v double").repartition(6).cache()


def by_group(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_numbers_sums_and_totals(rows):
    data, df = rows
    got = scans.numbered(df, ["g"], ["t", "i"], "n", {"total": F.col("v"), "odd": F.col("i") % 2}, "all", **HOT)
    assert got.columns == ["g", "t", "i", "v", "n", "total", "odd", "all"]
    found = {r.i: r for r in got.collect()}
    assert len(found) == len(data)
    for own in by_group(data).values():
        total = odd = 0
        for n, (_, _, i, v) in enumerate(own, 1):
            total, odd = total + (v or 0), odd + i % 2
            assert (found[i].n, found[i].odd, found[i]["all"]) == (n, odd, len(own)) and abs(found[i].total - total) < 1e-9


def test_without_groups_and_on_small_tables(rows, spark):
    data, df = rows
    order = [r[2] for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
    assert {r.i: r.rn for r in scans.numbered(df, [], ["t", "i"], **HOT).collect()} == {i: k for k, i in enumerate(order, 1)}
    assert scans.numbered(df.limit(0), ["g"], ["t"], total="all").count() == 0
    assert [(r.rn, r.m) for r in scans.numbered(spark.range(1), [], ["id"], total="m").collect()] == [(1, 1)]


def test_a_hot_group_spreads(rows):
    """No window partition of a hot group holds much more than its share; ties stay together."""
    data, df = rows
    counts = df.groupBy("g").agg(F.count("*").alias("_n"))
    hot = scans._cuts(df, ["g"], F.struct("t", "i"), counts.filter("_n >= 20 and _n * 16 > 3000"), 3000, 16, 20)
    sizes = {r._of0: (r._n, len(r._cuts)) for r in hot.collect()}
    assert set(sizes) == {None, "hot", "tied"} and sizes["hot"] == (1000, 5) and sizes["tied"] == (500, 2)
    plan = scans.numbered(df, ["g"], ["t", "i"], **HOT)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    # one shuffle of the rows: the other exchanges are of counts, samples and summaries
    assert scans.numbered(df, ["g"], ["t", "i"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_places_by_a_column_spread(rows, monkeypatch):
    """A value that a third of the rows have is cut by its ties; more rows make more blocks."""
    data, df = rows
    skewed = df.withColumn("t", F.when(F.col("i") % 3 == 0, F.lit(7)).otherwise(F.col("t")))
    order = [i for _, i in sorted((7 if i % 3 == 0 else -1 if t is None else t, i) for _, t, i, _ in data)]
    monkeypatch.setattr(scans, "LEAST", 20)
    shares = []
    number = scans.numbered
    monkeypatch.setattr(sampling, "numbered", lambda *args, share, **scan: shares.append(share) or number(*args, share=share, least=20, **scan))
    for slice_rows, share in ((1 << 22, 256), (10, 512), (1, 4096)):
        monkeypatch.setattr(sampling, "SLICE_ROWS", slice_rows)
        got = sampling.ordered_position(skewed, "t", ["i"])
        assert {r.i: r.rn for r in got.collect()} == {i: k for k, i in enumerate(order, 1)} and shares.pop() == share
    blocks = scans._cuts(skewed.withColumn("a", F.lit(0)), ["a"], F.struct("t", "i"), skewed.groupBy(F.lit(0).alias("a")).agg(F.count("*").alias("_n")), 3000, 256, 20).first()["_cuts"]
    held = [sum((7 if i % 3 == 0 else -1 if t is None else t, i) > (-1 if c[0] is None else c[0], c[1]) for c in blocks) for _, t, i, _ in data]
    assert len(blocks) > 50 and max(held.count(b) for b in set(held)) < 120
    assert sampling.ordered_position(skewed.limit(0), "t", ["i"]).count() == 0


def test_search_of_cuts(spark):
    """In two steps as in one, at, between and beyond cuts of any number."""
    for n in (0, 1, 7, 8, 9, 23, 24, 40):
        cuts = [2 * k for k in range(n)]
        df = spark.range(-1, 2 * n + 2).withColumn("_cuts", F.array(*(F.struct(F.lit(c).cast("long").alias("id")) for c in cuts)) if cuts else F.array().cast("array<struct<id:bigint>>")).withColumn("_every", F.filter("_cuts", lambda c, i: i % scans.STRIDE == scans.STRIDE - 1))
        assert all(r.b == sum(c < r.id for c in cuts) for r in df.select("id", scans._block(F.struct("id")).alias("b")).collect())


def test_metrics_of_hot_groups(rows):
    data, df = rows
    groups = by_group(data)
    means = {r.i: (r.step, r.running_mean) for r in metrics.running_mean(df, "v", ["t", "i"], ["g"], 7, **HOT).collect()}
    emas = {r.g: (r.ema, r.n) for r in metrics.ema(df, "v", ["t", "i"], ["g"], 0.9, **HOT).collect()}
    batches = {r.i: r.batch for r in sampling.assign_batches(df, 24, ["g"], ["t", "i"], True, **HOT).collect()}
    timed = df.withColumn("ts", F.timestamp_seconds(F.coalesce("t", F.lit(0))))
    speed = {(r.g, r.chunk): (r.items, r.seconds) for r in metrics.throughput(timed, "ts", ["t", "i"], ["g"], 100, **HOT).collect()}
    seen = 0
    for g, own in groups.items():
        total = n = 0
        average = None
        for k, (_, _, i, v) in enumerate(own, 1):
            if v is not None:
                d = min(0.9, (1 + n) / (10 + n))
                average = v if average is None else average * d + v * (1 - d)
                total, n = total + v, n + 1
            if k % 7 == 0:
                seen += 1
                assert means[i][0] == k and abs(means[i][1] - total / n) < 1e-9
            assert batches.get(i) == ((k - 1) // 24 if (k - 1) // 24 < len(own) // 24 else None)
        assert emas[g][1] == n and abs(emas[g][0] - average) < 1e-9
        for c in range(0, len(own), 100):
            times = [t or 0 for _, t, _, _ in own[c : c + 100]]
            assert speed[g, c // 100] == (len(times), max(times) - min(times))
    assert len(means) == seen
