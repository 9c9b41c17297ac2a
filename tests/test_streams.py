"""Stateful streams: the bucketed table over many batches, and averages whose values come late."""

import pathlib
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.plans import catalogue
from corpusloom.streaming import averages, jobs, tables

SCHEMA = "k string, s long, v double"


def live(table):
    return {b: len(of) for b, of in table.manifest()["live"].items()}


def test_many_batches_keep_few_folders(spark, tmp_path):
    """14 small batches over 3 buckets: a bucket never has more than MOST folders, the first row of a key stays, null is a key."""
    table = tables.BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "k", buckets=3)
    draw, want, most = random.Random(1), {}, 0
    for n in range(14):
        rows = [(draw.choice([None, *(f"k{j}" for j in range(60))]), n * 100 + i, float(n)) for i in range(6)]
        for k, s, v in sorted(rows, key=lambda r: r[1]):
            want.setdefault(k, (s, v))
        table.merge(spark.createDataFrame(rows, SCHEMA).coalesce(1), n, ["s"])
        most = max(most, *live(table).values())
    assert {r.k: (r.s, r.v) for r in table.read().collect()} == want and table.read().count() == len(want)
    assert 3 <= most <= tables.MOST + 1 and len(table.versions()) == 2
    kept = {v for of in table.manifest()["live"].values() for v in of} | {v for of in table.manifest(table.versions()[0])["live"].values() for v in of}
    assert set(table._names("data")) == {v for v in table._names("data") if v in kept}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = tables.BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "k", buckets=4)
    table.merge(spark.createDataFrame([("a", 1, 1.0), ("a", 0, 2.0), ("b", 1, 3.0)], SCHEMA), 0, ["s"])
    table.merge(spark.createDataFrame([("a", -5, 9.0), ("c", 1, 4.0)], SCHEMA), 1, ["s"])
    before, manifest = sorted(map(tuple, table.read().collect())), table.manifest()
    for n in (0, 1):
        table.merge(spark.createDataFrame([("z", 1, 1.0)], SCHEMA), n, ["s"])
    assert sorted(map(tuple, table.read().collect())) == before == [("a", 0, 2.0), ("b", 1, 3.0), ("c", 1, 4.0)] and table.manifest() == manifest
    table.merge(spark.createDataFrame([], SCHEMA), 2, ["s"])
    assert sorted(map(tuple, table.read().collect())) == before
    with pytest.raises(ValueError, match="buckets"):
        tables.BucketTable(spark, str(tmp_path / "t"), table.schema, "k", buckets=5).merge(spark.createDataFrame([("z", 1, 1.0)], SCHEMA), 9, ["s"])


def test_a_batch_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    """Files are written, the manifest is not: readers see the table as before, and the batch's next run completes it."""
    table = tables.BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "k", buckets=2)
    table.merge(spark.createDataFrame([("a", 1, 1.0)], SCHEMA), 0, ["s"])
    with monkeypatch.context() as m:
        m.setattr(tables.BucketTable, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(spark.createDataFrame([("b", 1, 1.0), ("c", 1, 1.0)], SCHEMA), 1, ["s"])
    assert [r.k for r in table.read().collect()] == ["a"]
    table.merge(spark.createDataFrame([("b", 1, 1.0), ("c", 1, 1.0)], SCHEMA), 1, ["s"])
    assert sorted(r.k for r in table.read().collect()) == ["a", "b", "c"]


def test_only_touched_buckets_are_read(spark, tmp_path, monkeypatch):
    table = tables.BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "k", buckets=16)
    table.merge(spark.createDataFrame([(f"k{i}", 1, 1.0) for i in range(200)], SCHEMA), 0, ["s"])
    asked = []
    rows = tables.BucketTable._rows
    monkeypatch.setattr(tables.BucketTable, "_rows", lambda self, folders: asked.append(folders) or rows(self, folders))
    table.merge(spark.createDataFrame([("k7", 2, 2.0), ("new", 1, 1.0)], SCHEMA), 1, ["s"])
    assert 1 <= len(asked[0]) <= 2 and asked[1] == []
    assert table.read().count() == 201 and table.read().filter("k = 'k7'").first().v == 1.0


def averaged(values, decay):
    ema, n = None, 0
    for x in values:
        d = min(decay, (1 + n) / (10 + n))
        ema, n = (x if ema is None else ema * d + x * (1 - d)), n + 1
    return ema, n


def stream_of(spark, path, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{k}")
    return jobs.source(spark, f"{path}/*/*.parquet", spark.createDataFrame([], SCHEMA).schema, 1)


def test_late_values_within_the_bound(spark, tmp_path):
    """Values come up to 5 places late, in five batches; a hot key has most rows; nulls are left out."""
    draw = random.Random(3)
    series = {k: [(s, draw.random()) for s in range(n)] for k, n in (("hot", 900), ("b", 40), ("c", 1))}
    rows = [(k, s, v) for k, of in series.items() for s, v in of] + [("d", 0, None)]
    rows.sort(key=lambda r: r[1] + draw.random() * 5)
    files = [rows[i * 200 : i * 200 + 200] for i in range(5)]
    got = {r.k: r for r in jobs.ema_stream(stream_of(spark, tmp_path / "in", files), "k", ["s"], "v", 0.97, *(str(tmp_path / x) for x in ("out", "cp")), hold=12).collect()}
    assert set(got) == set(series)
    for k, of in series.items():
        ema, n = averaged([v for _, v in of], 0.97)
        assert (got[k].n, got[k].n_late) == (n, 0) and abs(got[k].ema - ema) < 1e-12


def test_values_beyond_the_bound_are_counted(spark, tmp_path):
    files = [[("a", s, float(s)) for s in range(10, 30)], [("a", 1, 1.0), ("a", 40, 40.0)]]
    got = jobs.ema_stream(stream_of(spark, tmp_path / "in", files), "k", ["s"], "v", 0.9, *(str(tmp_path / x) for x in ("out", "cp")), hold=2).first()
    ema, n = averaged([*map(float, range(10, 28)), 1.0, 28.0, 29.0, 40.0], 0.9)
    assert (got.n, got.n_late) == (n, 1) and abs(got.ema - ema) < 1e-12


def test_idle_keys_are_forgotten(spark, tmp_path):
    """With a time to live of a second, a key that comes again later begins anew."""
    paths = [str(tmp_path / x) for x in ("out", "cp")]
    run = lambda: jobs.ema_stream(jobs.source(spark, f"{tmp_path}/in/*/*.parquet", spark.createDataFrame([], SCHEMA).schema, 1), "k", ["s"], "v", 0.9, *paths, hold=2, ttl=1000)
    spark.createDataFrame([("a", s, 1.0) for s in range(5)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    assert run().first().n == 5
    time.sleep(1.5)
    spark.createDataFrame([("a", 9, 7.0)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run()
    rows = spark.read.parquet(paths[0]).filter(F.col("ema") == 7.0).collect()
    assert [r.n for r in rows] == [1]


@pytest.mark.parametrize("groups", [None, 3])
def test_a_batch_in_any_order(spark, tmp_path, groups):
    """Rows of a micro-batch over many files and small Arrow batches, in no order: none is late. Null is a key and an order, a NaN is a value."""
    draw = random.Random(5)
    series = {k: [(s, draw.random()) for s in range(n)] for k, n in ((None, 70), (0, 300), (7, 90), (1 << 60, 1), ((1 << 60) + 1, 2))}
    series[7][0] = (None, 0.5)
    series[1 << 60] = [(0, float("nan"))]
    rows = [(k, s, v) for k, of in series.items() for s, v in of] + [(9, 0, None)]
    early, late = ([r for r in rows if ((r[1] or 0) < 40) == first] for first in (True, False))
    out, size = [str(tmp_path / x) for x in ("out", "cp")], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        for name, part in (("0", early), ("1", late)):
            draw.shuffle(part)
            df = spark.createDataFrame(part, "k long, s long, v double")
            df.repartition(5).write.parquet(str(tmp_path / "in" / name))
            got = {r.k: r for r in jobs.ema_stream(jobs.source(spark, f"{tmp_path}/in/*/*.parquet", df.schema), "k", ["s"], "v", 0.97, *out, hold=2, groups=groups).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(got) == set(series)
    for k, of in series.items():
        ema, n = averaged([v for _, v in of], 0.97)
        assert (got[k].n, got[k].n_late) == (n, 0) and (abs(got[k].ema - ema) < 1e-12 or ema != ema and got[k].ema != got[k].ema)


def test_a_key_longer_than_a_chunk(spark, tmp_path, monkeypatch):
    """Memory is bounded: a long series is folded in chunks, in order where it comes in order."""
    most = []
    settle = averages.Average.settle
    monkeypatch.setattr(averages.Average, "settle", lambda self, kept, arrived: most.append(max(map(len, arrived.values()), default=0)) or settle(self, kept, arrived))
    average = averages.Average("k", 0.97, 4, None, chunk=100)
    average.state = type("State", (), {"kept": None, "exists": lambda self: self.kept is not None, "get": lambda self: self.kept, "update": lambda self, v: setattr(self, "kept", v)})()
    values = [random.Random(8).random() for _ in range(1000)]
    for at in (0, 600):
        part = pd.DataFrame({"g": 0, "there": True, "k": "a", "o0": range(at, min(1000, at + 600)), "v": values[at : at + 600]})
        got = next(average.handleInputRows((0,), (part.iloc[i : i + 30] for i in range(0, len(part), 30)), None)).iloc[0]
    ema, n = averaged(values, 0.97)
    assert (got.n, got.n_late) == (n, 0) and abs(got.ema - ema) < 1e-12 and max(most) <= 129


def test_ema_stream_query_keeps_few_states(spark, sf_dir, tmp_path, monkeypatch):
    """A micro-batch is written by several tasks, and a state is kept for many users."""
    made = []
    new_path = storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda spark, label: made.append(new_path(spark, label)) or made[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as the table is
    try:
        users = catalogue.QUERIES["ema_stream"](spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files, checkpoint = next(p for p in made if "events-" in p), next(p for p in made if "ema-" in p) + "/checkpoint"
    assert min(len(list(part.glob("*.parquet"))) for part in pathlib.Path(files).iterdir() if part.is_dir()) > 1
    states = spark.read.format("statestore").option("stateVarName", "averages").load(checkpoint).count()
    assert users >= 10 and 0 < states <= 1 + users // 32
