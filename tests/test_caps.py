"""Caps by running sums of files and of slices."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling
from corpusloom.sources import metadata


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    data = [(draw.choice(["a", "b", "c", None, "a b", "d"]) if i % 3 else "hot", i) for i in range(2000)]
    return data, spark.createDataFrame(data, "file string, row int").repartition(5).cache()


@pytest.mark.parametrize("unit", ["file", "row"])
@pytest.mark.parametrize("n", [0, 1, 333, 1000, 1999, 2000, 9999])
def test_first_rows_of_the_order(rows, unit, n):
    data, df = rows
    md5 = lambda *parts: hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()
    order = sorted(data, key=lambda r: (md5(3, r[0]) if unit == "file" else md5(3, *r), r[0] is not None, r[0] or "", r[1]))
    got = sampling.cap_samples(df, n, 3, "file", "row", unit)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, order[:n])) and got.columns == ["file", "row"]


def test_rows_that_stay_are_not_sorted(rows):
    """Only the part where the last row lies is numbered; the others pass a filter or a semi join."""
    _, df = rows
    for unit in ("file", "row"):
        plan = sampling.cap_samples(df, 1234, 3, "file", "row", unit)._jdf.queryExecution().executedPlan().toString()
        assert "limit=1234" not in plan and "rangepartitioning" not in plan and plan.count("Window [") <= 2, plan
    assert sampling.cap_samples(df.limit(0), 5, 3, "file", "row").count() == 0
    with pytest.raises(ValueError, match="unit"):
        sampling.cap_samples(df, 1, 1, "file", "row", "other")


def test_other_files_are_not_read(spark, tmp_path):
    """Files of 10 rows: 5 are chosen, one of them in part; the names have odd letters."""
    for k in range(12):
        spark.range(k * 10, k * 10 + 10).withColumn("v", F.col("id") * 2).coalesce(1).write.parquet(str(tmp_path / f"x {k}+%=é"))
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
    got = metadata.read_capped(spark, f"{tmp_path}/*", 45, 9)
    assert got.count() == 45 and len(got.inputFiles()) == 5
    by_file = [r["count"] for r in got.groupBy((F.col("id") / 10).cast("int").alias("f")).count().collect()]
    assert sorted(by_file) == [5, 10, 10, 10, 10]
    part = got.groupBy((F.col("id") / 10).cast("int").alias("f")).agg(F.count("*").alias("n"), F.max(F.col("id") % 10).alias("last")).filter("n = 5").first()
    assert part["last"] == 4  # its first rows
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in metadata.read_capped(spark, f"{tmp_path}/*", 45, 9).collect())
    assert metadata.read_capped(spark, f"{tmp_path}/*", 500, 9).count() == 120 and metadata.read_capped(spark, f"{tmp_path}/*", 0, 9).count() == 0
