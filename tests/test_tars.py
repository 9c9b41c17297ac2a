"""The tar data source: plans, pushed filters, order of members, commit and abort."""

import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F
from test_files import tar

from corpusloom.sources import archives, sinks, stores, tars

SAMPLES = "shard string, key string, image binary, caption string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ten_archives_are_ten_partitions_and_no_exchange(spark, tmp_path):
    for k in range(10):
        tar(tmp_path / f"{k}.tar", [(f"{k}/a.jpg", b"J" * k), (f"{k}/b.jpg", b"K"), (f"{k}/a.txt", b"one"), (f"{k}/b.txt", b"two"), (f"{k}/a.JPG", b"last")])
    samples = archives.read_tar_samples(spark, str(tmp_path))
    assert samples.rdd.getNumPartitions() == 10 and "Exchange" not in plan(samples)
    rows = {(r.shard, r.base): {k: bytes(v) for k, v in r.files.items()} for r in samples.collect()}
    assert rows == {(f"{k}.tar", f"{k}/{b}"): {"jpg": b"last" if b == "a" else b"K", "txt": b"one" if b == "a" else b"two"} for k in range(10) for b in "ab"}


def test_compressed_samples_members_between_others(spark, tmp_path):
    """A sample's members far apart, in a gzip tar, which is then read forward and back."""
    tar(tmp_path / "x.tar.gz", [(f"{i}.jpg", bytes([i]) * 999) for i in range(40)] + [(f"{i}.txt", str(i).encode()) for i in range(40)], mode="w:gz")
    tar(tmp_path / "y.tgz", [("n.jpg", b"1")], mode="w:gz", cut=40)
    got = archives.read_tar_samples(spark, str(tmp_path), "*.{tar.gz,tgz}").collect()
    assert {r.base: (bytes(r.files["jpg"]), bytes(r.files["txt"])) for r in got} == {str(i): (bytes([i]) * 999, str(i).encode()) for i in range(40)}
    raw = archives._tars(spark, str(tmp_path), pattern="*.tgz", rows="samples").collect()
    assert len(raw) == 1 and raw[0].base is None and raw[0].status.startswith("corrupt")


def test_content_that_breaks_off(spark, tmp_path):
    """A member whose content is cut is left out; its sample keeps what is whole."""
    tar(tmp_path / "0.tar", [("a.txt", b"cap"), ("a.jpg", b"J" * 3000)], cut=512 + 512 + 512 + 1000)
    rows = archives._tars(spark, str(tmp_path), rows="samples").collect()
    assert [(r.base, sorted(r.files or {})) for r in rows] == [("a", ["txt"]), (None, [])] and rows[1].status.startswith("corrupt")


def test_filters_are_pushed(spark, tmp_path):
    for k in range(4):
        tar(tmp_path / f"{k}.tar", [("a.jpg", b"J"), ("a.txt", b"T")])
    (tmp_path / "_hidden").mkdir()
    tar(tmp_path / "_hidden/9.tar", [("a.jpg", b"J")])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = archives.read_members(spark, str(tmp_path)).filter("shard in ('1.tar', '3.tar', 'none') and name like '%.txt' and position > 0")
        assert one.rdd.getNumPartitions() == 2 and sorted((r.shard, r.name) for r in one.collect()) == [("1.tar", "a.txt"), ("3.tar", "a.txt")]
        none = archives.read_tar_samples(spark, str(tmp_path)).filter("shard = '1.tar' and shard = '2.tar'")
        assert none.count() == 0
        reader = tars.PruningTarReader({"path": str(tmp_path)})
        assert list(reader.pushFilters([tars.EqualTo(("shard",), "2.tar"), tars.StringEndsWith(("name",), ".jpg")])) == [] and [p.paths for p in reader.partitions()] == [[f"{tmp_path}/2.tar"]]
        assert [r[2] for r in reader._rows(f"{tmp_path}/2.tar")] == ["a.jpg"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert archives.read_members(spark, str(tmp_path)).filter("shard = '1.tar'").count() == 2


def test_many_archives_share_partitions(tmp_path, monkeypatch):
    for k in range(25):
        (tmp_path / f"{k:02}.tar").write_bytes(b"x" * (100 - k))
    monkeypatch.setattr(tars, "MOST_TASKS", 4)
    parts = tars.TarReader({"path": str(tmp_path)}).partitions()
    sizes = [sum(os.path.getsize(p) for p in part.paths) for part in parts]
    assert len(parts) == 4 and sum(len(p.paths) for p in parts) == 25 and max(sizes) - min(sizes) <= 100


def test_null_images_and_keys_have_a_status(spark, tmp_path):
    rows = [("0", "a", b"J", "c"), ("0", "b", None, "c"), ("0", None, b"J", "c"), ("0", "d", b"K", None), ("x", "e", None, None)]
    done = sinks.write_tar_samples(spark.createDataFrame(rows, SAMPLES), str(tmp_path / "t"), stats=True)
    assert sorted((r.shard, r.n_samples, r.n_failed) for r in done.collect()) == [("0", 2, 2), ("x", 0, 1)]
    back = {r.base: {k: bytes(v) for k, v in r.files.items()} for r in archives.read_tar_samples(spark, str(tmp_path / "t")).collect()}
    assert back == {"a": {"jpg": b"J", "txt": b"c"}, "d": {"jpg": b"K", "txt": b""}}
    assert sorted(os.listdir(tmp_path / "t")) == ["00000.tar", "00000_stats.json", "x.tar", "x_stats.json"] and '"failed": 2' in (tmp_path / "t/00000_stats.json").read_text()
    assert sinks.write_tar_samples(spark.createDataFrame([], SAMPLES), str(tmp_path / "e")).count() == 0


def test_aborted_write_leaves_no_file(spark, tmp_path):
    """One of the tasks fails for good after others have written; the job fails and the folder is empty."""
    tars.register(spark)
    rows = spark.range(400).select((F.col("id") % 8).cast("string").alias("shard"), F.col("id").cast("string").alias("key"), F.lit(b"J").alias("image"), F.lit("c").alias("caption"))
    fail = F.udf(lambda k: k if k != "399" else 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        dealt = rows.repartition(8, "shard").sortWithinPartitions("shard")  # what fails, fails inside the writing tasks
        dealt.withColumn("caption", fail("key")).write.format("tars").mode("append").save(str(tmp_path / "t"))
    assert not list((tmp_path / "t").iterdir())


def test_commit_that_fails_takes_back_what_it_placed(spark, tmp_path):
    (tmp_path / "x.tar" / "full").mkdir(parents=True)  # a folder is in the way of the second shard
    rows = spark.createDataFrame([("0", "a", b"J", "c"), ("x", "b", b"K", "c")], SAMPLES).coalesce(1)
    with pytest.raises(Exception):
        sinks.write_tar_samples(rows, str(tmp_path), stats=True)
    assert os.listdir(tmp_path) == ["x.tar"]


def test_failed_attempt_and_commit(tmp_path):
    """An attempt that breaks inside a shard removes its folder; commit takes only what counted."""
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("shard", "key", "image", "caption"), r, strict=True)) for r in rows])
    writer = tars.TarWriter({"path": str(tmp_path), "summary": str(tmp_path / "s/summary.jsonl")})

    def breaks():
        yield batch([("1", "a", b"J", "c")])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    assert not list((tmp_path / writer.run).iterdir())
    first, again = writer.write(iter([batch([("1", "a", b"J", "c"), ("2", "b", b"K", "d")])])), writer.write(iter([batch([("1", "a", b"J", "c")])]))
    assert len(list((tmp_path / writer.run).iterdir())) == 2 and again.shards
    writer.commit([first, None])
    assert sorted(os.listdir(tmp_path)) == ["00001.tar", "00002.tar", "s"]
    with tarfile.open(fileobj=io.BytesIO((tmp_path / "00002.tar").read_bytes())) as t:
        assert t.getnames() == ["b.jpg", "b.txt"]


def test_gzip_round_trip_large_shards(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 2).alias("part"), F.col("id").alias("key"), F.encode(F.repeat("id", 50), "UTF-8").alias("image"), F.concat(F.lit("c"), "id").alias("caption"))
    done = sinks.write_tar_samples(rows, str(tmp_path / "t"), shard="part", compress="gz").collect()
    assert sorted((r.shard, r.n_samples, os.path.getsize(r.file) == r.bytes) for r in done) == [("0", 1500, True), ("1", 1500, True)]
    members = archives.read_tgz_members(spark, str(tmp_path / "t"))
    assert members.count() == 3000 and members.filter("status <> 'ok'").count() == 0
    back = archives.decode_captions(archives.read_tar_samples(spark, str(tmp_path / "t"), "*.tar.gz"))
    assert back.filter(F.col("txt") == F.concat(F.lit("c"), "base")).count() == 3000


def test_settings_of_the_session_reach_the_store(spark):
    conf = spark._jsc.hadoopConfiguration()
    try:
        for k, v in (("access.key", "A"), ("secret.key", "S"), ("endpoint.region", "eu-x")):
            conf.set(f"fs.s3a.{k}", v)
        options = stores.settings(spark)
        assert options.items() >= {"fs.s3a.access.key": "A", "fs.s3a.secret.key": "S", "fs.s3a.endpoint.region": "eu-x"}.items()
        store, path = stores.located("s3a://bucket/a/b.tar", options)
        assert store.type_name == "s3" and store.region == "eu-x" and path == "bucket/a/b.tar"
    finally:
        for k in ("access.key", "secret.key", "endpoint.region"):
            conf.unset(f"fs.s3a.{k}")
    assert stores.located("file:/x/y")[1] == "/x/y" and stores.located("/x/y")[1] == "/x/y"
