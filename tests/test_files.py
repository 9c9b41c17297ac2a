"""Archives, listings, datasets and streams over small files made here."""

import io
import json
import tarfile
import zipfile

import numpy as np
from pyspark.sql import functions as F

from corpusloom.sources import archives, metadata, sinks
from corpusloom.streaming import jobs


def tar(path, members, mode="w", cut=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    path.write_bytes(out.getvalue()[:cut])


def test_tar_samples(spark, tmp_path):
    tar(tmp_path / "0.tar", [("a.jpg", b"J"), ("a.TXT", b" cap\xff tion here "), ("d/b.jpeg", b"K"), ("d/b.json", b'{"caption": "from json"}'), ("c.jpg", b"L"), ("e.txt", b"x")])
    tar(tmp_path / "1.tar", [("z.jpg", b"Z" * 2000), ("y.jpg", b"Y" * 2000)], cut=3000)
    samples = archives.read_tar_samples(spark, str(tmp_path))
    from corpusloom.functions import text
    from corpusloom.operators import filters

    usable = archives.decode_captions(samples.filter(filters.usable_sample(F.col("files")))).select("shard", "base", text.resolve_caption(F.col("txt"), F.col("json")).alias("c"))
    assert sorted(map(tuple, usable.collect())) == [("0.tar", "a", "cap tion here"), ("0.tar", "d/b", "from json")]
    broken = archives.read_members(spark, str(tmp_path)).filter("shard = '1.tar'").collect()
    assert [r.name for r in broken if r.status == "ok"] == ["z.jpg"] and any(r.status.startswith("corrupt") for r in broken)


def test_gzip_and_zip(spark, tmp_path):
    tar(tmp_path / "a.tgz", [("x.JPG", b"1"), ("y.webp", b"2"), ("note.txt", b"3")], mode="w:gz")
    assert sorted(r.name for r in archives.read_tgz_members(spark, str(tmp_path)).collect()) == ["x.JPG", "y.webp"]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("part.json", json.dumps({"a.png": {"p": "pa"}, "b.png": {"prompt": "pb"}, "gone.png": {"p": "x"}}))
        z.writestr("other.json", json.dumps({"a.png": {"p": "no"}}))
        z.writestr("a.png", b"")
        z.writestr("b.png", b"")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    manifest = archives.read_zip_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, manifest.filter("status = 'ok'").drop("status").collect())) == [("p.zip", "a.png", "pa", None), ("p.zip", "b.png", None, "pb")]
    assert [(r.archive, r.name, r.status[:8]) for r in manifest.filter("status <> 'ok'").collect()] == [("bad.zip", None, "corrupt:")]


def test_latents(spark, tmp_path):
    for k in range(10):
        np.save(tmp_path / f"{k}.npy", np.full((4, 2, 2), k, np.float16))
    (tmp_path / "9.npy").write_bytes(b"cut")
    got = archives.read_npy_latents(spark, str(tmp_path)).orderBy("latent_name").collect()
    assert [r.latent_name for r in got] == [f"{k}.npy" for k in range(9)] and got[3].shape == [4, 2, 2] and got[3].latent == [3.0] * 16
    assert archives.read_npy_latents(spark, str(tmp_path), 0.35).count() == 3


def test_metadata_and_listings(spark, tmp_path):
    sub = tmp_path / "m" / "deep"
    spark.createDataFrame([("u1", "t1", 600)], "url string, caption string, width int").coalesce(1).write.parquet(str(sub / "a"))
    spark.createDataFrame([("u2", "t2")], "URL string, TEXT string").coalesce(1).write.parquet(str(sub / "b"))
    got = metadata.read_metadata(spark, str(tmp_path / "m")).orderBy("URL").collect()
    assert [(r.URL, r.TEXT, r.WIDTH, r.row_index) for r in got] == [("u1", "t1", 600, 0), ("u2", "t2", None, 0)] and all(r.file.endswith(".parquet") for r in got)
    assert metadata.read_keys(spark, str(sub / "b"), "URL").columns == ["URL"] and metadata.count_rows(spark, str(sub / "a")) == 1
    (tmp_path / "done.log").write_text("a\nb\na\n")
    (tmp_path / "prompts.txt").write_text("  x \n\n　\ny\n")
    assert sorted(r.value for r in metadata.read_done_log(spark, str(tmp_path / "done.log")).collect()) == ["a", "b"]
    assert [r.prompt for r in metadata.read_prompts(spark, str(tmp_path / "prompts.txt")).collect()] == ["x", "y"]
    for d, n in (("s1", 3), ("s2", 1)):
        (tmp_path / "t" / d).mkdir(parents=True)
        for k in range(n):
            (tmp_path / "t" / d / f"{k}.tar").write_bytes(b"12345")
    (tmp_path / "t/s1/0_stats.json").write_text('{"successes": 7}')
    (tmp_path / "t/s1/1_stats.json").write_text("broken")
    got = {r.directory.rsplit("/", 1)[-1]: (r.n_shards, r.bytes, r.successes) for r in metadata.shard_inventory(spark, str(tmp_path / "t")).collect()}
    assert got == {"s1": (3, 15, 7), "s2": (1, 5, 0)}


def test_datasets_and_tars_round_trip(spark, tmp_path):
    df = spark.range(50).selectExpr("id as k", "concat('c', id) as caption")
    config = sinks.write_dataset(df, str(tmp_path / "ds"), 3, 1, "k").first()
    assert (config.train_size, config.val_size, config.columns, config["mode"]) == (47, 3, ["k", "caption"], "standard")
    assert spark.read.parquet(str(tmp_path / "ds/data")).filter("split = 'val'").count() == 3
    sinks.write_batches(df.coalesce(1), str(tmp_path / "b"), 20)
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 3
    sinks.write_filtered(df, str(tmp_path / "f"))
    assert sinks.union_sources(df, spark.read.parquet(str(tmp_path / "f")).drop("caption")).filter("caption is null").count() == 50
    samples = df.selectExpr("cast(k as string) as key", "cast('JPG' as binary) as image", "caption", "k % 3 as shard")
    done = sinks.write_tar_samples(samples, str(tmp_path / "tars")).collect()
    assert sorted((r.shard, r.n_samples) for r in done) == [("0", 17), ("1", 17), ("2", 16)] and sorted(p.name for p in (tmp_path / "tars").iterdir()) == ["00000.tar", "00001.tar", "00002.tar"]
    back = archives.read_tar_samples(spark, str(tmp_path / "tars"))
    assert back.count() == 50 and {bytes(r.j) for r in back.selectExpr("files['jpg'] as j").collect()} == {b"JPG"}


def test_streams_resume_and_match_batches(spark, tmp_path, sf_dir):
    src, schema = tmp_path / "in", "k string, s long, v double, ts timestamp"
    rows = [("a", 1, 4.0, "2024-01-01 00:10:00"), ("a", 2, 2.0, "2024-01-01 00:50:00"), ("b", 1, 1.0, "2024-01-01 01:10:00"), ("a", 3, 6.0, "2024-01-01 02:10:00"), ("b", 2, 5.0, "2024-01-01 05:00:00"), ("a", 4, 1.0, "2024-01-01 00:20:00")]
    frame = lambda r: spark.createDataFrame(r, "k string, s long, v double, t string").selectExpr("k", "s", "v", "cast(t as timestamp) as ts").coalesce(1)
    frame(rows[:3]).write.mode("append").parquet(str(src))
    stream = lambda: jobs.source(spark, str(src) + "/*.parquet", frame(rows).schema)
    paths = {n: (str(tmp_path / n / "out"), str(tmp_path / n / "cp")) for n in ("dedup", "upsert", "progress", "ema")}

    def run():
        return (
            jobs.dedup_stream(stream(), ["k", "v"], "ts", "365 days", *paths["dedup"]).count(),
            sorted(tuple(r) for r in jobs.upsert_stream(stream(), "k", ["s"], *paths["upsert"]).select("k", "s").collect()),
            sorted((str(r.start), r.n) for r in jobs.progress_stream(stream(), "ts", [], "1 hour", "10 minutes", *paths["progress"]).collect()),
            {r.k: (round(r.ema, 9), r.n) for r in jobs.ema_stream(stream(), "k", ["s"], "v", 0.99, *paths["ema"]).collect()},
        )

    first = run()
    assert first[:3] == (3, [("a", 1), ("b", 1)], [("2024-01-01 00:00:00", 2)])
    assert run() == first  # nothing new, nothing twice
    frame(rows[3:5]).write.mode("append").parquet(str(src))
    second = run()
    assert second[:2] == (5, [("a", 1), ("b", 1)])
    frame(rows[5:]).write.mode("append").parquet(str(src))
    last = run()
    # the row of 00:20 is late: its window closed when the watermark passed 01:00
    assert last[2] == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 1)]
    from corpusloom.operators import metrics

    batch = {r.k: (round(r.ema, 9), r.n) for r in metrics.ema(frame(rows), "v", ["s"], ["k"], 0.99).collect()}
    assert last[3] == batch and schema


def test_ema_stream_query(spark, sf_dir):
    from corpusloom.plans import catalogue

    a, b = (sorted(map(tuple, catalogue.QUERIES[n](spark, sf_dir).select("user_id", "ema", "n").collect())) for n in ("ema", "ema_stream"))
    assert a == b
