"""Queries that write archives, logs and datasets from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import arrays, text
from ..operators import filters
from ..sources import archives, metadata, sinks, tars
from .registry import META, meta, query, table


def _tars(spark, sf_dir):
    """Tar shards of 1,000 documents, a sample for each: its text as the image, its language as the caption."""
    path = storage.new_path(spark, "tars")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("image"), F.col("lang").alias("caption"), F.floor(F.col("doc_id") / 1000).alias("shard"))
    sinks.write_tar_samples(docs, path, stats=True)
    return path


@query("select concat(lpad(cast(doc_id // 1000 as varchar), 5, '0'), '.tar::', cast(doc_id as varchar)) as image_key, cast(octet_length(encode(text)) as bigint) as bytes, lang as caption from documents")
def tar_samples(spark, sf_dir):
    """Write shards, read their members, group them to samples and resolve the captions."""
    samples = archives.read_tar_samples(spark, _tars(spark, sf_dir))
    usable = archives.decode_captions(samples.filter(filters.usable_sample(F.col("files"))))
    return usable.select(F.concat("shard", F.lit("::"), "base").alias("image_key"), F.length(F.col("files")["jpg"]).cast("long").alias("bytes"), text.resolve_caption(F.col("txt"), F.col("json")).alias("caption"))


@query("""select concat(lpad(cast(doc_id // 1000 as varchar), 5, '0'), '.tar') as shard, cast(doc_id as varchar) as name, octet_length(encode(text)) as bytes, sha256(text) as digest, 'ok' as status
from documents where text is not null and (doc_id // 1000) % 2 = 0
union all select concat(lpad(cast(doc_id // 1000 as varchar), 5, '0'), '.tar'), cast(doc_id as varchar), octet_length(encode(lang)), sha256(lang), 'ok' from documents where text is not null and (doc_id // 1000) % 2 = 0""")
def tar_contents(spark, sf_dir):
    """Every member of every other shard, contents compared by digest; the other shards are not opened."""
    members = archives.read_members(spark, _tars(spark, sf_dir), pattern="*[02468].tar")
    return members.select("shard", F.regexp_replace("name", "[.](jpg|txt)$", "").alias("name"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"), "status")


@query("""select concat(lpad(cast(doc_id // 2000 as varchar), 5, '0'), '.tar.gz') as shard, cast(2 * (row_number() over (partition by doc_id // 2000 order by cast(doc_id as varchar)) - 1) as bigint) as position,
  concat(cast(doc_id as varchar), '.jpg') as name, 'ok' as status from documents where text is not null""")
def tgz_members(spark, sf_dir):
    """Image members of gzip tars with their places; captions lie between them."""
    path = storage.new_path(spark, "tgz")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("image"), F.col("lang").alias("caption"), F.floor(F.col("doc_id") / 2000).alias("shard"))
    sinks.write_tar_samples(docs, path, compress="gz")
    return archives.read_tgz_members(spark, path)


@query("""select lpad(cast(doc_id // 1000 as varchar), 5, '0') as shard, count(text) as n_samples, count(*) - count(text) as n_failed from (select doc_id, case when doc_id % 17 <> 0 then text end as text from documents) group by 1""")
def write_tars(spark, sf_dir):
    """What a write reports of each shard; samples without an image are counted, not written."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 17 != 0, F.encode("text", "UTF-8")).alias("image"), F.col("lang").alias("caption"), F.lpad(F.floor(F.col("doc_id") / 1000).cast("string"), 5, "0").alias("shard"))
    return sinks.write_tar_samples(docs, storage.new_path(spark, "tars")).select("shard", "n_samples", "n_failed")


@query("""select concat(lpad(cast(doc_id // 1000 as varchar), 5, '0'), '.tar') as shard, cast(doc_id as varchar) as base, 'jpg,txt' as exts, octet_length(encode(text)) as bytes, lang as caption, 'ok' as status from documents where text is not null""")
def read_shard(spark, sf_dir):
    """Tars read in SQL: a table of paths joined LATERAL with a table function."""
    tars.register_shard_function(spark)
    spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(_tars(spark, sf_dir)).select("path").createOrReplaceTempView("tar_paths")
    return spark.sql("""select element_at(split(p.path, '/'), -1) as shard, s.base, array_join(s.exts, ',') as exts, cast(length(s.image) as bigint) as bytes, s.txt as caption, s.status from tar_paths p, lateral read_shard(p.path) s""")


@query("""select concat(cast(doc_id // 500 as varchar), '.zip') as archive, concat(cast(doc_id as varchar), '.png') as name, case when doc_id % 3 = 0 then lang end as p, case when doc_id % 3 = 1 then source end as prompt, 'ok' as status
from documents where doc_id % 5 <> 0""")
def zip_manifest(spark, sf_dir):
    """Zips of 500 documents with a manifest; every fifth entry of it names no file of its zip."""
    path = storage.new_path(spark, "zips")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 500).alias("zip"))

    def pack(pdf):
        import io
        import json
        import zipfile

        from corpusloom.sources.stores import located

        store, folder = located(path)
        store.create_dir(folder, recursive=True)
        attributes = {f"{r.doc_id}.png": {"p": r.lang} if r.doc_id % 3 == 0 else {"prompt": r.source} if r.doc_id % 3 == 1 else {} for r in pdf.itertuples()}
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("part.json", json.dumps(attributes))
            for name in attributes:
                if int(name[:-4]) % 5:
                    z.writestr(name, b"")
        with store.open_output_stream(f"{folder}/{pdf.zip.iloc[0]}.zip") as out:
            out.write(data.getvalue())
        return pdf.head(1)[["doc_id"]]

    rows.groupBy("zip").applyInPandas(pack, "doc_id long").write.format("noop").mode("overwrite").save()
    return archives.read_zip_manifest(spark, path)


@query("""with e as (select vec_id, embedding, concat(lpad(cast(vec_id as varchar), 9, '0'), '.npy') as latent_name from embeddings where embedding is not null),
k as (select * from e order by latent_name limit (select greatest(1, cast(floor(count(*) * 0.6) as bigint)) from e))
select latent_name, '8,8' as shape, round(list_sum(list_transform(embedding, lambda x, i: i * cast(x as double))), 4) as placed from k where vec_id % 13 <> 0""")
def npy_latents(spark, sf_dir):
    """The first three fifths of .npy tensors by name; every thirteenth file breaks off and is left out."""
    path = storage.new_path(spark, "npy")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter("embedding is not null")

    def save(batches):
        import io

        import numpy as np
        from corpusloom.sources.stores import located

        store, folder = located(path)
        store.create_dir(folder, recursive=True)
        for pdf in batches:
            for vec_id, vector in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                data = io.BytesIO()
                np.save(data, np.asarray(vector, np.float32).reshape(8, 8))
                with store.open_output_stream(f"{folder}/{vec_id:09d}.npy") as out:
                    out.write(data.getvalue()[: 100 if vec_id % 13 == 0 else None])
            yield pdf[["vec_id"]]

    rows.mapInPandas(save, "vec_id long").write.format("noop").mode("overwrite").save()
    latents = archives.read_npy_latents(spark, path, 0.6)
    placed = arrays.total(F.transform("latent", lambda x, i: x.cast("double") * (i + 1)))
    return latents.select("latent_name", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.round(placed, 4).alias("placed"))


_PADDED = "cast(ceil(octet_length(encode({0})) / 512.0) as bigint) * 512"


@query(f"""with s as (select doc_id // 1000 as shard, count(*) as n, cast(ceil((1024 + sum(1024 + {_PADDED.format("text")} + {_PADDED.format("lang")})) / 10240.0) as bigint) * 10240 as bytes from documents group by 1)
select count(*) as n_shards, cast(sum(bytes) as bigint) as bytes, cast(sum(n) as bigint) as successes from s""")
def shard_inventory(spark, sf_dir):
    """Shards, their bytes (blocks of 512 in records of 10,240) and what their sidecars report."""
    return metadata.shard_inventory(spark, _tars(spark, sf_dir)).select("n_shards", "bytes", "successes")


@query(f"""select concat(lpad(cast(doc_id // 1000 as varchar), 5, '0'), '.tar') as shard, count(*) as n, md5(string_agg(concat(cast(doc_id as varchar), '.txt'), ',' order by cast(doc_id as varchar))) as names from documents group by 1""")
def tar_members(spark, sf_dir):
    """The captions' names in each archive, by the headers alone."""
    found = archives.read_members(spark, _tars(spark, sf_dir), suffixes=(".txt",), content=False)
    return found.groupBy("shard").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.regexp_replace("name", "[.]txt$", ""))), lambda x: F.concat(x, F.lit(".txt"))), ",")).alias("names"))


@query("""select concat(lpad(cast(doc_id // 1000 as varchar), 5, '0'), '.tar') as shard, cast(doc_id as varchar) as base, 'jpg,txt' as exts from documents where text is not null and doc_id % 10 = 1""")
def usable_samples(spark, sf_dir):
    """Of samples that mostly lack a caption, because only some captions are read, those that can be used."""
    samples = archives.read_tar_samples(spark, _tars(spark, sf_dir), suffixes=(".jpg", "1.txt"))
    return samples.filter(filters.usable_sample(F.col("files"))).select("shard", "base", F.array_join(F.array_sort(F.map_keys("files")), ",").alias("exts"))


@query("""select o_orderkey, o_totalprice, case when row_number() over (order by md5(concat('11:', cast(o_orderkey as varchar))), o_orderkey) <= least(100, (select count(*) // 10 from orders)) then 'val' else 'train' end as split from orders""")
def dataset_rows(spark, sf_dir):
    """Every row of a written dataset with the part it is in."""
    path = storage.new_path(spark, "dataset")
    sinks.write_dataset(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path, 100, 11, "o_orderkey")
    return spark.read.parquet(f"{path}/data").select("o_orderkey", "o_totalprice", "split")


@query("select count(*) - least(100, count(*) // 10) as train_size, least(100, count(*) // 10) as val_size, 512 as image_size, 11 as seed from orders")
def write_dataset(spark, sf_dir):
    """Split, write both parts and the configuration, and read the configuration back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    config = sinks.write_dataset(orders, storage.new_path(spark, "dataset"), 100, 11, "o_orderkey")
    return config.select("train_size", "val_size", "image_size", "seed")


@query(r"""with l as (select regexp_replace(unnest(string_split(text, chr(10))), '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') as prompt from conversations)
select prompt, count(*) as n from l where prompt <> '' group by prompt""")
def read_prompts(spark, sf_dir):
    """Prompts written one per line, read back stripped, blank lines left out."""
    path = storage.new_path(spark, "prompts")
    table(spark, sf_dir, "conversations").filter("text is not null").select("text").write.text(path)
    return metadata.read_prompts(spark, path).groupBy("prompt").agg(F.count("*").alias("n"))


@query("select cast(l_orderkey % 5000 as varchar) as value from lineitem group by 1")
def read_done_log(spark, sf_dir):
    """A log with repeated lines as a set."""
    path = storage.new_path(spark, "done")
    table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5000).cast("string").alias("value")).write.text(path)
    return metadata.read_done_log(spark, path)


@query("""select doc_id as row_id, concat('http://img.example/', cast(doc_id as varchar)) as "URL", text as "TEXT", n_chars as "WIDTH" from documents""")
def read_metadata(spark, sf_dir):
    """Two folders of files with different column names, read as one table."""
    path = storage.new_path(spark, "metadata")
    docs, url = table(spark, sf_dir, "documents"), F.concat(F.lit("http://img.example/"), F.col("doc_id").cast("string"))
    docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("row_id"), url.alias("url"), F.col("text").alias("caption"), F.col("n_chars").alias("width")).write.parquet(f"{path}/a")
    docs.filter("doc_id % 2 <> 0").select(F.col("doc_id").alias("row_id"), url.alias("URL"), F.col("text").alias("TEXT"), F.col("n_chars").alias("WIDTH")).write.parquet(f"{path}/b")
    return metadata.read_metadata(spark, path).select("row_id", "URL", "TEXT", "WIDTH")


@query(f"""with {META} select row_id, "URL", "TEXT" from meta where "URL" is not null and "TEXT" is not null and aesthetic_score >= 6.5""")
def write_filtered(spark, sf_dir):
    """Filtered rows written as Parquet and read back."""
    path = storage.new_path(spark, "filtered")
    sinks.write_filtered(meta(spark, sf_dir).filter("URL is not null and TEXT is not null and aesthetic_score >= 6.5").select("row_id", "URL", "TEXT"), path)
    return spark.read.parquet(path)


@query("""select event_id, day from (select event_id, strftime(ts, '%Y-%m-%d') as day from events) order by md5(concat('8:', day)), day, event_id limit (select count(*) // 2 from events)""")
def read_capped(spark, sf_dir):
    """Half of the events out of files of a day each: whole days, and the first events of one."""
    path = storage.new_path(spark, "days")
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    events.repartition("day").sortWithinPartitions("day", "event_id").write.partitionBy("day").parquet(path)
    found = metadata.read_capped(spark, path, events.count() // 2, 8, F.date_format("day", "yyyy-MM-dd"))
    return found.select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("select count(*) as n, sum(o_orderkey) as keys, true as bounded from orders")
def write_batches(spark, sf_dir):
    """Files of at most 1,000 rows: what they hold together, and whether each keeps to the bound."""
    path = storage.new_path(spark, "batches")
    sinks.write_batches(table(spark, sf_dir, "orders").select("o_orderkey"), path, 1_000)
    each = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return each.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), (F.max("n") <= 1_000).alias("bounded"))
