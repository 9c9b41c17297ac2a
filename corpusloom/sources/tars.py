"""Tar shards as a data source of Spark: format("tars"), to be read and to be written.

Reading. Each archive is an input partition (beyond MOST_TASKS archives, so many partitions
of about equal bytes), planned from a listing. A task streams its archives. What a sample's
members hold is put together inside that task from an index of the archive's headers, so
contents are never shuffled; an archive has no greatest size, a member may hold up to 2 GB.
Filters on `shard` (equal, in) leave archives out of the plan and filters on the end of
`name` leave members unread, where spark.sql.python.filterPushdown.enabled and the option
pushdown are on.

Writing. Rows arrive with those of a shard together, in one task, and go to its tar one by
one. Files are written below a folder of the run; commit moves those of the tasks that
counted to their names and abort deletes the folder, so that a failed, repeated or
speculative task leaves nothing behind.
"""

from __future__ import annotations

import contextlib
import io
import json
import tarfile
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, WriterCommitMessage

from .stores import listed, located, opened, settings

#: Rows and bytes of members that a task hands on at once, and most input partitions.
BATCH_ROWS, BATCH_BYTES, MOST_TASKS = 256, 32 << 20, 10_000

MEMBERS = "shard string, position long, name string, content binary, status string"
SAMPLES = "shard string, base string, files map<string, binary>, status string"

#: What reading a broken archive raises.
BROKEN = (tarfile.TarError, EOFError, OSError, zlib.error)


class Tars(DataSource):
    """Options: path; pattern of the archives' names; rows 'members' (MEMBERS) or 'samples' (SAMPLES); suffixes, comma-separated, of members to be read; content 'false' for members without their contents; pushdown 'true' where the session pushes filters to Python sources; and fs.s3a.* settings."""

    @classmethod
    def name(cls) -> str:
        return "tars"

    def schema(self) -> str:
        return SAMPLES if self.options.get("rows") == "samples" else MEMBERS

    def reader(self, schema) -> TarReader:
        return (PruningTarReader if self.options.get("pushdown") == "true" else TarReader)(self.options)

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make format("tars") known to the session."""
    if not spark._jsparkSession.sessionState().dataSourceManager().dataSourceExists(Tars.name()):
        spark.dataSource.register(Tars)


@dataclass
class Archives(InputPartition):
    paths: list[str]


def shard_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def headers(tar: tarfile.TarFile):
    """(position, header) of each member file; raises where the archive breaks off."""
    k = 0
    while (member := tar.next()) is not None:
        if member.isfile():
            yield k, member
        tar.members.clear()  # else it remembers all
        k += 1
    tar.fileobj.seek(tar.offset)
    if 0 < len(tar.fileobj.read(tarfile.BLOCKSIZE)) < tarfile.BLOCKSIZE:  # a header that breaks off ends the loop quietly
        raise tarfile.ReadError("unexpected end of data")


def _base_ext(name: str) -> tuple[str, str]:
    base, dot, ext = name.rpartition(".")
    return (base, ext.lower()) if dot else (name, name.lower())


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.samples = self.options.get("rows") == "samples"
        self.suffixes = tuple(s for s in self.options.get("suffixes", "").lower().split(",") if s)
        self.content = self.options.get("content", "true") != "false"
        self.shards: set[str] | None = None
        self.endings: list[str] = []

    def partitions(self) -> list[Archives]:
        found = [(p, size) for p, size in listed(self.options["path"], self.options.get("pattern", "*.tar"), self.options) if self.shards is None or shard_of(p) in self.shards]
        if len(found) <= MOST_TASKS:
            return [Archives([p]) for p, _ in found] or [Archives([])]
        dealt: list[list[str]] = [[] for _ in range(MOST_TASKS)]
        for k, (p, _) in enumerate(sorted(found, key=lambda f: -f[1])):  # there and back again, the large ones first
            turn, place = divmod(k, MOST_TASKS)
            dealt[place if turn % 2 == 0 else -1 - place].append(p)
        return [Archives(paths) for paths in dealt]

    def _wanted(self, name: str) -> bool:
        return (not self.suffixes or name.lower().endswith(self.suffixes)) and all(name.endswith(e) for e in self.endings)

    def _member_rows(self, shard: str, tar: tarfile.TarFile):
        for k, member in headers(tar):
            if self._wanted(member.name):
                yield shard, k, member.name, tar.extractfile(member).read() if self.content else None, "ok"

    def _sample_rows(self, shard: str, tar: tarfile.TarFile):
        """The headers first, then each sample's contents, in the order in which samples end, so that a compressed archive is read forward."""
        index: dict[str, dict[str, tarfile.TarInfo]] = {}
        broken = None
        try:
            for _, member in headers(tar):
                if self._wanted(member.name):
                    base, ext = _base_ext(member.name)
                    index.setdefault(base, {})[ext] = member  # of one name the last counts
        except BROKEN as e:
            broken = e
        for base, of in sorted(index.items(), key=lambda b: max(m.offset_data for m in b[1].values())):
            files = {}
            for ext, member in sorted(of.items(), key=lambda e: e[1].offset_data):
                try:
                    files[ext] = tar.extractfile(member).read()
                except BROKEN as e:
                    broken = e
            if files:
                yield shard, base, list(files.items()), "ok"
        if broken is not None:
            raise broken

    def _rows(self, path: str):
        """What a broken archive holds up to the break, and then a row that says so."""
        shard = shard_of(path)
        try:
            with opened(path, self.options) as archive, tarfile.open(fileobj=archive, mode="r:*") as tar:
                yield from (self._sample_rows if self.samples else self._member_rows)(shard, tar)
        except BROKEN as e:
            yield (shard, *[None] * (2 if self.samples else 3), f"corrupt: {type(e).__name__}")

    def read(self, partition: Archives):
        import pyarrow as pa

        text, data = pa.string(), pa.binary()
        columns = [("shard", text), ("base", text), ("files", pa.map_(text, data))] if self.samples else [("shard", text), ("position", pa.int64()), ("name", text), ("content", data)]
        schema = pa.schema([*columns, ("status", text)])
        size = (lambda row: sum(len(v) for _, v in row[2] or ())) if self.samples else (lambda row: len(row[3] or b""))
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows, held = [], 0
        for row in (row for path in partition.paths for row in self._rows(path)):
            rows.append(row)
            held += size(row)
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pack(rows)
                rows, held = [], 0
        if rows:
            yield pack(rows)


class PruningTarReader(TarReader):
    """A reader that takes filters; Spark refuses one where its setting is off."""

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column == "shard" and isinstance(f, EqualTo | In):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.shards = named if self.shards is None else self.shards & named
            elif column == "name" and isinstance(f, StringEndsWith) and not self.samples:
                self.endings.append(f.value)
            else:
                yield f


def register_shard_function(spark: SparkSession, name: str = "read_shard") -> None:
    """Make a table function known to SQL: read_shard(path) gives (base, exts, image, txt, json, status) of each sample of one tar, to be joined LATERAL with a table of paths.

    exts: the extensions of the sample's members, in order; image: its jpg or jpeg; txt and
    json as text, bytes that are not UTF-8 left out. A broken tar gives what it holds up to
    the break and a row whose status says 'corrupt'; a null path gives nothing.
    """
    from pyspark.sql.functions import udtf

    options = settings(spark)

    class ReadShard:
        def eval(self, path: str):
            if path is None:
                return
            for _, base, files, status in TarReader({**options, "rows": "samples"})._rows(path):
                of = dict(files or ())
                lenient = lambda ext, of=of: of[ext].decode("utf-8", "ignore") if ext in of else None
                yield base, sorted(of), of.get("jpg", of.get("jpeg")), lenient("txt"), lenient("json"), status

    spark.udtf.register(name, udtf(ReadShard, returnType="base string, exts array<string>, image binary, txt string, json string, status string"))


@dataclass
class Written(WriterCommitMessage):
    """(shard, temporary file, samples, samples without an image, bytes) of each tar of a task."""

    shards: list[tuple[str, str, int, int, int]]


class TarWriter(DataSourceArrowWriter):
    """Columns shard, key, image, caption. Options: path; summary, where commit puts a line for each shard; stats 'true' for sidecars; compress 'gz'."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.gz = self.options.get("compress") == "gz"
        self.run = f"_temporary-{uuid.uuid4().hex}"
        store, folder = self._folder()
        store.create_dir(f"{folder}/{self.run}", recursive=True)

    def _folder(self):
        store, path = located(self.options["path"].rstrip("/"), self.options)
        return store, path

    def write(self, iterator) -> Written:
        store, folder = self._folder()
        own = f"{folder}/{self.run}/{uuid.uuid4().hex}"  # of this attempt
        store.create_dir(own, recursive=False)  # a task that outlives an abort makes nothing new
        done, now, out, tar = [], None, None, None
        made = skipped = 0

        def close():
            if tar is not None:
                tar.close()
                out.close()
                file = f"{own}/{len(done)}"
                done.append((now, file, made, skipped, store.get_file_info(file).size))

        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "key", "image", "caption")]
                for row in zip(*columns, strict=True):
                    shard, key, image, caption = (v.as_py() for v in row)  # one row's bytes at a time
                    if tar is None or shard != now:
                        close()
                        now, made, skipped = shard, 0, 0
                        out = store.open_output_stream(f"{own}/{len(done)}")
                        tar = tarfile.open(fileobj=out, mode="w|gz" if self.gz else "w|")
                    if key is None or image is None:
                        skipped += 1
                        continue
                    made += 1
                    for ext, data in (("jpg", bytes(image)), ("txt", (caption or "").encode())):
                        info = tarfile.TarInfo(f"{key}.{ext}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
            close()
        except BaseException:
            for opened_by_now in (tar, out):
                with contextlib.suppress(Exception):
                    opened_by_now.close()
            store.delete_dir(own)
            raise
        return Written(done)

    def commit(self, messages) -> None:
        store, folder = self._folder()
        lines, placed = [], []
        try:
            for shard, file, made, skipped, size in (s for m in messages if m is not None for s in m.shards):
                stem = f"{folder}/{int(shard):05d}" if shard.isdecimal() else f"{folder}/{shard}"
                final = f"{stem}.tar.gz" if self.gz else f"{stem}.tar"
                store.create_dir(stem.rpartition("/")[0], recursive=True)
                store.move(file, final)
                placed.append(final)
                if self.options.get("stats") == "true":
                    with store.open_output_stream(f"{stem}_stats.json") as out:
                        out.write(json.dumps({"successes": made, "failed": skipped}).encode())
                    placed.append(f"{stem}_stats.json")
                lines.append(json.dumps({"shard": shard, "file": final, "n_samples": made, "n_failed": skipped, "bytes": size}))
        except BaseException:
            for file in placed:
                store.delete_file(file)
            raise  # abort does the rest
        self.abort(messages)  # what attempts that did not count have left
        if "summary" in self.options:
            place, path = located(self.options["summary"], self.options)
            place.create_dir(path.rpartition("/")[0], recursive=True)
            with place.open_output_stream(path) as out:
                out.write("\n".join(lines).encode())

    def abort(self, messages) -> None:
        import pyarrow.fs as fs

        store, folder = self._folder()
        own = f"{folder}/{self.run}"
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.delete_dir(own)
