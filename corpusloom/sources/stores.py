"""Files opened inside tasks, on a local disk or in an object store."""

from __future__ import annotations

import fnmatch
import re

#: Names under which Spark knows a store, and those of pyarrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}

#: Spark's settings of the S3 connector, and the arguments of pyarrow's file system.
_S3 = {"access.key": "access_key", "secret.key": "secret_key", "session.token": "session_token", "endpoint": "endpoint_override", "endpoint.region": "region"}


def settings(spark) -> dict[str, str]:
    """What the session knows about S3 (fs.s3a.*), to be handed to tasks as options of a data source."""
    conf = spark._jsc.hadoopConfiguration()
    return {f"fs.s3a.{k}": v for k in _S3 if (v := conf.get(f"fs.s3a.{k}"))}


def located(uri: str, options: dict[str, str] | None = None):
    """The pyarrow file system of a path as Spark writes it, and the path there; S3 with the session's settings, if options has them."""
    import pyarrow.fs as fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    known = {name: options[k] for k, name in ((f"fs.s3a.{k}", name) for k, name in _S3.items()) if options and options.get(k)}
    if _SCHEMES.get(scheme, scheme) == "s3" and known:
        return fs.S3FileSystem(**known), rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def opened(uri: str, options: dict[str, str] | None = None):
    """A file to read and seek in, of which only what is asked for is fetched."""
    store, path = located(uri, options)
    return store.open_input_file(path)


def spelled_out(pattern: str) -> list[str]:
    """A pattern with one list of choices in braces as plain patterns."""
    found = re.fullmatch(r"(.*)\{(.*)\}(.*)", pattern)
    return [found[1] + choice + found[3] for choice in found[2].split(",")] if found else [pattern]


def listed(uri: str, pattern: str, options: dict[str, str] | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a path whose names fit, in order; hidden and temporary ones are left out. A path of a file is that file."""
    import pyarrow.fs as fs

    store, path = located(uri, options)
    path = path.rstrip("/") or "/"
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    wanted, head = spelled_out(pattern), uri.rstrip("/")
    found = []
    for f in store.get_file_info(fs.FileSelector(path, recursive=True)):
        below = f.path[len(path) :].lstrip("/")
        if f.type == fs.FileType.File and not any(part[0] in "_." for part in below.split("/")) and any(fnmatch.fnmatchcase(f.base_name, w) for w in wanted):
            found.append((f"{head}/{below}", f.size))
    return sorted(found)
