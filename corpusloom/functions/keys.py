"""The keys that tie images, captions, tokens and latents together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "::"


def latent_name(key: Column) -> Column:
    """File name of a key's latent. Not injective: see operators.joins.name_collisions."""
    return F.concat(F.replace(F.replace(key, F.lit("/"), F.lit("_")), F.lit(SEPARATOR), F.lit("__")), F.lit(".npy"))


def split_key(key: Column) -> tuple[Column, Column]:
    """Shard and base, cut at the first separator; a key without one has no base."""
    parts = F.split(key, SEPARATOR, 2)
    return parts[0], F.get(parts, F.lit(1))


def part_key(part: Column, name: Column) -> Column:
    """part-000001/<name without .png>"""
    return F.concat(F.format_string("part-%06d/", part), F.replace(name, F.lit(".png"), F.lit("")))


def archive_key(prefix: str, archive: Column, name: Column) -> Column:
    """<prefix>_007/<stem>"""
    return F.concat(F.format_string(f"{prefix}_%03d/", archive), path_stem(name))


def shard_key(shard: Column, base: Column) -> Column:
    return F.concat(shard, F.lit(SEPARATOR), base)


def path_stem(path: Column) -> Column:
    """Last part of a path without its last suffix; a leading dot begins no suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def base_ext(name: Column) -> tuple[Column, Column]:
    """A member's name cut at its last dot, the extension lower-cased; without a dot both are the name."""
    has = F.contains(name, F.lit("."))
    return F.when(has, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name), F.lower(F.when(has, F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(name))
