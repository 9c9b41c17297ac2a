"""String expressions with the reference semantics of Python's str methods."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() knows the space only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    """Number of runs of characters that are not white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def contains_any(c: Column, words: Iterable[str], whole_word: bool = False) -> Column:
    """Whether any of the words occurs in the lower-cased text, as a substring or as a word of its own."""
    either = "|".join(re.escape(w) for w in words) or r"\b\B"
    return F.lower(c).rlike(rf"\b(?:{either})\b" if whole_word else either)


def slug(c: Column, length: int = 50, index: Column | None = None) -> Column:
    """A file name from the first characters: letters, digits, space, _ and - stay; after a number of three digits or more, if one is given."""
    name = F.regexp_replace(F.substring(c, 1, length), r"[^\p{L}\p{N} _-]", "_")
    return name if index is None else F.concat(F.format_string("%03d_", index), name)


def resolve_caption(txt: Column, json: Column) -> Column:
    """The text file wins, then the JSON's caption (even if empty), then its TEXT, else nothing; stripped."""
    return strip(F.coalesce(txt, F.get_json_object(json, "$.caption"), F.get_json_object(json, "$.TEXT"), F.lit("")))


def manifest_prompt(p: Column, prompt: Column, name: Column) -> Column:
    """The manifest's p, else prompt, empty counting as missing, else the image's name."""
    return F.coalesce(F.nullif(p, F.lit("")), F.nullif(prompt, F.lit("")), name)
