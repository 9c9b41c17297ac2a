"""Substring deduplication by hashing line-like units that are cut by their words.

Texts are read as words (lower-cased letters and digits; in scripts without spaces each
character is a word). The lines of a corpus end anywhere, and a passage may stand inside
one, so the units are content-defined: of every stretch of `min_words` words one part of a
third of that length, the one with the least digest, is a unit, and two equal stretches of
that many words share one whatever stands around them. Digests are grouped over all
documents; the earliest holder, by (doc_id, text hash, place), keeps its unit. For every
later one the range that it shares with its earliest holder is found to the word: units
that follow each other in both texts form a chain, and at a chain's two ends the words
beyond it are compared with those of the holder. Ranges of `min_words` words or more are
removed; their original character offsets are kept in `removed`.

`line_words`, if given, makes every whole line of that many words or more a unit as well,
the later ones of which go however short they are.

A digest's rows are pre-aggregated before they are shuffled. Digests that many documents
share are joined where the documents are, by broadcast; no group is gathered, and what comes
to a document is the list of its own ranges.

Defined cases: null texts stay null; empty texts, and texts with fewer words than
`min_words` (or, as lines, `line_words`), are never cut; rows with the same doc_id and text
are one document and are cut alike; rows with a null doc_id rank last; where a range
overlaps its own holder in one text, the holder's part stays. A text that is a copy as a
whole becomes empty.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

#: Scripts written without spaces; each of their characters counts as a word.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
_WORD = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")
#: A word with the marks around it.
_PIECE = re.compile(f"(?:(?<!\\S)[^\\w\\s{_UNSPACED}]+)?(?:{_WORD.pattern})[^\\w\\s{_UNSPACED}]*")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: The place of a text's first line; smaller places are words.
_LINES = 1 << 40
#: Words whose hashes a task remembers.
_MEMO = 200_000


def hashes(text: str | None, memo: dict[str, int]) -> np.ndarray:
    """The hash of each word of a text."""
    if len(memo) > _MEMO:
        memo.clear()
    words = _WORD.findall(text or "")
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w.lower())
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(words: np.ndarray, size: int) -> np.ndarray:
    """The digest of the `size` words from each word on; the last words of a text begin none."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for k in range(size):
        out += words[k : k + n] * np.uint64(power)
        power = power * _BASE & _MASK
    return _mixed(out)


def _slide(best, x: np.ndarray, width: int) -> np.ndarray:
    """best (a minimum or maximum) of each `width` values in a row."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - width + size], x[width - size :]) if size < width else x


def anchors(found: np.ndarray, width: int) -> np.ndarray:
    """The places at which a digest is the least of some `width` digests in a row."""
    if len(found) < width:
        return np.zeros(0, np.int64)
    edge = np.zeros(width - 1, np.uint64)
    least = np.concatenate((edge, _slide(np.minimum, found, width), edge))
    return np.flatnonzero(found == _slide(np.maximum, least, width))


def thinned(found: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Of places that have one digest and overlap, as in a text that repeats a few words, the first, the last and one for each quarter of `size` words."""
    if len(np.unique(found)) == len(found):
        return places
    order = np.lexsort((places, found))
    digest, at = found[order], places[order]
    begins = np.concatenate(([True], (digest[1:] != digest[:-1]) | (np.diff(at) > size)))
    step = (at - at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]) // max(1, size // 4)
    kept = begins | np.concatenate((begins[1:], [True])) | (np.diff(step, prepend=0) != 0)
    return np.sort(at[kept])


def line_digests(lines: list[np.ndarray], line_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the lines of line_words words or more, given the hashes of each line's words, and their places."""
    out, places = [], []
    powers = np.array(list(accumulate(range(max(map(len, lines))), lambda p, _: p * _BASE & _MASK, initial=1)), np.uint64)
    for k, words in enumerate(lines):
        if len(words) >= line_words:
            out.append((words * powers[: len(words)]).sum() + np.uint64(len(words)))
            places.append(_LINES + k)
    return _mixed(_mixed(np.array(out, np.uint64)) ^ np.uint64(_BASE)), np.array(places, np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many first values are the same."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def ranges(words: np.ndarray, chains: list, min_words: int) -> list[tuple[int, int]]:
    """The word ranges to remove. A chain: its first word, the word after its last, the distance to its holder in the same text (0: another text), the holder's words before it (from the nearest on) and after it."""
    out, words = [], words.astype("<u4")
    for low, high, shift, before, after in chains:
        start = low - common(words[:low][::-1], np.frombuffer(before, "<u4"))
        end = high + common(words[high:], np.frombuffer(after, "<u4"))
        if shift:
            start = max(start, end - shift)
        if end - start >= min_words:
            out.append((start, end))
    return out


def spans(text: str, found: list[tuple[int, int]], lines: list[int]) -> list[tuple[int, int]]:
    """The character ranges of word ranges and of whole lines, merged where only white space lies between."""
    if found:
        at = [m.span() for m in _PIECE.finditer(text)]
        found = [(at[a][0], at[b - 1][1]) for a, b in found]
    again, start = set(lines), 0
    for k, line in enumerate(text.split("\n") if again else []):
        if k in again:
            found.append((start + len(line) - len(line.lstrip()), start + len(line.rstrip())))
        start += len(line) + 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and (a <= out[-1][1] or text[out[-1][1] : a].isspace()):
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the ranges. White space on both sides of one becomes a single break, a new line if either side has one; at the text's ends it goes."""
    parts, at = [], 0
    for a, b in runs:
        left, right = a, b
        while left > at and text[left - 1].isspace():
            left -= 1
        while right < len(text) and text[right].isspace():
            right += 1
        parts.append(text[at:left])
        if left > 0 and right < len(text) and not (left == at and len(parts) == 1):
            gap = text[left:a] + text[b:right]
            parts.append(("\n" if "\n" in gap else " ") if left < a and b < right else gap)
        at = right
    return "".join([*parts, text[at:]])


_UNITS = T.StructType([T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.LongType()))])
_AROUND = T.StructType([T.StructField("around", T.ArrayType(T.StructType([T.StructField("digest", T.LongType()), T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())])))])
_CHAINS = "doc_id long, h long, low long, high long, shift long, first long, last long, first_at long, last_at long, held_by long, held_h long"


def _units(size: int, window: int, line_words: int | None):
    memo: dict[str, int] = {}

    def work(texts):
        for text in texts:
            found = digests(hashes(text, memo), size)
            places = anchors(found, window)
            places = thinned(found[places], places, size)
            parts = [(found[places], places)]
            if line_words is not None:
                parts.append(line_digests([hashes(x, memo) for x in (text or "").split("\n")], line_words))
            yield [d for x, _ in parts for d in x.view(np.int64).tolist()], [p for _, x in parts for p in x.tolist()]

    return work


def _around(size: int, reach: int):
    """The words around asked units, as bytes: those before, from the nearest on, and those after."""
    memo: dict[str, int] = {}

    def work(rows):
        for row in rows:
            words, asked = hashes(row["text"], memo).astype("<u4"), {(x["digest"], x["place"]) for x in row["asked"]}
            yield ([{"digest": d, "before": words[max(0, p - reach) : p][::-1].tobytes(), "after": words[p + size : p + size + reach].tobytes()} for d, p in sorted(asked)],)

    return work


def _chained(size: int):
    """Joins each document's later units to chains that follow their holder at the same distance without a gap."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            units = batch.column(2)
            flat = units.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(units.offsets.to_numpy()))
            place, digest, at, held_h = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            held = flat.field(4)
            held_by = held.fill_null(0).to_numpy(zero_copy_only=False)
            none = held.is_null().to_numpy(zero_copy_only=False)
            if not len(row):
                continue
            order = np.lexsort((place, at - place, held_h, held_by, none, row))
            keys = np.stack([x[order].astype(np.int64) for x in (row, none, held_by, held_h, at - place)])
            begins = np.concatenate(([True], (np.diff(keys) != 0).any(0) | (np.diff(place[order]) > size)))
            first, last = order[begins], order[np.concatenate((begins[1:], [True]))]
            ids, own = batch.column(0), batch.column(1)
            take = pa.array(row[first])
            same = (own.to_numpy()[row[first]] == held_h[first]) & (ids.fill_null(0).to_numpy(zero_copy_only=False)[row[first]] == held_by[first]) & (ids.is_null().to_numpy(zero_copy_only=False)[row[first]] == none[first])
            columns = [ids.take(take), own.take(take), *(pa.array(x) for x in (place[first], place[last] + size, np.where(same, place[first] - at[first], 0), digest[first], digest[last], at[first], at[last])), held.take(pa.array(first)), pa.array(held_h[first])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "low", "high", "shift", "first", "last", "first_at", "last_at", "held_by", "held_h"])

    return run


def repeated(docs: DataFrame, min_words: int = 50, line_words: int | None = None) -> DataFrame:
    """(doc_id, h, chains, lines): for each document that has any, what it repeats of earlier ones.

    docs: doc_id (a long) and text; h: xxhash64 of the text.
    """
    size = max(1, min_words // 3)
    window = min_words - size + 1
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    units = base.add_text_columns(texts, "text", _UNITS, lambda: _units(size, window, line_words)).drop("text").filter("size(digests) > 0")
    units = base.written(units, "units")
    each = units.select("doc_id", "h", F.inline(F.arrays_zip("digests", "places"))).toDF("doc_id", "h", "digest", "place")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "place")
    # partial aggregation leaves one row for a digest and task
    first = base.written(each.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    later = base.join_with_hot_keys(each, first, "digest", "n").filter(rank > F.col("first"))
    unit = F.struct("place", "digest", F.col("first.place").alias("at"), F.col("first.h").alias("held_h"), F.col("first.doc_id").alias("held_by"))
    by_text = later.groupBy("doc_id", "h").agg(F.collect_list(F.when(F.col("place") < _LINES, unit)).alias("units"), F.collect_set(F.when(F.col("place") >= _LINES, F.col("place") - _LINES)).alias("lines"))
    by_text = base.written(by_text, "later")
    base.forget(units)
    base.forget(first)
    chains = base.written(by_text.select("doc_id", "h", "units").mapInArrow(_chained(size), _CHAINS), "chains")

    # the words around the chains' ends, asked of their holders
    own = ["doc_id", "h", "low", "high", "shift"]
    ends = chains.select(*own, "held_by", "held_h", F.inline(F.array(F.struct(F.lit(True).alias("begin"), F.col("first").alias("digest"), F.col("first_at").alias("place")), F.struct(F.lit(False).alias("begin"), F.col("last").alias("digest"), F.col("last_at").alias("place")))))
    asked = base.written(ends.groupBy("digest", "place", "held_by", "held_h").agg(F.count("*").alias("n")), "asked")
    wanted = asked.groupBy(F.col("held_by").alias("_by"), F.col("held_h").alias("_h")).agg(F.collect_list(F.struct("digest", "place")).alias("asked"))
    holders = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_by")) & (F.col("h") == F.col("_h"))).select(F.struct("text", "asked").alias("row"))
    around = base.add_text_columns(holders, "row", _AROUND, lambda: _around(size, window - 1)).select(F.inline("around")).dropDuplicates(["digest"])
    around = base.written(around.join(asked.select("digest", "n"), "digest"), "around")
    side = F.when(F.col("begin"), F.col("before")).otherwise(F.col("after"))
    met = base.join_with_hot_keys(ends.select(*own, "begin", "digest"), around, "digest", "n").select(*own, "begin", side.alias("words"))
    by_end = met.groupBy("doc_id", "h").agg(F.collect_list(F.struct("low", "high", "shift", "begin", "words")).alias("chains"))
    lines = by_text.filter("size(lines) > 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "lines")
    both = by_end.join(lines, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "full") if line_words is not None else by_end.withColumn("lines", F.array().cast("array<bigint>"))
    return both.select(F.coalesce("doc_id", "_id").alias("doc_id"), F.coalesce("h", "_h").alias("h"), "chains", "lines") if line_words is not None else both


def _ends_paired(chains: list[dict] | None) -> list[tuple]:
    """(low, high, shift, before, after) of each chain, of which either end came in a row of its own."""
    paired: dict[tuple, dict[bool, bytes]] = {}
    for c in chains or ():
        paired.setdefault((c["low"], c["high"], c["shift"]), {})[c["begin"]] = c["words"]
    return [(*key, words.get(True, b""), words.get(False, b"")) for key, words in paired.items()]


def deduplicate(docs: DataFrame, min_words: int = 50, line_words: int | None = None) -> DataFrame:
    """docs (columns doc_id and text among others) with repeated passages cut out of text, plus `removed`: their [start, end) in the original text."""
    h, found, removed = (base.fresh(docs, x) for x in ("_h", "_found", "removed"))
    places = repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words, line_words)
    places = places.select(F.col("doc_id").alias("_key"), F.col("h").alias("_own"), F.struct("chains", "lines").alias(found))
    joined = docs.withColumn(h, F.xxhash64("text")).join(places, F.col("doc_id").cast("long").eqNullSafe(F.col("_key")) & (F.col(h) == F.col("_own")), "left").drop(h, "_key", "_own")
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, T.ArrayType(T.ArrayType(T.LongType())))])
    text_at, found_at = joined.columns.index("text"), joined.columns.index(found)

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_type

        kind, memo = to_arrow_type(schema[removed].dataType), {}
        for batch in batches:
            cut = batch.column(text_at).to_pylist()
            out: list[list] = [[] for _ in cut]
            for k in np.flatnonzero(batch.column(found_at).is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = batch.column(found_at)[k].as_py()
                chains = _ends_paired(own["chains"])
                runs = spans(cut[k], ranges(hashes(cut[k], memo), chains, min_words) if chains else [], own["lines"] or [])
                if runs:
                    cut[k], out[k] = without(cut[k], runs), [list(r) for r in runs]
            columns = list(batch.columns)
            columns[text_at], columns[found_at] = pa.array(cut, pa.string()), pa.array(out, kind)
            yield pa.RecordBatch.from_arrays(columns, [*schema.names])

    return joined.mapInArrow(run, schema)


def cut(docs: DataFrame, min_words: int = 50, line_words: int | None = None) -> DataFrame:
    """docs with repeated passages cut out; n_chars follows the text; same columns. Texts of which nothing stays go."""
    name = base.fresh(docs, "removed")
    out = deduplicate(docs, min_words, line_words)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.filter(~((F.size(name) > 0) & F.col("text").rlike("^\\s*$"))).select(*docs.columns)
