"""Benchmark decontamination: one Aho-Corasick automaton over windows of benchmark words.

Texts are normalised to word sequences: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
A window is `size` consecutive words of an item; an item of fewer words, but not none, is
one window. The automaton reads each document's words once; every occurrence marks its
words as hit and keeps the original character offsets of their union.

The benchmark is counted before it is sent to the executors: every automaton holds at most
`part_windows` windows, and a larger benchmark is dealt over several automata. Each passes
over the documents in a job of its own, which writes what was found so far beside them, so
that only one automaton is held at a time; there is no shuffle.

Defined cases: null or wordless texts have no words and no hits; null item texts or ids
take no part; a repeated item_id is one item with all its windows; repeated documents are
each reported; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: The same on UTF-8 bytes: A-Z lower-cased, bytes outside words made spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
_STATE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


def normalised(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def windows(items: list[tuple[str, str]], size: int) -> dict[tuple[str, ...], set[str]]:
    """Each window's words with the ids of the items that hold it."""
    out: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        words = WORD.findall(normalised(text))
        for k in range(max(1, len(words) - size + 1) if words else 0):
            out.setdefault(tuple(words[k : k + size]), set()).add(item)
    return out


class Scanner:
    """An automaton over word numbers; words that no window holds are number 0."""

    def __init__(self, found: dict[tuple[str, ...], set[str]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in found.items():
            self.automaton.add_word(tuple(self.number.setdefault(w.encode(), len(self.number) + 1) for w in window), (len(window), tuple(items)))
        self.shortest = min(map(len, found), default=1)
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The union of occurrences as [first word, word after the last], and the items."""
        runs: list[list[int]] = []
        items: set[str] = set()
        numbers = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        # an occurrence lies within a run of words that some window holds
        edges = np.flatnonzero(np.diff(np.concatenate(([False], numbers > 0, [False]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                for last, (length, ids) in self.automaton.iter(tuple(numbers[start:end].tolist())):
                    items.update(ids)
                    runs.append([start + last + 1 - length, start + last + 1])
        return merged(runs), items


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_scanners: dict[str, Scanner] = {}


def _scanner(sent) -> Scanner:
    """One automaton per worker and broadcast."""
    if sent.value["key"] not in _scanners:
        _scanners.clear()
        _scanners[sent.value["key"]] = Scanner(sent.value["windows"])
    return _scanners[sent.value["key"]]


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 13, part_windows: int = 2_000_000, text: str = "text", name: str = "found") -> DataFrame:
    """docs with a struct: n_words, hits (word ranges), items (sorted), spans (character ranges of the original text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    words = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0  # a bound of the number of windows
    parts = max(1, -(-words // part_windows))
    name, out = base.fresh(docs, name), docs
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else items
        sent = docs.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "windows": windows([tuple(r) for r in rows.toLocalIterator()], size)})
        add = lambda sent=sent: lambda texts: [(_scan(_scanner(sent), x),) for x in texts]
        if part == 0:
            out = base.add_text_columns(out, text, T.StructType([T.StructField(name, _STATE)]), add)
        else:  # the part before is over and written, so only one automaton is held at a time
            own = base.fresh(out, "_found")
            out = base.add_text_columns(out, text, T.StructType([T.StructField(own, _STATE)]), add).withColumn(name, _both(F.col(name), F.col(own))).drop(own)
        if parts > 1:
            out = base.written(out, "decontamination")
            sent.unpersist()
    return out


def _both(x: Column, y: Column) -> Column:
    """The two findings of one text as one."""

    def union(key: str) -> Column:  # ranges in order, merged where they meet
        every = F.array_sort(F.concat(x[key], y[key]))
        none = F.array().cast("array<array<bigint>>")
        last = lambda done: F.element_at(done, -1)
        joined = lambda done, r: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last(done)[0], F.greatest(last(done)[1], r[1]))))
        return F.aggregate(every, none, lambda done, r: F.when((F.size(done) > 0) & (r[0] <= F.try_element_at(done, F.lit(-1))[1]), joined(done, r)).otherwise(F.concat(done, F.array(r))))

    return F.struct(x["n_words"].alias("n_words"), union("hits").alias("hits"), F.array_sort(F.array_union(x["items"], y["items"])).alias("items"), union("spans").alias("spans"))


def _scan(scanner: Scanner, text: str | None) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
    words = raw.split()
    hits, items = scanner.scan(words)
    spans = []
    if hits:
        at = [m.span() for m in _RUN.finditer(raw)]
        place = (lambda k: k) if len(raw) == len(text) else (lambda k: len(raw[:k].decode("utf-8", "surrogatepass")))  # characters before a byte
        spans = [[place(at[a][0]), place(at[b - 1][1])] for a, b in hits]
    return {"n_words": len(words), "hits": hits, "items": sorted(items), "spans": spans}


def report(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, part_windows: int = 2_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    got = occurrences(docs.select("doc_id", "text"), benchmark, size, part_windows)
    return got.select("doc_id", "found.n_words", _n_hit("found").alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), "found.spans").select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans"
    )


def _n_hit(found: str):
    return F.aggregate(f"{found}.hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, part_windows: int = 2_000_000) -> DataFrame:
    """docs without contaminated rows; all columns kept."""
    name = base.fresh(docs, "_found")
    got = occurrences(docs, benchmark, size, part_windows, name=name)
    n = _n_hit(name)
    return got.filter(~((n > 0) & (share * n >= F.col(f"{name}.n_words")))).select(*docs.columns)


def brute_force(text: str | None, items: list[tuple[str, str]], size: int = 13) -> tuple[int, int, str]:
    """(n_words, n_hit, items_sha256) by comparing every window at every place; for tests."""
    words = WORD.findall(normalised(text))
    hit, ids = set(), set()
    for window, who in windows(items, size).items():
        for k in range(len(words) - len(window) + 1):
            if tuple(words[k : k + len(window)]) == window:
                hit.update(range(k, k + len(window)))
                ids |= who
    return len(words), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
