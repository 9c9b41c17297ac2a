"""SimHash near-duplicates, linked by multi-index hashing.

A fingerprint has one bit for each bit that over half of the document's shingle hashes
set. Two fingerprints that differ in at most `bits` bits are linked. The 64 bits are cut
into segments; by the general pigeonhole rule some segment of a linked pair differs in no
more than its radius. So every distinct fingerprint is stored under each segment's value
and looks up the values of the small Hamming ball around its own; whatever it meets is
verified on all 64 bits inside the join, which therefore gives true links only, each once.

Exact copies are merged before the search, links are made between distinct fingerprints
only, and their components come from alternating large-star and small-star rounds over
written tables: nothing is gathered in one task or on the driver.

Defined cases: null, empty or wordless texts have fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle of all of them; repeated rows are each
reported; a null doc_id is reported too and never names a component (null if alone).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from . import base


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one whole text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() is A-Z, split() is \\x20 and \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    count = max(1, len(words) - shingle + 1)
    pairs = zip(starts[:count], ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, count)
    for k in range(0, count, 4096):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", shingle: int = 4, seed: int = 42) -> DataFrame:
    field = T.StructType([T.StructField(name, T.LongType())])
    return base.add_text_columns(df, text, field, lambda: lambda texts: [(fingerprint(x, shingle, seed),) for x in texts])


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segments(count: int, bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each: with bits = count * a + b, the first b + 1 have radius a and the others a - 1 (none if a is 0)."""
    a, b = divmod(bits, count)
    edges = [64 * k // count for k in range(count + 1)]
    return [(edges[k], edges[k + 1] - edges[k], a if k <= b else a - 1) for k in range(count)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` of them set."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << k for m in masks for k in range(width)}
    return sorted(masks)


def links(fps: DataFrame, bits: int = 4, count: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints in column fp that differ in at most `bits` bits, each once."""
    cut = [s for s in segments(count, bits) if s[2] >= 0]
    value = lambda x, low, width: F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))

    def around(k, low, width, radius):
        masks = F.array(*(F.lit(m).cast("long") for m in ball(width, radius)))
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("s"), value("fp", low, width).bitwiseXOR(m).alias("v")))

    store = fps.select(F.col("fp").alias("b"), F.inline(F.array(*(F.struct(F.lit(k).alias("s"), value("fp", low, w).alias("v")) for k, (low, w, _) in enumerate(cut)))))
    probes = fps.select(
        F.col("fp").alias("a"),
        F.inline(F.concat(*(around(k, *s) for k, s in enumerate(cut)))),
    )
    p, t = probes.alias("p"), store.alias("t")
    differ = F.col("p.a").bitwiseXOR(F.col("t.b"))
    # the first segment within its radius answers for the pair, so no pair is met twice
    first = reduce(lambda x, y: x & y, ((F.col("p.s") <= k) | (F.bit_count(value(differ, low, w)) > r) for k, (low, w, r) in enumerate(cut)))
    return p.join(t, (F.col("p.s") == F.col("t.s")) & (F.col("p.v") == F.col("t.v")) & (F.col("p.a") < F.col("t.b")) & (F.bit_count(differ) <= bits) & first).select("a", "b")


def grouped(prints: DataFrame, bits: int, count: int | None, key: str) -> tuple[DataFrame, DataFrame]:
    """Of a written table with columns key and fp: (fp, root, n_links, copies) of each distinct fingerprint and (root, component_id).

    count: segments; by default 3, and 2 from 2^27 distinct fingerprints on, where longer
    segments keep the lists that a look-up meets short. The links are the same either way.
    """
    reps = base.written(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("copies")), "representatives")
    count = count or (3 if reps.count() < 1 << 27 else 2)
    pairs = base.written(links(reps.select("fp"), bits, count), "links")
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    linked = roots.join(degree, "node").select(F.col("node").alias("fp"), "root", "n")
    every = reps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "copies", "least")
    every = base.written(every, "components")
    return every.drop("least"), every.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4, seed: int = 42, count: int | None = None, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, fp, component_id, n_links (distinct fingerprints linked to its own)."""
    prints = base.written(with_fingerprint(docs.select(key, "text"), shingle=shingle, seed=seed).drop("text"), "fingerprints")
    every, named = grouped(prints, bits, count, key)
    all_of = base.written(every.join(named, "root"), "named")
    return base.join_with_hot_keys(prints, all_of, "fp", "copies").select(key, "fp", "component_id", "n_links")


def keep_one(docs: DataFrame, bits: int = 4, shingle: int = 4, seed: int = 42, count: int | None = None) -> DataFrame:
    """docs with exactly one row of each component: that with the least doc_id, nulls last; of rows with one doc_id the one with the least hash over all its columns, then any of those that are equal."""
    fp, own = "fp", F.xxhash64(*docs.columns)
    narrow = docs.select("doc_id", "text", own.alias("own"))
    prints = base.written(with_fingerprint(narrow, shingle=shingle, seed=seed).drop("text"), "fingerprints")
    every, _ = grouped(prints, bits, count, "doc_id")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    # the best row of each fingerprint first, so that only one row for each is joined
    best = prints.groupBy(fp).agg(F.min(rank).alias("best")).join(every, fp).groupBy("root").agg(F.min(F.struct("best", fp)).alias("b"))
    id_, order = base.fresh(docs, "_id"), base.fresh(docs, "_order")
    h = base.fresh(docs, "_h")
    stays = base.written(best.select(F.col("b.best.doc_id").alias(id_), F.col("b.best.own").alias(h)), "stays")
    kept = docs.withColumn(h, own).join(stays, h).filter(F.col("doc_id").eqNullSafe(F.col(id_)))
    first = F.row_number().over(Window.partitionBy(h, "doc_id").orderBy(F.lit(0)))  # dealt by h already
    return kept.withColumn(order, first).filter(F.col(order) == 1).select(*docs.columns)
