"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words of all documents are counted in Spark; the most frequent ones, with their ids,
become an acyclic automaton with shared suffixes whose arcs carry additive outputs: their
sum along a word is the word's number, which selects its run of ids. The automaton is a few
flat arrays in one byte string, a file that Spark ships to each executor, where the workers memory-map it. Words outside it are
merged exactly, by rank. A bounded memo spares both for words that a worker has just seen.

Defined cases: a null text is empty; an empty text has no ids and decodes to nothing;
special tokens' strings in a text become their ids, as the tokenizers library does, and
decoding keeps them; without a decoder in the vocabulary file, decoding joins the tokens by
one space. Repeated rows are each encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import base

#: Chunks of one task's memo; when it is full it becomes the older one, of which what is met again is taken over.
MEMO_CHUNKS = 250_000
#: Words of more bytes than this are merged by a heap.
LONG_WORD = 48
_LETTERS, _NUMBERS, _SPACES = "a-zªµºßà-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"  # of lower-cased text up to U+024F
_LATIN_WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_SPACE = regex.compile(r"\p{White_Space}+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")  # split() takes these for white space, the vocabulary's rules don't
_BEYOND_LATIN = re.compile("[^\\x00-ɏ]")
#: The rank of pairs that never merge.
NEVER = 1 << 40


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Ragged:
    """Rows of numbers, end to end."""

    values: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]]) -> Ragged:
        return cls(np.array([x for row in rows for x in row], np.int64), np.array([len(row) for row in rows], np.int64))

    def rows(self) -> list[list[int]]:
        return [x.tolist() for x in np.split(self.values, np.cumsum(self.sizes)[:-1])] if len(self.sizes) else []

    def take(self, k: np.ndarray) -> Ragged:
        sizes = self.sizes[k]
        begins = (np.cumsum(self.sizes) - self.sizes)[k]
        return Ragged(self.values[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes)


class Vocabulary:
    """A word-end BPE vocabulary: token numbers, merge ranks and special tokens."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        self.number: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.number[x] << 32 | self.number[y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = np.append(keys[order], -1), np.append(order, NEVER)
        self.joined = np.append(np.array([self.number[x + y] for x, y in pairs], np.int64)[order], -1)
        letters = byte_letters()
        self.inner, self.last = (np.array([self.number.get(x + end, -1) for x in letters], np.int64) for end in ("", self.end))
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t for t, i in (self.number | self.special).items()}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of pairs in the merge table; its last entry for pairs that never merge."""
        key = left << 32 | right
        k = np.searchsorted(self.pairs[:-1], key)
        return np.where(self.pairs[k] == key, k, len(self.pairs) - 1)

    def merge_all(self, words: list[str]) -> Ragged:
        """The ids of each word: its best-ranked pair is joined, the leftmost first, until no pair has a rank. Words of like length take their n-th join together."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        short = order[: np.searchsorted(size[order], LONG_WORD, "right")]
        out = [Ragged.of([])]
        for start in range(0, len(short), 4096):
            own = short[start : start + 4096]
            width = int(size[own[-1]])
            letters = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in own), np.uint8).reshape(-1, width)
            ends = size[own, None] - 1
            place = np.arange(width)
            out.append(self._joined(np.where(place < ends, self.inner[letters], np.where(place == ends, self.last[letters], -1))))
        out.append(Ragged.of([self._merged(raw[k]) for k in order[len(short) :].tolist()]))
        return Ragged(np.concatenate([x.values for x in out]), np.concatenate([x.sizes for x in out])).take(np.argsort(order, kind="stable"))

    def _joined(self, ids: np.ndarray) -> Ragged:
        """ids: a word a row, -1 after its end."""
        rows, left = np.arange(len(ids)), ids.shape[1]
        rank = self.ranks[np.where(ids[:, 1:] < 0, len(self.pairs) - 1, self.looked_up(ids[:, :-1], ids[:, 1:]))] if left > 1 else np.zeros((len(ids), 0), np.int64)
        rank = np.concatenate((rank, np.full((len(ids), 1), NEVER)), 1)
        done = ids.copy()
        going, now = rows, ids
        while len(going):
            at = rank.argmin(1)
            more = rank[np.arange(len(at)), at] < NEVER
            done[going[~more]] = now[~more]
            going, now, rank, at = going[more], now[more], rank[more], at[more]
            if not len(going):
                break
            each, place = np.arange(len(at)), np.arange(left)
            new = self.joined[self.looked_up(now[each, at], now[each, at + 1])]
            take = np.minimum(place + (place > at[:, None]), left - 1)
            now, rank = np.take_along_axis(now, take, 1), np.take_along_axis(rank, np.minimum(place + (place >= at[:, None]), left - 1), 1)
            now[:, -1], rank[:, -1] = -1, NEVER
            now[each, at] = new
            for k, ok in ((at, now[each, np.minimum(at + 1, left - 1)] >= 0), (at - 1, at > 0)):
                rank[each[ok], k[ok]] = self.ranks[self.looked_up(now[each[ok], k[ok]], now[each[ok], k[ok] + 1])]
            rank[each, at] = np.where(now[each, np.minimum(at + 1, left - 1)] >= 0, rank[each, at], NEVER)
        return Ragged(done[done >= 0], (done >= 0).sum(1))

    def _merged(self, word: bytes) -> list[int]:
        """The same for one long word: a heap of pairs over a linked list of its parts."""
        letters = np.frombuffer(word, np.uint8)
        ids = [*self.inner[letters[:-1]].tolist(), int(self.last[letters[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        found = self.looked_up(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        table = {(a, b): (int(self.ranks[k]), int(self.joined[k])) for a, b, k in zip(ids, ids[1:], found.tolist(), strict=False) if k < len(self.pairs) - 1}

        def pair(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in table:
                k = int(self.looked_up(np.array([a]), np.array([b]))[0])
                table[a, b] = int(self.ranks[k]), int(self.joined[k])
            return table[a, b]

        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := pair(ids[k], ids[k + 1])[0]) < NEVER]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            to = after[k]
            if ids[k] != a or to < 0 or ids[to] != b:
                continue  # one of the two has been joined since
            ids[k], ids[to], after[k] = pair(a, b)[1], -1, after[to]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := pair(ids[x], ids[y])[0]) < NEVER:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


def chunks(text: str, library: Tokenizer) -> list[str]:
    """Normalised text cut at white space; no word crosses such a cut.

    Beyond the Latin letters the library normalises, so that its own Unicode tables count.
    """
    text = library.normalizer.normalize_str(text) if _BEYOND_LATIN.search(text) else text.lower()
    return text.split() if not _ODD_SPACE.search(text) else [x for x in _SPACE.split(text) if x]


def words(chunk: str, library: Tokenizer) -> list[str]:
    """The words of a chunk, which has no white space."""
    if _BEYOND_LATIN.search(chunk):
        return [chunk[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(chunk)]
    return _LATIN_WORD.findall(chunk)


@lru_cache(maxsize=2)
def library_of(vocabulary: str) -> Tokenizer:
    """The library's tokenizer, of which only the normaliser and the word splitter are used."""
    return Tokenizer.from_str(vocabulary)


def count_words(docs: DataFrame, vocabulary: str, text: str = "text", flush: int = 200_000) -> DataFrame:
    """(word, n) over the whole texts of all documents; each task pre-aggregates."""

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        seen: Counter[str] = Counter()
        library = library_of(sent.value)

        def out():
            total: Counter[str] = Counter()
            for chunk, n in seen.items():
                for word in words(chunk, library):
                    total[word] += n
            seen.clear()
            names, counts = list(total), list(total.values())
            for k in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 50_000], pa.string()), pa.array(counts[k : k + 50_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    seen.update(chunks(x, library))
                if len(seen) > flush:
                    yield from out()
        yield from out()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """A minimal acyclic automaton over bytes with word numbers as outputs, in flat arrays.

    Arcs are ordered by key: source node times 256 plus the byte. An arc has a target and
    the number of words that come before those below it; final[node] says whether a word
    ends there; first holds the root.
    """

    FIELDS = (("first", "<u4"), ("keys", "<i8"), ("target", "<u4"), ("output", "<u4"), ("run", "<u4"), ("ids", "<u4"), ("final", "u1"))

    def __init__(self, raw):
        head = np.frombuffer(raw, "<u4", len(self.FIELDS))
        at = 4 * len(head)
        for (name, kind), n in zip(self.FIELDS, head, strict=True):
            setattr(self, name, np.frombuffer(raw, kind, int(n), at))
            at += int(n) * np.dtype(kind).itemsize

    @classmethod
    def compiled(cls, entries: dict[str, list[int]]) -> bytes:
        """Words are added in byte order; once the next word leaves a branch, it is merged with an equal one that is stored already."""
        ordered = sorted((w.encode(), ids) for w, ids in entries.items())
        stored: dict[tuple, int] = {}
        nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def fixed(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, tuple(arcs))
            if key not in stored:
                stored[key] = len(nodes)
                nodes.append(key)
            return stored[key]

        open_: list[list] = [[False, []]]  # the branch of the last word: [final, arcs to fixed nodes]
        last = b""
        for word, _ in [*ordered, (b"", None)]:
            common = len(os.path.commonprefix([word, last]))
            while len(open_) > common + 1:
                final, arcs = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], fixed(final, arcs)))
            open_ += [[False, []] for _ in word[common:]]
            if word:
                open_[-1][0] = True
            last = word
        root = fixed(*open_[0])
        below: list[int] = []
        for final, arcs in nodes:  # targets come before their sources
            below.append(final + sum(below[t] for _, t in arcs))
        keys, target, output = [], [], []
        for node, (final, arcs) in enumerate(nodes):
            passed = int(final)
            for byte, t in arcs:
                keys.append(node << 8 | byte)
                target.append(t)
                output.append(passed)
                passed += below[t]
        run = np.cumsum([0, *(len(ids) for _, ids in ordered)])
        data = dict(first=[root], keys=keys or [-1], final=[f for f, _ in nodes], target=target or [0], output=output or [0], run=run, ids=[i for _, ids in ordered for i in ids])
        out = bytearray(np.array([len(data[n]) for n, _ in cls.FIELDS], "<u4").tobytes())
        for name, kind in cls.FIELDS:
            out += np.asarray(data[name], kind).tobytes()
        return bytes(out)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """One file per executor, shared by the workers that map it."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, asked: list[str]) -> np.ndarray:
        """The number of each word of the lexicon, -1 for others. All words take their n-th step together."""
        raw = [w.encode() for w in asked]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-size, kind="stable")
        flat, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        node, number = np.full(len(raw), self.first[0], np.int64), np.zeros(len(raw), np.int64)
        going = order  # words that still follow arcs, the longest first
        for step in range(int(size.max(initial=0))):
            going = going[: np.searchsorted(-size[going], -step, "left")]
            if not len(going):
                break
            key = node[going] << 8 | flat[starts[going] + step]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[k] == key
            node[going[~met]] = -1
            going, k = going[met], k[met]
            number[going] += self.output[k]
            node[going] = self.target[k]
        return np.where((node >= 0) & (self.final[node] == 1), number, -1)

    def ids_of(self, numbers: np.ndarray) -> Ragged:
        return Ragged(self.ids, np.diff(self.run.astype(np.int64))).take(numbers)


class Codec:
    """Encodes and decodes whole texts; one per task, so that its memos end with the task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, library: Tokenizer):
        self.vocabulary, self.lexicon, self.library = vocabulary, lexicon, library
        # of a chunk: its ids and its tokens, each joined by spaces, and their number; a special token's key starts with a space
        self.memo: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}
        self.digits = pa.array([str(k) for k in range(max(vocabulary.token) + 1)])
        self.token = pa.array([vocabulary.token.get(k, "") for k in range(max(vocabulary.token) + 1)])

    def ids(self, asked: list[str]) -> Ragged:
        """The ids of words: by the automaton, or else by merging."""
        number = self.lexicon.numbers(asked)
        unseen = np.flatnonzero(number < 0)
        known, merged = self.lexicon.ids_of(number[number >= 0]), self.vocabulary.merge_all([asked[k] for k in unseen.tolist()])
        order = np.concatenate((np.flatnonzero(number >= 0), unseen))
        return Ragged(np.concatenate((known.values, merged.values)), np.concatenate((known.sizes, merged.sizes))).take(np.argsort(order, kind="stable"))

    def learn(self, asked: list[str]) -> None:
        """Put chunks that it lacks into the memo."""
        older = {c: x for c in asked if (x := self.older.get(c))}
        self.memo |= older
        for start in range(0, len(new := [c for c in asked if c not in older]), 50_000):
            own = new[start : start + 50_000]
            parts = [[c] if c[0] == " " else words(c, self.library) for c in own]
            every = set().union(*parts)
            special = [w for w in every if w[0] == " "]
            plain = list(every.difference(special))
            ids = self.ids(plain)
            ids = Ragged(np.concatenate((ids.values, [self.vocabulary.special[w[1:]] for w in special])).astype(np.int64), np.concatenate((ids.sizes, np.ones(len(special), np.int64))))
            place = {w: k for k, w in enumerate([*plain, *special])}
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            of = Ragged(np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64, lengths.sum()), lengths)
            spread = ids.take(of.values)
            ends = np.cumsum(spread.sizes)
            sizes = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(of.sizes)))])
            self.memo.update(zip(own, zip(strings_of(joined(self.digits, spread.values, sizes)), strings_of(joined(self.token, spread.values, sizes)), sizes.tolist(), strict=True), strict=True))

    def encoded(self, texts: list[str | None]) -> list[pa.Array]:
        """Of each whole text: number of ids, ids joined by a space, decoded text; as columns."""
        special, flat, sizes = self.vocabulary.special_at, [], []
        for text in texts:
            before, at, text = len(flat), 0, text or ""
            for m in special.finditer(text) if special else ():
                flat += [*chunks(text[at : m.start()], self.library), " " + m[0]]
                at = m.end()
            flat += chunks(text[at:] if at else text, self.library)
            sizes.append(len(flat) - before)
        coded = pa.array(flat, pa.string()).dictionary_encode()
        each, index = strings_of(coded.dictionary), coded.indices.to_numpy()
        if len(self.memo) + len(each) > MEMO_CHUNKS:
            self.memo, self.older = {}, self.memo
        self.learn([c for c in each if c not in self.memo])
        memo = self.memo
        found = [memo[c] for c in each]
        ids, tokens = (pa.array([x[k] for x in found], pa.string()) for k in (0, 1))
        n = np.concatenate(([0], np.cumsum(np.array([x[2] for x in found], np.int64)[index])))
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return [pa.array(np.diff(n[ends])), joined(ids, index, np.array(sizes)), joined(tokens, index, np.array(sizes))]


def strings_of(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def joined(strings: pa.Array, index: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings of each row, joined by a space."""
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings.take(pa.array(index))), " ")


_parts: dict[str, tuple[Vocabulary, Lexicon, Tokenizer]] = {}


def _codec(sent) -> Codec:
    """A codec over the worker's one copy of the vocabulary and the mapped automaton."""
    key, text = sent.value
    if key not in _parts:
        _parts.clear()
        _parts[key] = Vocabulary(text), Lexicon.mapped(SparkFiles.get(key)), library_of(text)
    return Codec(*_parts[key])


def frequent_words(docs: DataFrame, vocabulary: str, most: int, least: int = 3) -> list[str]:
    """At most `most` words, the most frequent of all of docs, each met `least` times or more.

    The cut is a count, found from the number of words with each count, so no more than
    that histogram and the chosen words reach the driver; words that tie at the cut and
    don't all fit are left out together.
    """
    counts = base.written(count_words(docs, vocabulary).filter(F.col("n") >= least), "words")
    below = Window.orderBy(F.desc("n"))
    level = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("total", F.sum("words").over(below)).filter(F.col("total") <= most).agg(F.min("n").alias("n")).first()["n"]
    chosen = [r["word"] for r in counts.filter(F.col("n") >= level).select("word").collect()] if level is not None else []
    base.forget(counts)
    return chosen


#: Files already shipped, by application; Spark takes a name once. Each lies in a folder that goes when the driver ends.
_shipped: dict[tuple[str, str], tempfile.TemporaryDirectory] = {}


def prepared(docs: DataFrame, vocabulary_path: str, lexicon_words: int = 200_000):
    """A broadcast of the vocabulary and the name of the file with the automaton of the most frequent words."""
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    vocabulary = Vocabulary(text)
    frequent = frequent_words(docs, text, lexicon_words)
    raw = Lexicon.compiled(dict(zip(frequent, vocabulary.merge_all(frequent).rows(), strict=True)))
    sc = docs.sparkSession.sparkContext
    name = f"lexicon-{hashlib.sha256(raw).hexdigest()[:24]}"
    if (sc.applicationId, name) not in _shipped:
        folder = _shipped[sc.applicationId, name] = tempfile.TemporaryDirectory(prefix="spark-")
        with open(os.path.join(folder.name, name), "wb") as f:
            f.write(raw)
        sc.addFile(f.name)  # Spark sends it to each executor's own folder once
    return sc.broadcast((name, text))


def encode(docs: DataFrame, vocabulary_path: str, lexicon_words: int = 200_000) -> DataFrame:
    """docs (any columns, one named text) with n_tokens, ids (joined by a space) and decoded."""
    sent = prepared(docs, vocabulary_path, lexicon_words)
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])
    return base.add_text_columns(docs, "text", fields, lambda: _codec(sent).encoded)


def digests(docs: DataFrame, vocabulary_path: str, lexicon_words: int = 200_000) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    got = encode(docs.select("doc_id", "text"), vocabulary_path, lexicon_words)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
