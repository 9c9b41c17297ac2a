"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. A node whose string is a token fails to the
root and pops one token; any other node fails to where the rest of its string, after its
longest-match tokens, stands in the trie, and its number of popped tokens is computed
beforehand. Reading a word then takes one pass over its letters, and its greedy word-piece
length is the sum of the popped counts: no piece is ever built.

The word-piece vocabulary is taken from a public byte-level one: a token that begins with
the letter for a space begins a word, any other continues one.

Defined cases: null, empty and blank texts have no words and no tokens; repeated rows are
each counted.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import base
from .bpe import byte_letters

START = "Ġ"
#: Chunks of one task's memo; when it is full it starts again.
MEMO_CHUNKS = 300_000
_WORD = re.compile(r"\w+|[^\w\s]+")


class Automaton:
    """Nodes are numbers, the root is 0; step holds the child for node * 512 + letter."""

    def __init__(self, tokens: list[str]):
        step: dict[int, int] = {}
        depth_first: list[tuple[int, int, int]] = []  # node, parent, letter
        token = [False]
        for t in tokens:
            if any(c >= 512 for c in map(ord, t)):
                raise ValueError(f"not a byte-level token: {t!r}")
            node = 0
            for c in map(ord, t):
                key = node * 512 + c
                if key not in step:
                    step[key] = len(token)
                    depth_first.append((len(token), node, c))
                    token.append(False)
                node = step[key]
            token[node] = True
        children: dict[int, list[tuple[int, int]]] = {}
        for node, parent, c in depth_first:
            children.setdefault(parent, []).append((node, c))
        fail, pops = [-1] * len(token), [0] * len(token)
        level = [0]
        while level:  # breadth first: a link always leads to a shallower node
            for u in level:
                for v, c in children.get(u, ()):
                    if token[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and z * 512 + c not in step:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = step[z * 512 + c], n
            level = [v for u in level for v, _ in children.get(u, ())]
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: str) -> int | None:
        """The number of greedy longest-match tokens of a string; None if it has no such cover."""
        step, fail, pops = self.step, self.fail, self.pops
        node = n = 0
        for c in map(ord, word):
            while (to := step.get(node * 512 + c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return None
            node = to
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return None
        return n


def vocabulary(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    return [t for t in data["model"]["vocab"] if t not in special]


class Counter:
    """Words and tokens of whole texts; one per task, so that its memo ends with the task."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.letters = byte_letters()
        self.memo: dict[str, tuple[int, int]] = {}

    def chunk(self, chunk: str) -> tuple[int, int]:
        words = _WORD.findall(chunk)
        return len(words), sum(self.automaton.count(START + "".join([self.letters[b] for b in w.encode()])) or len(w.encode()) for w in words)

    def counted(self, texts: list[str | None]) -> list[tuple[int, int]]:
        out = []
        for text in texts:
            chunks = (text or "").split()
            if len(self.memo) > MEMO_CHUNKS:
                self.memo.clear()
            memo = self.memo
            for c in [c for c in set(chunks) if c not in memo]:
                memo[c] = self.chunk(c)
            found = list(map(memo.__getitem__, chunks))
            out.append((sum([x[0] for x in found]), sum([x[1] for x in found])))
        return out


_automata: dict[str, Automaton] = {}


def _counter(sent) -> Counter:
    """A counter over the worker's one automaton."""
    key, tokens = sent.value
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(tokens)
    return Counter(_automata[key])


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """docs with n_words and n_tokens of the whole of each text."""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary(vocabulary_path)))
    fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return base.add_text_columns(docs, "text", fields, lambda: _counter(sent).counted)
