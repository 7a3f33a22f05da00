"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of pieces that following it pops: what greedy
longest match would have cut off from the node's string by then. A word's number of pieces is the sum of popped counts
on its way, so no piece is ever built and no byte is read twice. Words run through the automaton side by side, each
distinct word of a slice once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

SLICE = 1 << 22


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes, in order, for code points from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xA0 and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizers file, as bytes; a leading blank marks a piece that starts a word."""
    symbols = byte_symbols()
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return [bytes(symbols[c] for c in p) for p in pieces if p and all(c in symbols for c in p)]


class Automaton:
    """Trie edges as sorted (node * 256 + byte) keys, failure links (-1: none), popped counts, and the pieces left to
    pop at a word's end (-1: the word cannot be cut)."""

    def __init__(self, pieces: list[bytes]):
        edges: dict[int, int] = {}
        parent, byte, whole = [-1], [0], [False]
        for p in sorted(set(pieces), key=lambda x: (len(x), x)):
            s = 0
            for c in p:
                t = edges.get(s << 8 | c)
                if t is None:
                    t = edges[s << 8 | c] = len(parent)
                    parent.append(s)
                    byte.append(c)
                    whole.append(False)
                s = t
            whole[s] = True
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for s in range(1, n):  # a node is made after its parent
            depth[s] = depth[parent[s]] + 1
        fail, pops, left = [-1] * n, [0] * n, [-1] * n
        left[0] = 0
        for s in np.argsort(depth, kind="stable").tolist()[1:]:
            if whole[s]:
                fail[s], pops[s] = 0, 1
            else:
                z, k = fail[parent[s]], pops[parent[s]]
                while z >= 0 and (z << 8 | byte[s]) not in edges:
                    z, k = fail[z], k + pops[z]
                if z >= 0:
                    fail[s], pops[s] = edges[z << 8 | byte[s]], k
            if fail[s] >= 0 and left[fail[s]] >= 0:
                left[s] = pops[s] + left[fail[s]]
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.fail, self.pops, self.left = (np.array(x, np.int64) for x in (fail, pops, left))
        self.root = np.full(256, -1, np.int64)
        for c in range(256):
            self.root[c] = edges.get(c, -1)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return np.where(state == 0, self.root[byte], tx.lookup(self.keys, self.next, state << 8 | byte, -1))

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: bytes = b" ") -> np.ndarray:
        """Pieces of lead + data[start:end] for each word; -1 where the vocabulary cannot cut it."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for j in range(-len(lead), int(size.max(initial=0))):
            live = np.arange(int(np.searchsorted(-size, -j, side="left")) if j >= 0 else len(size))
            live = live[state[live] >= 0]
            byte = data[start[live] + j].astype(np.int64) if j >= 0 else np.full(len(live), lead[j], np.int64)
            while len(live):
                to = self._step(state[live], byte)
                there = to >= 0
                state[live[there]] = to[there]
                live, byte = live[~there], byte[~there]
                count[live] += self.pops[state[live]]
                state[live] = self.fail[state[live]]
                go = state[live] >= 0
                live, byte = live[go], byte[go]
        left = np.where(state >= 0, self.left[state], -1)
        out = np.empty(len(size), np.int64)
        out[order] = np.where(left >= 0, count + left, -1)
        return out


def count_tokens(documents: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row.

    Words are cut greedily into the longest pieces, the first of them with the mark of a word's start; a word that
    cannot be cut is one unknown token. Null and empty texts have none. Texts are used whole; null ids and repeated
    rows are rows like others. ``vocabulary_path`` is a byte-level tokenizers file."""
    automaton = Automaton(vocabulary(vocabulary_path))
    kind = documents.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text", SLICE):
            w = tx.words(part.column(1))
            _, where, inv = np.unique(w.hash, return_index=True, return_inverse=True)
            n = automaton.counts(w.data, w.start[where], w.end[where])[inv]
            rows = part.num_rows
            sums = [np.bincount(w.row, weights=x, minlength=rows).astype(np.int64) for x in (np.where(n < 0, 1, n), n < 0)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.first)), *map(pa.array, sums)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
