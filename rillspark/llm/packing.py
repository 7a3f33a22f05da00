"""Order-preserving packing of tokenised documents into sequences.

Documents keep their order inside a partition and are laid end to end; a sequence is a window of that stream. The cuts
are chosen by dynamic programming over document and sentence ends: a cut costs the padding it leaves, and a penalty if
it falls inside a document, a larger one if it falls inside a sentence. The best earlier cut for each place is a
minimum over a sliding window, kept in a monotone queue, so the work is linear. A partition's last sequence may also be
split into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

LENGTH = 4096
END = 2
INSIDE_DOCUMENT, INSIDE_SENTENCE = 4.0, 48.0
#: Tokens planned at once; the rest of a plan, at most one sequence, goes over to the next.
PLANNED = 1 << 18
#: Units whose ids a worker remembers.
REMEMBERED = 1 << 19
_PIECES = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cuts(ends: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Stream positions at which sequences end, chosen among ends (rising), to the least total of padding and penalties.

    The last of them lies anywhere in the last window; what follows it is left to the next plan."""
    n = len(ends)
    cost, back = np.empty(n), np.empty(n, np.int64)
    queue: deque[tuple[float, int]] = deque([(0.0, -1)])  # (cost + position of the start), index; rising in both
    for j, (end, extra) in enumerate(zip(ends.tolist(), penalty.tolist(), strict=True)):
        while queue and end - (ends[queue[0][1]] if queue[0][1] >= 0 else 0) > length:
            queue.popleft()
        best, k = queue[0]
        at = best + length - end + extra
        cost[j], back[j] = at, k
        value = at + end
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    near = np.flatnonzero(ends > ends[-1] - length)
    j = int(near[np.argmin(cost[near])])
    out = []
    while j >= 0:
        out.append(int(ends[j]))
        j = back[j]
    return out[::-1]


def _places(ends: np.ndarray, doc_ends: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts and their penalties: document ends, sentence ends, and some inside sentences, so that every
    window has one at its very end and none is longer than a sequence."""
    grid = np.arange(64, total, 64)
    at = np.unique(np.concatenate([ends, doc_ends, grid, [total]]))
    cost = np.full(len(at), INSIDE_SENTENCE)
    cost[np.searchsorted(at, ends)] = INSIDE_DOCUMENT
    cost[np.searchsorted(at, doc_ends)] = 0.0
    cost[-1] = 0.0
    return at, cost


def _tail(rest: int, length: int) -> list[int]:
    """Lengths of the last sequences: one padded to length, or powers of two without padding, whichever costs less."""
    if rest == 0:
        return []
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1]
    return bits if (len(bits) - 1) * INSIDE_SENTENCE < length - rest else [rest]


class Encoder:
    """Ids of whole texts from a tokenizer that cuts at white space, lower-cases, and cuts between a letter and a
    following point or comma: each such unit is encoded once and remembered.

    Units are joined by a special token, so that one call encodes many; its id marks where each of them ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.mark, self.mark_id = next((t.content, k) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.stop = np.zeros(max(vocab.values()) + 2, bool)
        for piece, k in vocab.items():
            self.stop[k] = piece.removesuffix("</w>").endswith((".", "!", "?"))
        self.point = np.zeros(256, np.int64)
        for c in ".,":
            self.point[ord(c)] = self.tokenizer.encode(c, add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        """Known units: sorted hashes, and where their ids lie in the pool; old units, and new ones apart."""
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, joined, and the number of each."""
        ids, sizes = [], []
        for k in range(0, len(units), 2048):
            part = units[k : k + 2048]
            got = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(got == self.mark_id), len(got))
            if len(ends) != len(part):  # a unit holds the special token itself
                each = [self.tokenizer.encode(u, add_special_tokens=False).ids for u in part]
                got, size = np.fromiter((i for x in each for i in x), np.uint32), np.array([len(x) for x in each])
            else:
                size = np.diff(np.concatenate([[-1], ends])) - 1
                got = got[got != self.mark_id]
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        ids, size = self._encode(units)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.used += len(ids)
        self._merge(1, (keys, at, size))
        if len(self.levels[1][0]) > 4096 + len(self.levels[0][0]) // 4:
            self._merge(0, self.levels[1])
            self.levels[1] = tuple(x[:0] for x in self.levels[1])

    def _merge(self, level: int, more: tuple) -> None:
        joined = [np.concatenate(x) for x in zip(self.levels[level], more, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        self.levels[level] = tuple(x[order] for x in joined)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all values, joined, and the offsets of each value."""
        special = b"<|" in tx.buffer_of(col)[0].tobytes()
        w = tx.words(col, lower=not special)
        last = w.data[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
        before = w.data[np.maximum(w.end - 2, 0)] if len(w.end) else last
        cut = ((last == 46) | (last == 44)) & (w.end - w.start > 1) & ((before | 32) >= 97) & ((before | 32) <= 122)
        hashes = w.rehash(w.start, w.end - cut)
        keys, where, inv = np.unique(hashes, return_index=True, return_inverse=True)
        if sum(len(x[0]) for x in self.levels) > REMEMBERED:
            self._forget()
        at, size = self._find(keys)
        new = size < 0
        if new.any():
            stems = w.end - cut
            self._learn(keys[new], [w.data[w.start[k] : stems[k]].tobytes().decode("utf-8", "replace") for k in where[new].tolist()])
            at, size = self._find(keys)
        at, size = at[inv], size[inv]
        # the ids of each unit, and one more for a point or comma cut off
        total = size + cut
        to = np.concatenate([[0], np.cumsum(total)])
        out = np.zeros(to[-1], np.uint32)
        inside = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
        out[to[:-1][inside] + step] = self.pool[at[inside] + step]
        out[to[1:][cut] - 1] = self.point[last[cut]]
        return out, to[w.first]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        for known, start, length in self.levels:
            if len(known):
                k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[k] == keys
                at[hit], size[hit] = start[k[hit]], length[k[hit]]
        return at, size


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, as long as it works on one stage."""
    return tx.kept_for_stage(("encoder", path), lambda: Encoder(path))


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A document is its ids and the end id; null or empty text is the end id alone. Every id lies in one piece. Documents
    are packed in the order of their partition, partitions apart; sequence ids are unique, and offsets in a sequence
    run on without gaps. Null ids and repeated rows are documents like others; an empty table gives no rows. Texts are
    used whole. ``tokenizer`` is the path of a tokenizers file
    with lower case and without pieces across ASCII white space, or a letter and a point or comma."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        held: list = []  # (doc_id column, ids, offsets) not laid out yet
        skip = 0  # tokens of the first held document that are laid out

        def lay(last: bool) -> pa.RecordBatch | None:
            nonlocal held, skip, number
            ids = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.uint32)
            if not len(ids):
                return None
            base = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
            at = np.concatenate([h[2][:-1] + b for h, b in zip(held, base[:-1], strict=True)] + [[len(ids)]])
            docs = pa.chunked_array([h[0] for h in held]).combine_chunks()
            total = len(ids) - skip
            ends = np.flatnonzero(encode.stop[ids[skip:]]) + 1
            places, cost = _places(ends[ends < total], at[1:] - skip, total, length)
            if last and total <= length:
                stops = np.cumsum(_tail(total, length)).tolist()
            else:
                stops = cuts(places, cost, length)
                if last:
                    stops += (stops[-1] + np.cumsum(_tail(total - stops[-1], length))).tolist()
            stops = np.array(stops) + skip
            upto = stops[-1]
            edge = np.unique(np.concatenate([at[(at >= skip) & (at < upto)], [skip], stops]))
            begin, end = edge[:-1], edge[1:]
            doc = np.searchsorted(at, begin, side="right") - 1
            seq = np.searchsorted(stops, begin, side="right")
            starts = np.concatenate([[skip], stops])[seq]
            raw = ids.astype("<u4").tobytes()
            crc = np.fromiter((zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)), np.int64)
            cols = [docs.take(pa.array(doc)), *map(pa.array, (begin - at[doc], end - begin, crc, np.diff(at)[doc], number + seq, begin - starts))]
            number += len(stops)
            k = int(np.searchsorted(at, upto, side="right") - 1)  # the document in which the laid part ends
            held = [] if upto == len(ids) else [(docs.slice(k), ids[at[k] :], at[k:] - at[k])]
            skip = 0 if upto == len(ids) else int(upto - at[k])
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        waiting = 0
        for part in tx.slices(batches, "text", 1 << 19):
            ids, at = encode(part.column(1))
            # the end id after each document
            ids = np.insert(ids, at[1:], END).astype(np.uint32)
            held.append((part.column(0), ids, at + np.arange(len(at))))
            waiting += len(ids)
            if waiting > PLANNED:
                yield lay(False)
                waiting = sum(len(h[1]) for h in held) - skip
        if (rest := lay(True)) is not None:
            yield rest

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(packed, _PIECES.format(kind))
