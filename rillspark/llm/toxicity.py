"""Toxicity by noisy-channel deobfuscation.

Obfuscated spans (look-alike digits and signs, letters with separators or blanks between them, repeated letters, and
mixtures of these) become lattices of characters. A Viterbi search under a character trigram model, learned from training texts,
finds the likeliest plain reading. Spans without an alternative reading restore to themselves and skip the search. The
restored text is scored by the evidence of its distinct words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .cluster import discard, fold, release, stored
from .jaccard import _bitmap, _inside

#: Restored spans that a task remembers, and words that it counts before it hands them on.
REMEMBERED = 1 << 16
#: Steps of the evidence within one unit; it lies between -LIMIT and LIMIT, so there are boundedly many values.
GRID, LIMIT = 1 << 10, 30.0

# fixed values: look-alikes and the letters they stand for
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SWAP, DROP_REPEAT, DROP_BLANK, KEEP_SIGN, MASK = -1.5, -0.5, -1.0, -9.0, -3.0

# by code point of the first plane
_SIGN = np.zeros(1 << 16, bool)
_SIGN[[ord(c) for c in LOOKALIKES]] = True
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def plain_words(col: pa.Array) -> tx.Words:
    """Runs of letters and non-ASCII bytes of lower-case values."""
    data, bounds = tx.buffer_of(col)
    return tx.words(pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_PLAIN[data])))


def _letters(c: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    out = _LETTER[np.minimum(c, 0xFFFF)]
    high = np.flatnonzero(c > 0xFFFF)
    out[high] = [chr(x).isalpha() for x in c[high].tolist()]
    return out


def suspects(w: tx.Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Words that read() can read in more than one way, and runs (first, last) of words to be read as one.

    A word has another reading if it holds a look-alike, a letter twice in a row, or anything else between two letters. A
    run is two or more words, any blanks between them, in which no two different letters or look-alikes touch."""
    if not len(w.start):
        return np.zeros(0, np.int64), []
    c = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    start, end = at[w.start], at[w.end]
    sign = _SIGN[np.minimum(c, 0xFFFF)]
    ink = sign | _letters(c)
    opens = np.zeros(len(c), bool)
    opens[start] = True
    touch, twice = np.zeros(len(c), bool), np.zeros(len(c), bool)
    touch[1:] = ink[1:] & ink[:-1] & ~opens[1:]
    twice[1:] = touch[1:] & (c[1:] == c[:-1])

    def count(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit)])
        return sums[end] - sums[start]

    pieces, apart = count(ink & ~touch), count(touch & ~twice) == 0
    strange = (count(sign | twice) > 0) | (pieces > 1)
    joined = np.zeros(len(apart), bool)
    joined[1:] = apart[1:] & apart[:-1] & (w.row[1:] == w.row[:-1])
    heads = np.flatnonzero(~joined)
    size = np.diff(np.append(heads, len(joined)))
    run = (size > 1) & (np.add.reduceat(pieces, heads) > 1)
    return np.flatnonzero(strange), [(int(h), int(h + s - 1)) for h, s in zip(heads[run], size[run], strict=True)]


class Reader:
    """Character trigram model with Viterbi decoding of obfuscated spans."""

    def __init__(self, trigrams: dict[str, int]):
        pairs: Counter = Counter()
        singles: Counter = Counter()
        for g, n in trigrams.items():
            pairs[g[:2]] += n
            singles[g[2]] += n
        self.total = max(1, sum(singles.values()))
        self.tri = {g: log(n / pairs[g[:2]] * 0.8) for g, n in trigrams.items()}
        second: Counter = Counter()
        for g, n in trigrams.items():
            second[g[1:]] += n
        self.two = {g: log(n / max(1, singles[g[0]]) * 0.15 + 1e-6) for g, n in second.items()}
        self.one = {c: log(n / self.total * 0.05 + 1e-7) for c, n in singles.items()}

    def step(self, before: str, c: str) -> float:
        g = before + c
        return self.tri.get(g) or self.two.get(g[1:]) or self.one.get(c, KEEP_SIGN * 1.5)

    def read(self, span: str) -> str:
        """The likeliest plain reading of a lower-case span."""
        paths: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}  # score, and the reading as (the one before, last)
        last = ""
        for k, c in enumerate(span):
            options: list[tuple[str, float]] = []
            if c in LOOKALIKES:
                options = [(x, SWAP) for x in LOOKALIKES[c]] + [("", KEEP_SIGN), (c, KEEP_SIGN)]
            elif c.isalpha():
                options = [(c, 0.0)]
            else:
                options = [(" ", 0.0), ("", DROP_BLANK)]
                if c == "*" and last.isalpha() and span[k + 1 : k + 2].isalpha():  # it may hide any letter
                    options += [(x, MASK) for x in ascii_lowercase]
            if c == last and (c in LOOKALIKES or c.isalpha()):
                options.append(("", DROP_REPEAT))
            last = c
            new: dict[str, tuple[float, tuple]] = {}
            for state, (score, out) in paths.items():
                for x, cost in options:
                    if x == " " and state[1] == " ":
                        x = ""
                    to = (state + x)[-2:]
                    got = score + cost + (self.step(state, x) if x else 0.0)
                    if to not in new or got > new[to][0]:
                        new[to] = (got, (out, x) if x else out)
            paths = new
        out = max(((s + self.step(state, " "), out) for state, (s, out) in paths.items()), key=lambda p: p[0])[1]
        text = []
        while out:
            out, x = out
            text.append(x)
        return "".join(reversed(text))


def _features(part: pa.Array, reader: Reader | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word hash) of the restored texts."""
    low = pc.utf8_lower(pc.fill_null(part, ""))
    plain = plain_words(low)
    rows, keys = [plain.row], [plain.hash]
    if reader is not None:
        w = tx.words(low)
        odd, runs = suspects(w)
        # equal words of one row are read once
        odd = odd[np.unique(tx.chain(w.row[odd].astype(np.uint64), w.hash[odd]), return_index=True)[1]]
        spans = [(int(w.row[k]), int(w.start[k]), int(w.end[k])) for k in odd] + [(int(w.row[a]), int(w.start[a]), int(w.end[b])) for a, b in runs]
        raws = [w.data[s:e].tobytes() for _, s, e in spans]
        if len(known) > REMEMBERED:
            known.clear()
        fresh = [raw for raw in dict.fromkeys(raws) if raw not in known]
        read = tx.words(pa.array(["".join(c if c.isalpha() else " " for c in reader.read(raw.decode("utf-8", "replace"))) for raw in fresh], pa.string()))
        at = read.first
        for k, raw in enumerate(fresh):
            known[raw] = read.hash[at[k] : at[k + 1]]
        found = [known[raw] for raw in raws]
        rows.append(np.repeat(np.array([r for r, _, _ in spans], np.int64), [len(h) for h in found]))
        keys.extend(found)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _evidence(row: np.ndarray, keys: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Of each of n rows, the sum of the weights of its words, in steps of 1 / GRID."""
    s = np.bincount(row, weights=tx.lookup(key, weight, keys, 0.0), minlength=n)
    return np.round(np.clip(s, -LIMIT, LIMIT) * GRID) / GRID


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labelled ids that are not held out; of labels that repeat an id the highest."""
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id") != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _labelled(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, toxic) of all documents that marks names. A bitmap of fixed size keeps most others out of the join."""
    bits = _bitmap(marks.select(F.xxhash64("doc_id").alias("h")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_inside(bits, np.asarray(b.column(0))))).select([1, 2])

    kind = documents.schema["doc_id"].dataType.simpleString()
    d = documents.where(fold("doc_id") != 1).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text").mapInArrow(likely, f"doc_id {kind}, text string")
    return d.join(marks, "doc_id").select("text", "toxic")


def learn(documents: DataFrame, marks: DataFrame):
    """The reader, word evidence (sorted hashes, weights), and the numbers of toxic and of other documents, from all
    documents that marks names."""
    sample = stored(_labelled(documents, marks))
    release(documents.sparkSession)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        times: dict[int, int] = {}  # by the word's hash
        spelled: dict[int, str] = {}

        def spell() -> None:
            for h, word in spelled.items():
                s = "  " + word + " "
                for i in range(len(s) - 2):
                    sums[s[i : i + 3]] += times[h]
            times.clear()
            spelled.clear()

        for part in tx.slices(batches, "text"):
            w = plain_words(pc.utf8_lower(pc.fill_null(part.column(0), "")))
            u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            for h, k, m in zip(u.tolist(), first.tolist(), n.tolist(), strict=True):
                if h in times:
                    times[h] += m
                else:
                    times[h], spelled[h] = m, w.string(k)
            if len(times) > REMEMBERED:
                spell()
        spell()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["g", "n"])

    got = sample.select("text").mapInArrow(trigrams, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").toArrow()  # a row for each trigram of letters
    reader = Reader(dict(zip(got["g"].to_pylist(), got["n"].to_pylist(), strict=True)))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        held = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))]

        def summed() -> tuple:
            u, inv = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return u, *(np.bincount(inv, weights=np.concatenate([x[k] for x in held]), minlength=len(u)) for k in (1, 2))

        def handed(u: np.ndarray, n: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(a.astype(np.int64))], ["key", "n", "a"])

        for part in tx.slices(batches, "text"):
            row, key = _features(part.column(0), reader, known)
            held.append((key, np.ones(len(key)), (np.asarray(part.column(1))[row] == 1).astype(np.float64)))
            if len(held) > 8:
                held = [summed()]
                if len(held[0][0]) > REMEMBERED:
                    yield handed(*held.pop())
        if held:
            yield handed(*summed())

    sizes = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("a")).first()
    na, nb = int(sizes["a"]), int(sizes["n"]) - int(sizes["a"])
    if not na or not nb:
        return reader, np.zeros(0, np.uint64), np.zeros(0), na, nb
    rate = na / (na + nb)
    counts = sample.mapInArrow(presence, "key bigint, n bigint, a bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    # words mostly of toxic documents, and far more often than by chance
    counts = counts.where((F.col("a") >= 4) & (F.col("a") >= (rate + 0.4 * (1 - rate)) * F.col("n")) & (F.col("a") - rate * F.col("n") > 4 * F.sqrt(F.col("n") * rate * (1 - rate))))
    t = counts.toArrow()  # words that speak for toxicity
    discard(sample)
    key, n, a = (t[c].to_numpy() for c in ("key", "n", "a"))
    weight = np.log((a + 0.5) / (na + 1)) - np.log((n - a + 1.0) / (nb + 1))
    key = key.view(np.uint64)
    by = np.argsort(key)
    return reader, key[by], weight[by], na, nb


def _calibrated(x: np.ndarray, n: np.ndarray, a: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of toxicity by evidence: a of n documents with evidence x are toxic."""
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        g = np.array([((n * p - a) * x).sum() + 0.1 * slope, (n * p - a).sum()])
        r = n * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]])
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = slope - d[0], offset - d[1]
    return max(float(slope), 0.0), float(offset)


def score(documents: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    All labelled documents that are not held out are learned from. Null and empty texts get the score of a text without
    evidence. Null ids are not held out and not learned from. Of labels that repeat an id the highest counts. Without
    labels of both kinds every score is the smoothed rate of toxic labels. Texts are used whole; repeated rows are rows
    like others."""
    docs = documents.select("doc_id", "text")
    marks = _marks(labels)
    reader, key, weight, na, nb = learn(docs, marks)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part in tx.slices(batches, "text"):
            row, k = _features(part.column(2), reader, known)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_evidence(row, k, key, weight, part.num_rows))], ["doc_id", "held_out", "s"])

    judged = docs.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "text").mapInArrow(judge, f"doc_id {kind}, held_out boolean, s double")
    slope, offset = 1.0, log((na + 0.5) / (nb + 0.5))
    if na and nb:
        judged = stored(judged)
        fitted = judged.where("NOT held_out").join(marks, "doc_id").groupBy("s").agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("a")).orderBy("s").toArrow()  # a row for each step of s
        slope, offset = _calibrated(*(fitted[c].to_numpy() for c in ("s", "n", "a")))
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("s") + F.lit(offset))))
    return judged.select("doc_id", "held_out", p.alias("score")).select("*", (F.col("score") >= cut).cast("int").alias("predicted"))
