"""Language identification by multilingual mixture inference.

Each language has a multinomial over hashed byte 4-grams, learned from labelled documents. A document is a mixture of
languages: every word comes from one of them. Expectation-maximisation estimates the proportions; nested language sets
(the likeliest, the two likeliest, ...) are compared by likelihood less a penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .cluster import fold, unused

BUCKETS = 1 << 17
#: Documents of each language to learn from, in expectation; they are picked by a hash of their id.
FIT_PER_LANGUAGE = 2000
#: Log-likelihood that a further language must bring, for each logarithm of the number of words.
PENALTY = 3.0
ROUNDS = 10
LARGEST_SET = 4
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 4-byte windows of each lower-case word, first window of each word, row of each word.

    Words are runs of letters and non-ASCII bytes; a window starts one byte before its word, so a blank marks both ends."""
    data, bounds = tx.buffer_of(pc.utf8_lower(col))
    rows = len(bounds) - 1
    # a blank after every row keeps windows inside it
    spaced = np.full(len(data) + rows + 3, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(bounds)) + 1
    spaced[at] = _BLANK[data]
    x = spaced.astype(np.uint32)
    key = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int64)
    inside = spaced[1:-2] != 32
    first = inside & (spaced[:-3] == 32)
    pos = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    word_at = np.searchsorted(pos, starts)
    row = np.searchsorted(bounds[:-1] + np.arange(rows), starts, side="right") - 1
    return bucket[pos], word_at, row


def learn(documents: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, one row of BUCKETS for each, from (doc_id, text, lang).

    Rows of null language or text and of held-out ids are not read for it."""
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold("doc_id") != 1)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / counts[k]))])
    picked = rows.where((F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")])
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(number) * BUCKETS, np.int64)
        for part in tx.slices(batches, "text"):
            bucket, at, row = grams(part.column(0))
            lang = np.array([number[k] for k in part.column(1).to_pylist()], np.int64)
            of = np.repeat(row, np.diff(np.append(at, len(bucket))))
            sums += np.bincount(lang[of] * BUCKETS + bucket, minlength=len(sums))
        k = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums[k])], ["k", "n"])

    table = picked.select("text", "lang").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # languages * BUCKETS rows at most
    n = np.zeros(len(langs) * BUCKETS)
    n[table["k"].to_numpy()] = table["n"].to_numpy()
    n = n.reshape(len(langs), BUCKETS)
    # a word's windows overlap, so each counts as half of what it would tell alone
    return langs, (np.log((n + 0.05) / (n.sum(1, keepdims=True) + 0.05 * BUCKETS)) / 2).astype(np.float32)


def _mixture(like: np.ndarray, first: np.ndarray, row: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, with the allowed languages of each; like: words x languages."""
    count = np.diff(np.append(first, len(row)))[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        post = like * share[row]
        total = post.sum(1, keepdims=True)
        post /= np.maximum(total, 1e-300)
        share = np.add.reduceat(post, first, axis=0) / count
    total = np.log(np.maximum((like * share[row]).sum(1), 1e-300))
    return share, np.add.reduceat(total, first)


def infer(col: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: its proportions of the languages, of the set chosen by penalised likelihood; rows of zeros
    where it has no word."""
    bucket, at, row = grams(col)
    out = np.zeros((len(col), len(table)))
    if not len(at):
        return out, np.zeros(len(col), np.int64)
    like = np.stack([np.add.reduceat(t[bucket], at) for t in table], axis=1).astype(np.float64)
    like = np.exp(np.maximum(like - like.max(1, keepdims=True), -50.0))
    docs, first, of = np.unique(row, return_index=True, return_inverse=True)
    words = np.diff(np.append(first, len(row)))
    everything = np.ones((len(docs), len(table)))
    share, _ = _mixture(like, first, of, everything, ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen, size = np.full(len(docs), -np.inf), np.zeros_like(share), np.zeros(len(docs), np.int64)
    for k in range(1, min(LARGEST_SET, len(table)) + 1):
        allowed = np.zeros_like(share)
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        got, total = _mixture(like, first, of, allowed * np.maximum(share, 1e-6), 3 if k > 1 else 0)
        value = total - PENALTY * (k - 1) * np.log(words + 1)
        better = value > best
        best[better], chosen[better], size[better] = value[better], got[better], k
    out[docs] = chosen
    sizes = np.zeros(len(col), np.int64)
    sizes[docs] = size
    return out, sizes


def identify(documents: DataFrame, per_language: int = FIT_PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row; languages maps those chosen to their shares.

    lang_pred is the chosen language with the largest share, score that share. Null text, text without a letter, and
    every text if no language can be learned: ``und``, 0, no languages. Null ids are never learned from and not held
    out. Ties go to the language that sorts first. Texts are used whole; repeated rows are rows like others."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    langs, table = learn(rows, per_language)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            share, size = infer(part.column(2), table) if langs else (np.zeros((part.num_rows, 1)), None)
            known = np.asarray(part.column(3)) & (share.sum(1) > 0)
            top = share.argmax(1)
            names = [langs[k] if ok else "und" for k, ok in zip(top, known, strict=True)]
            score = np.where(known, share[np.arange(len(share)), top], 0.0)
            maps = [[(langs[k], float(s[k])) for k in np.flatnonzero(s)] if ok else [] for s, ok in zip(share, known, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array(np.minimum(score, 1.0)), pa.array(maps, pa.map_(pa.string(), pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    kind = documents.schema[doc_id].dataType.simpleString()
    seen = rows.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return seen.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages map<string,double>")


def keep_identified(documents: DataFrame, least: float = 0.4, per_language: int = FIT_PER_LANGUAGE) -> DataFrame:
    """The rows of documents, with all their columns, whose language is known with a share of at least ``least``.

    Null texts and texts without a letter go. Rows are judged apart, so repeated rows stay or go together."""
    langs, table = learn(documents.select("doc_id", "text", "lang"), per_language)
    place = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            known = np.asarray(part.column(part.num_columns - 1))
            best = infer(part.column(place), table)[0].max(1) if langs else np.zeros(part.num_rows)
            yield part.select(range(part.num_columns - 1)).filter(pa.array(known & (best >= least)))

    flagged = documents.withColumn(unused(documents, "letters"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return flagged.mapInArrow(keep, documents.schema)
