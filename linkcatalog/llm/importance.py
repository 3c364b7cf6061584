"""Importance resampling towards a target distribution, over hashed n-grams held in word tries."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, materialize, table, utf8_parts

#: Bytes of text whose words make one trie, about; its counts then go to the task's buckets.
TRIE_BYTES = 1 << 22
#: Words in a feature, at most.
ORDER = 3
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Two more words from a place between words on.
_AHEAD = re.compile(rb"(?:[\x00-\x2f\x3a-\x60\x7b-\x7f]*[0-9a-z\x80-\xff]+){0,%d}" % (ORDER - 1))
_CRC = 0xEDB88320


@lru_cache(maxsize=4096)
def _zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of a CRC state: four tables of 256, one for each of its bytes."""
    if n > 1:
        twice = _apply(_zeros(n // 2), _zeros(n // 2))
        return _apply(_zeros(1), twice) if n % 2 else twice
    basis = [1 << i for i in range(32)]
    for _ in range(8 * n):
        basis = [(x >> 1) ^ (_CRC if x & 1 else 0) for x in basis]
    out = np.zeros((4, 256), np.uint32)
    for i, x in enumerate(basis):
        out[i // 8, (np.arange(256) >> (i % 8)) & 1 == 1] ^= np.uint32(x)
    return out


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][(state >> 8) & 255] ^ tables[2][(state >> 16) & 255] ^ tables[3][state >> 24]


def extend(state: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with the CRCs ``state``, each followed by a string of ``size`` bytes with the CRC ``tail``."""
    out = tail.copy()
    by = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[by], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(by))):
        rows = by[lo:hi]
        out[rows] ^= _apply(_zeros(int(size[rows[0]])), state[rows])
    return out


class Trie:
    """The words of some texts and all their runs of up to ORDER words, as a trie of flat arrays.

    A node of depth k stands for k consecutive words. ``count`` says how often they stand so, ``state`` is the
    CRC-32 of the words between single spaces, which each node makes from its parent's. ``paths`` has, for
    each depth, the document and the node of every run in the texts: a run's nodes are a path from the root.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, upto: int):
        """``data``: lower-cased bytes of the documents between ``offs``; only runs that start before ``upto`` count."""
        inside = _WORD[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = ends - starts
        held = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(data[inside])]
        ).dictionary_encode()
        word, words = held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary.to_pylist()
        doc = np.searchsorted(offs, starts, "right") - 1
        tail = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        tail_size = np.array([len(w) + 1 for w in words], np.int64)
        n_own = int(np.searchsorted(starts, upto))
        node = word
        self.state = [np.array([zlib.crc32(w) for w in words], np.uint32)]
        self.paths = [(doc[:n_own], word[:n_own])]
        at = np.arange(len(word))
        for k in range(1, ORDER):
            on = at[: max(0, len(word) - k)]
            on = on[doc[on] == doc[on + k]]
            key = node[on] * len(words) + word[on + k]
            which, made = pd.factorize(key)
            parent, last = made // max(1, len(words)), made % max(1, len(words))
            self.state.append(extend(self.state[-1][parent], tail[last], tail_size[last]))
            node = np.full(len(word), -1)
            node[on] = which
            own = on < n_own
            self.paths.append((doc[on[own]], which[own]))

    def counts(self, n_buckets: int) -> np.ndarray:
        """How many runs fall into each bucket."""
        out = np.zeros(n_buckets, np.int64)
        for state, (_, node) in zip(self.state, self.paths):
            count = np.bincount(node, minlength=len(state))
            out += np.bincount(state % n_buckets, count, minlength=n_buckets).astype(np.int64)
        return out

    def weigh(self, gains: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(runs, sum of their gains) of each document; the gain of a bucket is attached to the nodes that fall into it."""
        n, weight = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for state, (doc, node) in zip(self.state, self.paths):
            gain = gains[state % len(gains)]
            n += np.bincount(doc, minlength=n_docs)
            weight += np.bincount(doc, gain[node], minlength=n_docs).astype(np.int64)
        return n, weight


def text_groups(column: pa.Array, limit: int = TRIE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first document, lower-cased bytes, offsets, own bytes) of runs of texts of about ``limit`` bytes. A longer
    text comes alone, in pieces cut between words, each with the words after it that its last runs need."""
    data, offs = utf8_parts(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        part = _LOWER[data[offs[at] : offs[to]]]
        if len(part) <= limit:
            # a byte that is no word's stands between documents, so that words never touch
            own = np.insert(part, offs[at + 1 : to] - offs[at], 32)
            yield at, own, offs[at : to + 1] - offs[at] + np.append(np.arange(to - at), to - at - 1), len(own)
        else:
            lo = 0
            while lo < len(part):
                hi = lo + limit
                while hi < len(part) and (inside := _WORD[part[hi : hi + 4096]]).all():
                    hi += 4096
                hi = min(len(part), hi + int(np.argmin(inside))) if hi < len(part) else len(part)
                end = _AHEAD.match(part, hi).end()
                yield at, part[lo:end], np.array([0, end - lo]), hi - lo
                lo = hi
        at = to


def bucket_counts(texts: DataFrame, text_col: str = "text", n_buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket: tasks add up their tries' counts and return
    one row for each bucket; ``n_buckets`` sums come to the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, data, offs, upto in text_groups(batch.column(0)):
                total += Trie(data, offs, upto).counts(n_buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(n_buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains_of(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) of each of the B buckets, in doubles."""
    b, of_all, of_target = len(counts), int(counts.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (of_all + b) / ((s + 1.0) * (of_target + b))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(counts, target)], np.int64)


def noise(seed: int, own: int | None) -> int:
    """floor of -1000 ln(-ln u), u drawn by the SHA-256 of seed and id; a null id is blank."""
    h = int(hashlib.sha256(f"{seed}:{'' if own is None else own}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    n_buckets: int = 10_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per input row: (id, n_features, weight, score, rank).

    Features are the runs of one to three words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (A-Z lower-cased), hashed
    to ``n_buckets``. A bucket's gain tells how much more often ``target`` has its features than ``docs``;
    weight sums the gains of a row's features; score adds noise by the id, so that the ``percent`` of the
    rows of at least ``min_words`` words with the highest scores are a draw without replacement by
    importance. rank: 1, 2, 3... of these, ties to the smaller id (null ids last); null for the others.

    Each pass builds tries of some TRIE_BYTES of text within a task, so memory is bounded whatever a
    partition holds. Only bucket sums meet. Ranks come from score ranges, never from one task.

    Null or text without words: no features, weight 0, no rank. Null ids share one noise. Repeated rows:
    each is scored by itself and counts in the bucket totals. Empty ``docs``: no rows; empty ``target``:
    gains against none. Extra columns are ignored.
    """
    gains = gains_of(bucket_counts(docs, text_col, n_buckets), bucket_counts(target, target_col, n_buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, data, offs, upto in text_groups(batch.column(1)):
                trie, m = Trie(data, offs, upto), len(offs) - 1
                own_n, own_weight = trie.weigh(gains, m)
                n[at : at + m] += own_n
                weight[at : at + m] += own_weight
                n_words[at : at + m] += np.bincount(trie.paths[0][0], minlength=m)
            drawn = np.array([noise(seed, x.as_py()) for x in batch.column(0)], np.int64)
            rows = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, weight, weight + drawn)], pa.array(n_words >= min_words)]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "n_features", "weight", "score", "able"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = src.mapInArrow(run, "doc_id long, n_features long, weight long, score long, able boolean")
    scored = materialize(scored.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "importance")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    spread = scored.where("able").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    spread = materialize(spread, "importance-ranges")
    n_drawn = spread.count() * percent // 100
    ranked = global_rank(spread, [], "range", order, "at")
    ranked = ranked.withColumn("rank", F.when(F.col("at") < n_drawn, F.col("at") + 1))
    rest = scored.where("not able").withColumn("rank", F.lit(None).cast("long"))
    names = ["n_features", "weight", "score", "rank"]
    return ranked.select(F.col("doc_id").alias(id_col), *names).unionByName(rest.select(F.col("doc_id").alias(id_col), *names))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
