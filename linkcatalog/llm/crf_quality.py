"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Features of a line and of its neighbours give the states' scores; forward-backward marginals,
weighted by line length, give the share of a document that is bad, and a logistic curve over
that share gives its quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import byte_chunks, table, utf8_parts
from .quality_rules import _DIGIT, _LOWER, _SYMBOL, _UPPER

#: Labelled documents on which the model is fitted, at most: those with the smallest hashes of
#: their ids among the labelled rows that aren't held out.
MAX_TRAIN = 3000
N_FEATURES = 11


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, document) of each line that has a word, in order."""
    starts, ends, doc = kernels.word_spans(data, offs)
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.zeros(0, np.int64)
    h = kernels.word_hashes(data, starts, ends, False)
    marks = kernels.repeated_words(h, doc)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line_key = breaks[starts] + doc  # grows at each line break and each document
    first = np.flatnonzero(np.concatenate(([True], line_key[1:] != line_key[:-1])))
    line_of = np.cumsum(np.concatenate(([True], line_key[1:] != line_key[:-1]))) - 1
    n_lines = len(first)
    last = np.append(first[1:], len(starts)) - 1
    span = np.stack([starts[first], ends[last]])
    line_doc = doc[first]
    words = np.bincount(line_of, minlength=n_lines).astype(float)

    def within(flags: np.ndarray) -> np.ndarray:
        cum = np.concatenate(([0], np.cumsum(flags)))
        return (cum[span[1]] - cum[span[0]]).astype(float)

    upper, lower = np.concatenate(([0], np.cumsum(_UPPER[data]))), np.concatenate(([0], np.cumsum(_LOWER[data])))
    loud = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    chars = within(~kernels._SEP[data])
    with np.errstate(over="ignore"):
        order_sum = np.add.reduceat(h * (kernels.mix(np.arange(len(h)).astype(np.uint64) - first.astype(np.uint64)[line_of]) | np.uint64(1)), first)
        key = kernels.mix(order_sum + line_doc.astype(np.uint64) * kernels._PLACE[40])
    _, where = np.unique(key, return_index=True)
    again = np.ones(n_lines)
    again[where] = 0
    twins = np.concatenate(([False], (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])))
    mean = chars / words
    f = np.stack(
        [
            np.ones(n_lines),
            np.minimum(within(_SYMBOL[data]) / words, 1),
            np.bincount(line_of, weights=loud, minlength=n_lines) / words,
            np.minimum(within(data == 33) / words, 1),
            np.bincount(line_of, weights=marks, minlength=n_lines) / words,
            again,
            within(_DIGIT[data]) / chars,
            np.clip((mean - 6) / 6, -1, 2),
            np.minimum(np.log1p(words) / 5, 2),
            (words < 3).astype(float),
            np.bincount(line_of, weights=twins, minlength=n_lines) / words,
        ],
        1,
    ).astype(np.float32)
    return f, chars, line_doc


def with_neighbours(f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and the line after (zero at the ends)."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    if len(f) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:] = f[:-1] * same
        after[:-1] = f[1:] * same
    return np.concatenate([f, before, after], 1)


@dataclass
class Model:
    weights: np.ndarray  # of the bad state against the good one
    trans: np.ndarray  # (2, 2): from state, to state
    curve: np.ndarray  # intercept and slope over the bad share

    def marginals(self, f: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return forward_backward(f @ self.weights, self.trans, doc)[0]

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * share)))


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(unary: np.ndarray, trans: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of the bad state of each line, expected transitions (2, 2), log of the partition
    sums) for all chains at once; a step takes the lines at one place of every chain long enough."""
    n = len(unary)
    if n == 0:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(first, n))
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) + 1)]  # chains longer than t
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), unary], 1)
    a[first] = score[first]
    for t in range(1, int(size[0])):
        at = first[: alive[t]] + t
        prev = a[at - 1]
        for s in (0, 1):
            a[at, s] = score[at, s] + _log_add(prev[:, 0] + trans[0, s], prev[:, 1] + trans[1, s])
    for t in range(int(size[0]) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        nxt = b[at + 1] + score[at + 1]
        for s in (0, 1):
            b[at, s] = _log_add(nxt[:, 0] + trans[s, 0], nxt[:, 1] + trans[s, 1])
    last = first + size - 1
    z_chain = _log_add(a[last, 0], a[last, 1])
    z = np.empty(n)
    z[np.concatenate([first])] = z_chain
    starts = np.sort(first)
    z = np.repeat(z[starts], np.diff(np.append(starts, n)))
    bad = np.exp(a[:, 1] + b[:, 1] - z)
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if n > 1 else np.zeros(0, int)
    for s in (0, 1):
        for u in (0, 1):
            pairs[s, u] = np.exp(a[inner, s] + trans[s, u] + score[inner + 1, u] + b[inner + 1, u] - z[inner]).sum()
    return bad, pairs, float(z_chain.sum())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(line features, line lengths) of each text."""
    f, length, doc = line_features(*utf8_parts(column))
    bounds = kernels.doc_bounds(doc, len(column))
    return [(f[lo:hi], length[lo:hi]) for lo, hi in zip(bounds, bounds[1:])]


def _bad_lines(guess: np.ndarray, bad_doc: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of bad documents the lines that are guessed worse than 199 in 200 lines of good ones, and the
    worst line of each."""
    good = guess[bad_doc == 0]
    line = (bad_doc > 0) & (guess > (np.quantile(good, 0.995) if len(good) else 0))
    order = np.lexsort((-guess, doc))
    worst = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))]
    line[worst] |= bad_doc[worst] > 0
    return line.astype(float)


def fit(lines: list[tuple[np.ndarray, np.ndarray]], quality: list[int], rounds: int = 120) -> Model:
    """``lines``: features and lengths of each document's lines. Lines of good documents are good. Which lines of bad documents are bad is first told by a
    logistic fit of lines to their document's label, then by the field so learnt."""
    n_docs = len(lines)
    f = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *(x for x, _ in lines)])
    length = np.concatenate([np.zeros(0), *(x for _, x in lines)])
    doc = np.repeat(np.arange(n_docs), [len(x) for _, x in lines])
    x = with_neighbours(f, doc).astype(float)
    y_doc = np.array(quality, float)
    if not len(f) or y_doc.min(initial=1) == y_doc.max(initial=0):
        only = float(y_doc.mean()) if n_docs else 1.0
        return Model(np.zeros(3 * N_FEATURES), np.zeros((2, 2)), np.array([4.0 if only >= 0.5 else -4.0, 0.0]))
    bad_doc = 1 - y_doc[doc]
    even = np.where(bad_doc > 0, 0.5 / max(bad_doc.sum(), 1), 0.5 / max((1 - bad_doc).sum(), 1)) * len(doc)
    line = _bad_lines(f.astype(float) @ _logistic(f.astype(float), bad_doc, even, 1.0), bad_doc, doc)
    weights, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    chain = np.flatnonzero(doc[1:] == doc[:-1])
    for again in range(2):
        seen = np.zeros((2, 2))
        np.add.at(seen, (line[chain].astype(int), line[chain + 1].astype(int)), 1)
        have = x.T @ line
        m = [np.zeros_like(weights), np.zeros((2, 2))]
        v = [np.zeros_like(weights), np.zeros((2, 2))]
        for step in range(1, rounds + 1):
            p, pairs, _ = forward_backward(x @ weights, trans, doc)
            grads = [(have - x.T @ p) / n_docs - 0.002 * weights, (seen - pairs) / n_docs - 0.002 * trans]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                move = 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
                if i == 0:
                    weights = weights + move
                else:
                    trans = trans + move
        if not again:
            line = _bad_lines(forward_backward(x @ weights, trans, doc)[0], bad_doc, doc)
    share = bad_share(forward_backward(x @ weights, trans, doc)[0], length, doc, n_docs)
    both = np.stack([np.ones(n_docs), share], 1)
    even = np.where(y_doc > 0, 0.5 / max(y_doc.sum(), 1), 0.5 / max((1 - y_doc).sum(), 1)) * n_docs
    return Model(weights, trans, _logistic(both, y_doc, np.sqrt(even), 0.02))


def bad_share(p: np.ndarray, length: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Mean chance of a bad line, weighted by length; 0 without lines."""
    total = np.bincount(doc, weights=length, minlength=n_docs)
    return np.bincount(doc, weights=length * p, minlength=n_docs) / np.maximum(total, 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most MAX_TRAIN labelled rows that aren't held out. Null labels or ids are left out; of documents
    that repeat an id one counts. Lines are measured in the tasks: the driver gets their features, no texts."""
    rows = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
        .where("id is not null and quality is not null")
        .where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1)
        .groupBy("id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(MAX_TRAIN)
    )
    few = {r["id"]: r["quality"] for r in rows.collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "text"):
                got = _features_of(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([f.tobytes() for f, _ in got], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in got], pa.binary())],
                    names=["id", "h", "f", "n"],
                )

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), text.alias("text"))
    picked = own.sparkSession.createDataFrame([(k,) for k in few], "id long")
    lines = own.join(F.broadcast(picked), "id", "left_semi").mapInArrow(features, "id long, h long, f binary, n binary")
    # rows that repeat an id: the one whose text hashes lowest, whichever comes first
    got = lines.groupBy("id").agg(F.min_by(F.struct("f", "n"), "h").alias("x")).orderBy("id").collect()
    parts = [(np.frombuffer(r["x"]["f"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["x"]["n"], np.float32).astype(float)) for r in got]
    return fit(parts, [few[r["id"]] for r in got])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, held_out, score, predicted).

    score: from 0 to 1, higher where label 1 is likelier, from the text alone. held_out: the rows
    whose crc32 of the id modulo 3 is 1, from which nothing is learnt; false for a null id. Null or
    empty text, or text without words: no bad line, so the score of a wholly good text. Very long
    texts are one chain. Ties and repeated rows: each row is scored by itself. Extra columns are
    ignored. Empty input gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "text"):
                f, length, doc = line_features(*utf8_parts(part.column(2)))
                p = model.marginals(with_neighbours(f, doc), doc)
                s = model.score(bad_share(p, length, doc, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("long").cast("string")), F.lit(3)) == 1, F.lit(False))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_col)


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
