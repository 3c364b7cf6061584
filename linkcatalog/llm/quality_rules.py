"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import byte_chunks, table, utf8_parts

#: Rows of the sample on which costs and selectivities are estimated; they set the order alone.
SAMPLE = 200
_SPACE = b" \t\n\r\x0b\x0c"


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CHAR = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Texts:
    """Documents of a chunk with what is counted for all of them."""

    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    def only(self, rows: np.ndarray) -> Texts:
        """The given documents (ascending) alone: their bytes and words are gathered, the others' left behind."""
        if len(rows) == len(self.n_words):
            return self
        size = np.diff(self.offs)[rows]
        offs = np.concatenate(([0], np.cumsum(size)))
        shift = self.offs[rows] - offs[:-1]
        data = self.data[np.arange(offs[-1]) + np.repeat(shift, size)]
        bounds = kernels.doc_bounds(self.doc, len(self.n_words))
        n = np.diff(bounds)[rows]
        doc = np.repeat(np.arange(len(rows)), n)
        word = np.arange(len(doc)) + np.repeat(bounds[rows] - np.concatenate(([0], np.cumsum(n)))[:-1], n)
        counts = (x[rows] for x in (self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words))
        return Texts(data, offs, self.starts[word] - shift[doc], self.ends[word] - shift[doc], doc, *counts)


def _dup_lines(body: bytes) -> int:
    lines = body.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return n


def measure(data: np.ndarray, offs: np.ndarray) -> Texts:
    starts, ends, doc = kernels.word_spans(data, offs)
    n_docs = len(offs) - 1
    marks = kernels.repeated_words(kernels.word_hashes(data, starts, ends, False), doc)
    raw = data.tobytes()
    return Texts(
        data, offs, starts, ends, doc,
        np.bincount(doc, minlength=n_docs),
        kernels.counts_between(_CHAR[data] & ~kernels._SEP[data], offs),
        kernels.counts_between(_SYMBOL[data], offs),
        np.array([_dup_lines(raw[offs[i] : offs[i + 1]]) for i in range(n_docs)], np.int64),
        np.bincount(doc, weights=marks, minlength=n_docs).astype(np.int64),
    )


# Each rule sees the documents that are left, no others, and says which it rejects.
def too_many_symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > t.n_words


def odd_word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words)


def repeated_lines(t: Texts) -> np.ndarray:
    return 100 * t.n_dup_lines > 40 * (kernels.counts_between(t.data == 10, t.offs) + 1)


def shouting(t: Texts) -> np.ndarray:
    both = np.zeros((2, len(t.data) + 1), np.int64)
    np.cumsum(_UPPER[t.data], out=both[0, 1:])
    np.cumsum(_LOWER[t.data], out=both[1, 1:])
    loud = (both[0, t.ends] - both[0, t.starts] >= 2) & (both[1, t.ends] == both[1, t.starts])
    return 100 * np.bincount(t.doc, weights=loud, minlength=len(t.n_words)).astype(np.int64) > 30 * t.n_words


def mostly_numbers(t: Texts) -> np.ndarray:
    return 100 * kernels.counts_between(_DIGIT[t.data], t.offs) > 40 * t.word_chars


RULES: tuple[Callable[[Texts], np.ndarray], ...] = (
    shouting, repeated_lines, odd_word_length, mostly_numbers, too_many_symbols,
)


def trial(t: Texts, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(which documents each rule rejects, seconds that it takes for each), by document and rule."""
    rejects = np.zeros((len(t.n_words), len(RULES)), bool)
    cost = np.zeros((len(t.n_words), len(RULES)))
    share = np.diff(t.offs) / max(1, len(t.data))
    for i, rule in enumerate(RULES):
        began = time.perf_counter()
        for _ in range(rounds):
            rejects[:, i] = rule(t)
        cost[:, i] = share * (time.perf_counter() - began) / rounds
    return rejects, cost


def rule_order(rejects: np.ndarray, cost: np.ndarray) -> list[str]:
    """Rule names, one after the other that which rejects most per second of the documents that the rules
    before it keep."""
    order, left, open_ = [], np.ones(len(rejects), bool), list(range(len(RULES)))
    while open_:
        gain = {i: rejects[left, i].sum() / max(cost[left, i].sum(), 1e-9) for i in open_}
        best = max(open_, key=lambda i: gain[i])
        order.append(RULES[best].__name__)
        left &= ~rejects[:, best]
        open_.remove(best)
    return order


def sampled_order(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """:func:`rule_order` over about SAMPLE rows, twice as many at most: those of the ids whose hashes leave no
    rest. The rules run in the tasks; the driver gets a verdict and a cost for each row and rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, "text"):
                t = measure(*utf8_parts(part.column(0)))
                t = t.only(np.flatnonzero(t.n_words >= 50))
                rejects, cost = trial(t)
                yield pa.RecordBatch.from_arrays([pa.array(rejects.tolist(), pa.list_(pa.bool_())), pa.array(cost.tolist(), pa.list_(pa.float64()))], names=["rejects", "cost"])

    every = max(1, docs.count() // SAMPLE)
    rows = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(every)) == 0).select(F.col(text_col).cast("string").alias("text")).limit(2 * SAMPLE)
    got = rows.mapInArrow(run, "rejects array<boolean>, cost array<double>").collect()
    return rule_order(np.array([r[0] for r in got], bool).reshape(-1, len(RULES)), np.array([r[1] for r in got], float).reshape(-1, len(RULES)))


def _apply(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    rules = {r.__name__: r for r in RULES}
    for batch in batches:
        for part in byte_chunks(batch, "text"):
            t = measure(*utf8_parts(part.column(1)))
            failed = (t.n_words < 50) | (100 * t.n_repeat_words > 50 * t.n_words)
            kept = ~failed
            left = np.flatnonzero(kept)
            view = t.only(left)
            for name in order:
                if not len(left):
                    break
                bad = rules[name](view)
                if bad.any():
                    kept[left[bad]] = False
                    left, view = left[~bad], view.only(np.flatnonzero(~bad))
            cols = [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array(failed), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept).

    The base rule comes first; then the cascade runs each further rule on the bytes of the rows alone
    that all before it have kept. The order comes from a bounded sample (2 * SAMPLE rows at most, by hash
    of the id): what a rule rejects, per cost, of the rows that are left. It changes the work, never the
    verdict.

    Null or empty text: counts 0, base_failed. Null ids, ties and repeated rows: each row is judged
    by itself. Very long texts are taken whole. Extra columns are ignored. Empty input: no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = sampled_order(src, "doc_id", "text")
    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return src.mapInArrow(lambda it: _apply(it, order), kinds).withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the texts don't move."""
    schema, at = docs.schema, docs.columns.index(text_col)
    order = sampled_order(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, text_col):
                two = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column(at)], names=["id", "text"])
                verdict = [x.column(7) for x in _apply([two], order)]
                yield part.filter(pa.concat_arrays(verdict))

    return docs.mapInArrow(run, schema)


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT r, i, w[i:i + 2] AS x FROM w, unnest(generate_series(1, len(w) - 2)) AS u(i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest([0, 1, 2]) AS v(j) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, unnest(ls) AS l FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(length(array_to_string(w.w, '')), 0) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[0-9]')) AS n_digits,
    len(list_filter(w.w, lambda x: len(regexp_extract_all(x, '[A-Z]')) >= 2 AND NOT regexp_matches(x, '[a-z]'))) AS n_loud
  FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN dup ON dup.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_loud > 30 * n_words OR 100 * n_digits > 40 * word_chars) AS kept
FROM b
"""
