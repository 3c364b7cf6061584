"""Approximate nearest neighbours by additive quantisation.

Codebooks are full-dimensional and residual: a vector is the sum of one codeword of each, found
by beam search. Searching adds looked-up inner products of query and codewords (with stored norms
for distances), takes the best rows of a block and reranks them exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Rows on which codebooks are fitted, at most: those with the smallest hashes of their ids.
SAMPLE = 8192
N_BOOKS, N_WORDS, BEAM, FIT_ROUNDS = 16, 256, 4, 6
#: Rows of a block and how many of them each query reranks exactly. All blocks are searched.
BLOCK, RERANK = 16384, 400
#: Queries that one pass carries to all rows; more queries take more passes.
QUERY_BLOCK = 8192
#: Queries whose scores against a block are held at once.
STEP = 128


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dim), float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows, books) of the best of ``beam`` partial sums kept at each book."""
        out = np.zeros((len(x), len(self.words)), np.uint8)
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024].astype(np.float32)
            n, dim = part.shape
            rest = part[:, None, :]
            codes = np.zeros((n, 1, 0), np.uint8)
            for book in self.words:
                k = len(book)
                # squared length of what would remain: |r|^2 - 2 r.c + |c|^2
                left = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, dim) @ book.T).reshape(n, -1, k) + (book**2).sum(1)
                flat = left.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                parent, code = best // k, best % k
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), code[:, :, None].astype(np.uint8)], 2)
                rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[code]
            last = (rest**2).sum(2).argmin(1)
            out[lo : lo + n] = codes[np.arange(n), last]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.words))


def fit(x: np.ndarray, n_books: int = N_BOOKS, n_words: int = N_WORDS, rounds: int = FIT_ROUNDS, seed: int = 5) -> Codebooks:
    """Residual k-means, book by book."""
    rng = np.random.default_rng(seed)
    rest = x.astype(np.float32).copy()
    k = max(1, min(n_words, len(x)))
    books = []
    for _ in range(n_books):
        book = rest[rng.permutation(len(rest))[:k]].copy()
        for step in range(rounds + 1):
            near = (2 * (rest @ book.T) - (book**2).sum(1)).argmax(1)
            if step == rounds:
                break
            size = np.bincount(near, minlength=k)
            total = np.zeros_like(book)
            np.add.at(total, near, rest)
            book = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], book).astype(np.float32)
        rest -= book[near]
        books.append(book)
    return Codebooks(np.stack(books))


def _matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as float64, which rows take part): null, zero, odd-length or non-finite ones don't."""
    rows = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(-1)) if rows else np.zeros(0, int)
    if dim is None:
        dim = int(size.max()) if rows else 0
    good = size == dim
    flat = column.filter(pa.array(good)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim) if dim > 0 else np.zeros((int(good.sum()), 0))
    usable = np.isfinite(x).all(1) & (x != 0).any(1)
    full = np.zeros((rows, dim))
    at = np.flatnonzero(good)
    full[at] = np.where(np.isfinite(x), x, 0)
    ok = np.zeros(rows, bool)
    ok[at] = usable
    return full, ok


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **sizes) -> tuple[DataFrame, Codebooks | None, int]:
    """(index, codebooks, dim). The index holds every usable row: row (a number of its own), id, codes, norm of
    the decoded vector, and the original vector. Codebooks are fitted on at most SAMPLE rows. The dimension is
    the most frequent one; rows of another take no part."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    found = src.where("v is not null and size(v) > 0 and id is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if found is None:
        return src.select(F.lit(0).cast("long").alias("row"), "id", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm"), "v").limit(0), None, 0
    dim = found[0]
    sample = src.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    x, ok = _matrix(sample.column("v"), dim)
    if not ok.any():
        return src.select(F.lit(0).cast("long").alias("row"), "id", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm"), "v").limit(0), None, dim
    books = fit(x[ok], **sizes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _matrix(batch.column(1), dim)
            ok &= np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).filter(pa.array(ok))
            x = x[ok]
            if not len(x):
                continue
            codes = books.encode(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((books.decode(codes) ** 2).sum(1).astype(float)), pa.array(list(x), pa.list_(pa.float64()))],
                names=["id", "codes", "norm", "v"],
            )

    coded = src.mapInArrow(encode, "id long, codes binary, norm double, v array<double>")
    index = materialize(coded.select(F.monotonically_increasing_id().alias("row"), "*"), "vector-index")
    return index, books, dim


def _search_block(books, metric, q, q_rows, rows_no, ids, codes, norm, x, k, best_s, best_i):
    """Improves the best ``k`` (scores, ids) of each query with one block of rows."""
    flat_words = books.words.reshape(-1, books.words.shape[2])
    n_words = books.words.shape[1]
    at = codes.astype(np.int64) + np.arange(codes.shape[1]) * n_words
    take = min(len(ids), max(RERANK, 2 * k))
    for lo in range(0, len(q), STEP):
        part = q[lo : lo + STEP]
        tables = (flat_words @ part.T.astype(np.float32)).astype(np.float32)  # (books * words, queries)
        score = tables[at[:, 0]]
        for j in range(1, at.shape[1]):
            score += tables[at[:, j]]
        if metric == "l2":
            score = 2 * score - norm[:, None].astype(np.float32)
        score = np.ascontiguousarray(score.T)
        near = np.argpartition(score, len(ids) - take, axis=1)[:, len(ids) - take :] if take < len(ids) else np.tile(np.arange(len(ids)), (len(part), 1))
        for row in range(len(part)):
            rows = near[row]
            exact = (x[rows] * part[row]).sum(1) if metric == "ip" else -((x[rows] - part[row]) ** 2).sum(1)
            own = ids[rows]
            keep = rows_no[rows] != q_rows[lo + row]
            s = np.concatenate([best_s[lo + row], exact[keep]])
            i = np.concatenate([best_i[lo + row], own[keep]])
            order = np.lexsort((i, -s))[:k]
            best_s[lo + row], best_i[lo + row] = s[order], i[order]


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, dim: int, k: int = 20, metric: str = "ip") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, nearest first, ties
    to the smaller id. Scores are exact, in double precision: inner product (``ip``) or minus the squared
    distance (``l2``).

    ``queries``: id, v and row. row is that of the index where a query is one of its rows, which then is no
    candidate of its own; null for other queries. Rows that repeat an id are queries and candidates
    of their own.

    Queries go to all rows in passes of QUERY_BLOCK, a bounded broadcast each; a task keeps the
    best ``k`` of its rows, which meet by query. Null, zero, non-finite or odd-length vectors
    take no part. Fewer candidates than ``k``: all of them.
    """
    spark = index.sparkSession
    schema = "q long, query_id long, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    q_rows = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.coalesce(F.col("row").cast("long"), F.lit(-1)).alias("row"))
    q_rows = q_rows.where("id is not null and v is not null").where(F.size("v") == dim)
    n_pass = max(1, -(-q_rows.count() * 5 // (4 * QUERY_BLOCK)))  # hashing fills passes unevenly
    out = None
    for turn in range(n_pass):
        own = q_rows.where(F.pmod(F.xxhash64("id", "row"), F.lit(n_pass)) == turn) if n_pass > 1 else q_rows
        got = own.toArrow()
        q, ok = _matrix(got.column("v"), dim)
        q_ids = np.asarray(got.column("id"))[ok].astype(np.int64)
        q_no = np.asarray(got.column("row"))[ok].astype(np.int64)
        q = q[ok]
        if not len(q):
            continue
        held = spark.sparkContext.broadcast((books, q, q_ids, q_no))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            books, q, q_ids, q_no = held.value
            best_s = [np.zeros(0) for _ in q_ids]
            best_i = [np.zeros(0, np.int64) for _ in q_ids]
            kept: list[pa.RecordBatch] = []

            def flush():
                block = pa.Table.from_batches(kept)
                x, _ = _matrix(block.column("v"), dim)
                codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
                _search_block(books, metric, q, q_no, np.asarray(block.column("row")), np.asarray(block.column("id")), codes, np.asarray(block.column("norm")), x, k, best_s, best_i)
                kept.clear()

            size = 0
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    kept.append(batch.slice(lo, BLOCK))
                    size += kept[-1].num_rows
                    if size >= BLOCK:
                        flush()
                        size = 0
            if kept:
                flush()
            for lo in range(0, len(q_ids), 1024):
                n = [len(s) for s in best_s[lo : lo + 1024]]
                if sum(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.arange(lo, lo + len(n)), n)), pa.array(np.repeat(q_ids[lo : lo + 1024], n)), pa.array(np.concatenate(best_i[lo : lo + 1024])), pa.array(np.concatenate(best_s[lo : lo + 1024]))],
                        names=["q", "query_id", "vec_id", "score"],
                    )

        found = index.mapInArrow(run, schema)
        top = found.withColumn(
            "rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        ).where(F.col("rank") <= k)
        top = materialize(top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest") if n_pass > 1 else top
        out = top if out is None else out.union(top)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books, dim = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, books, index.where("id % 20 = 0"), dim)
