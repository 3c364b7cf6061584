"""Operator 1 where many documents share tokens: no link is lost and what is shuffled grows with the input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkcatalog.llm import ngram_join
from linkcatalog.llm.trie_join import join_block, needed

from .test_table_operators import brute_components


def with_common_line(n, seed=5):
    """Documents of 100 words of their own and a line of 20 words that all share."""
    r = random.Random(seed)
    line = " ".join(f"line{i}" for i in range(20))
    return [(i, line + "\n" + " ".join(f"v{r.randrange(10**9)}" for _ in range(100))) for i in range(n)]


def test_rows_dealt_grow_with_the_input_under_a_common_line(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STRIP", 16)
    dealt, dealt_rows = ngram_join._dealt, []

    def counted(df):
        dealt_rows[-1] += df.count()
        return dealt(df)

    monkeypatch.setattr(ngram_join, "_dealt", counted)
    for n in (100, 400):
        dealt_rows.append(0)
        found = ngram_join.jaccard_classes(spark.createDataFrame(with_common_line(n), "doc_id long, text string"))
        assert found.where("n_links = 0 and component_id = doc_id").count() == n
    assert dealt_rows[1] <= 4 * max(dealt_rows[0], 100), dealt_rows  # strip pairs: 16 times


@pytest.mark.parametrize("cuts", [{}, {"prefix": None, "sketch": None}])
def test_links_of_documents_made_of_common_lines(spark, monkeypatch, cuts):
    monkeypatch.setattr(ngram_join, "STRIP", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 3)
    r = random.Random(11)
    common = [f"c{i}" for i in range(160)]
    rows = []
    for k in range(24):
        size, part = r.choice([30, 45, 60, 130]), r.choice([0, 0.3, 0.6, 0.85, 0.95])
        base = common[: int(size * part)] + [f"o{k}x{i}" for i in range(size - int(size * part))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(r.choice([1, 2])):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**9)}"
            rows.append(" ".join(copy))
    order = r.sample(range(len(rows)), len(rows))
    rows = list(zip(order, rows))
    got = sorted(tuple(x) for x in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), **cuts).collect())
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("prefix, sketch", [(ngram_join.PREFIX, ngram_join.SKETCH), (None, None)])
def test_each_pair_is_met_once_whatever_is_frequent(prefix, sketch):
    r = np.random.default_rng(4)
    kinds = set()
    for turn in range(3000):
        n_union = int(r.choice([10, 30, 45, 58, 80, 150, 300]))
        union = np.unique(r.integers(1, 1 << 63, n_union, np.uint64))
        alone = r.permutation(len(union))[: len(union) // 5]
        side = r.integers(0, 2, len(alone))
        sets = [np.delete(union, alone[side == k]) for k in (0, 1)]
        shared = np.delete(union, alone)
        # tokens that both hold alone, or any: up to all of the smallest
        pool = (shared if turn % 2 else union)[: int(r.choice([20, 60, 400]))]
        late = np.sort(r.permutation(pool)[: int(len(pool) * r.choice([0.05, 0.2, 0.5, 1]))])
        n = np.array([len(s) for s in sets])
        if not len(alone) or (n == len(union)).all():
            continue
        body = [s[:sketch].tobytes() for s in sets]
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(n), pa.array(body, pa.binary())], names=["rep", "n", "body"])
        out = next(ngram_join._postings([batch], late, 80, 100, prefix, sketch))
        keys, rep, often = out.column(0).to_numpy().view(np.uint64), out.column("rep").to_numpy(), out.column("often").to_numpy()
        marks = np.array([often[rep == k].max() for k in (0, 1)])
        kinds.add(tuple(marks.tolist()))
        met = []
        for key in np.intersect1d(keys[rep == 0], keys[rep == 1]):
            join_block(sets, n, lambda a, b: needed(a, b, 80, 100), key, 2, True, lambda i, p: met.append((i, p)), 80, 100, None, late, marks > 0)
        assert len(met) == 1, (turn, n, len(late), marks)
    assert {(0, 0), (1, 1)} <= kinds and kinds & {(0, 1), (1, 0)}


def test_texts_that_are_wanted_pass_the_filter_and_few_others(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("id"), F.xxhash64("id").alias("h"), F.col("id").alias("n"))
    rows = docs.select(*ngram_join._named_row("id", "h"), "n")
    kept = {r["n"] for r in ngram_join._filtered(rows, rows.where("n % 40 = 0")).select("n").collect()}
    assert kept >= set(range(0, 4000, 40)) and len(kept) < 300
    assert ngram_join._filtered(rows, rows.where("n < 0")).count() == 0
