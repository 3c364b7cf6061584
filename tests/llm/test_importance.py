"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from linkcatalog.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20, n=10_000):
    bucket = lambda x: zlib.crc32(x.encode()) % n
    s, t = [0] * n, [0] * n
    for texts, into in ((docs, s), (target, t)):
        for _, text in texts:
            for x in features(text)[1]:
                into[bucket(x)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + n) / ((a + 1.0) * (sum(t) + n)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        n_words, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in own)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = len(able) * percent // 100
    ranks = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return sorted([*ranks, *((*r[:4], None) for r in rows if r[4] < least)], key=str)


def texts(n=160, seed=3):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(90)] + ["é", "straße", "日本", "Ünï", "x" * 70, "İ", "K"]
    ends = [" ", ", ", "\n", "\x00", "-", "　 ", "_", "  "]
    out = [(k, "".join(r.choice(vocab).upper() + r.choice(ends) if r.random() < 0.1 else r.choice(vocab) + r.choice(ends) for _ in range(r.choice([1, 2, 3, 19, 20, 60])))) for k in range(n)]
    long = " ".join(r.choice(vocab) for _ in range(5000))
    odd = [None, "", " ", "...", "one", "one two", "one two three", "!one-two!", long, "y" * 3000, "a\x00b"]
    return out + [(1000 + k, t) for k, t in enumerate(odd)] + [(None, long), (None, out[5][1]), (None, out[5][1]), (7, out[7][1]), (7, "again " * 25)]


@pytest.mark.parametrize("limit", [1 << 22, 300])
def test_resampling_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(importance.text_groups, "__defaults__", (limit,))  # 300: long texts come in pieces
    docs, target = texts(), [(k, t) for k, t in texts(20, 9)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, rank int, score int, range int").repartition(3)
    got = importance.resample(df, spark.createDataFrame(target, "item_id long, text string"), percent=30).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, 30)


def test_resampling_of_the_test_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    target = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()
    got = importance.op13_importance_resampling(spark, data).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target)


def test_text_pieces_have_every_run_once():
    for text in ("ab cd ef gh ij kl mn", "x" * 50, " a  b ", "a" * 9 + " b c", "", "é ü " * 9):
        whole = sorted(features(text)[1])
        for limit in (1, 2, 5, 7, 1000):
            n = 0
            for at, data, offs, upto in importance.text_groups(pa.array([text, "q r", None, text]), limit):
                n += sum(len(x[0]) for x in importance.Trie(data, offs, upto).paths)
            assert n == 2 * len(whole) + 3


def test_crc_states_follow_the_paths():
    text = "the trie has nodes and the trie has states " * 3
    (_, data, offs, upto), = importance.text_groups(pa.array([text]))
    trie = importance.Trie(data, offs, upto)
    want = sorted(zlib.crc32(x.encode()) for x in set(features(text)[1]))
    assert sorted(int(x) for s in trie.state for x in s) == want


def test_hot_score_and_empty_tables(spark):
    text = "one text of many copies with more than twenty words in it so that each of its rows may be drawn by chance here"
    docs = [(None, text)] * 400 + [(k, text) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = importance.resample(df, none).collect()
    assert sorted(x["rank"] for x in got if x["rank"] is not None) == list(range(1, 41))
    assert sorted(map(tuple, got), key=str) == brute(docs, [])
    assert importance.resample(none.withColumnRenamed("item_id", "doc_id"), df).collect() == []
