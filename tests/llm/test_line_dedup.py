"""Shared lines against brute force."""

import hashlib
import random

import pytest

from linkcatalog.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(docs, least_chars=40, least_docs=5):
    held = {}
    for i, text in {(i, t or "") for i, t in docs}:
        for k in {key_of(x) for x in text.split("\n")}:
            if len(k) >= least_chars:
                held.setdefault(k, []).append(i)
    largest = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    rows = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key_of(x) not in largest or largest[key_of(x)] == i]
        rows.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(rows, key=str)


def make_docs(seed=4, n=150):
    r = random.Random(seed)
    shared = [f"shared line number {k} " + r.choice(["é", "ß", "日本語", "x"]) * r.randrange(10, 40) for k in range(12)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(r.choice([1, 2, 5, 70, 200])):
            x = r.choice(shared) if r.random() < 0.3 else f"own {r.random()} {r.random()} " + "y" * r.randrange(20)
            lines.append(r.choice(["", " ", "\t\x0b", "\x0c\r"]) + (x.upper() if r.random() < 0.3 and x.isascii() else x) + r.choice(["", "\r", "  "]))
        rows.append((k, "\n".join(lines)))
    line = "a line of forty characters and some more, held by all"
    rows += [(k, f"{line}\nrest {k}\n{line}\n") for k in range(200, 320)] + [(None, line), (None, line), (None, None), (500, None), (501, ""), (502, "\n\n"), (319, line), (320, line)]
    rows += [(None, f"{shared[0]}q\n{k}") for k in range(6)] + [(600 + k, "z" * 39 + "\n" + "z" * 40 + "\n" + " " + "z" * 39) for k in range(5)]
    return rows + [(700, "\n".join([line, "w" * 50] * 3000)), (701, "w" * 50), (702, "w" * 50), (703, "w" * 50), (704, "W" * 50), (705, "\n" * 5000 + line)]


def got_of(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, 2, 3, "r") for i, t in rows], "doc_id long, text string, pos int, th int, keep int, own string").repartition(3)
    out = line_dedup.drop_shared_lines(df, **options)
    return sorted(((x["row"]["doc_id"], x["n_lines"], x["n_dropped"], hashlib.sha256(x["kept"].encode()).hexdigest()) for x in out.collect()), key=str)


@pytest.mark.parametrize("least", [32, 1 << 40, 1])
def test_line_dedup_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", least)  # no key is hot, or all are
    rows = make_docs()
    assert got_of(spark, rows) == brute(rows)


def test_line_dedup_with_a_sparse_sample_and_other_bounds(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SAMPLE", 500)
    rows = make_docs(5, 60)
    assert got_of(spark, rows, least_chars=20, least_docs=2) == brute(rows, 20, 2)


def test_bitmaps_leave_out_words_that_stay(spark):
    line = "a line of forty characters and some more, held by all"
    rows = [(k, "\n" * 640 + line) for k in range(5)]
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in got) == [0, 1, 2, 3]
    assert all([tuple(w) for w in x["keep"]] == [(10, ~1)] for x in got)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_dedup_equals_sql(same):
    same(line_dedup.op11_line_dedup, line_dedup.OP11_SQL)


def test_line_dedup_sorts_ranges_once(spark, data, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 1 << 40)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    marks = line_dedup.mark_lines(docs, 40, "doc_id", "text")
    plan = line_dedup.shared_lines(marks, 5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "Python" not in plan and "Arrow" not in plan
