"""Tokenizers aligned, against the libraries over whole texts and a plain count of all pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkcatalog.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))


def byte_values():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def spans(parts):
    out, at = [], 0
    for i, x in parts:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows, libraries):
    a, b = libraries
    values = byte_values()
    each, count = [], Counter()
    for _, text in rows:
        if not text:
            each.append(None)
            continue
        raw = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [(i, bytes(values[c] for c in a.id_to_token(i))) for i in ids_a]
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        bytes_b = [(i, piece(i)) for i in ids_b]
        if b"".join(x for _, x in bytes_a) != raw or b"".join(x for _, x in bytes_b) != raw:
            each.append(None)
            continue
        sa, sb = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for x, p, q in sa for y, r, s in sb if p < s and r < q] if len(sa) < 400 else plain_links(sa, sb)
        both = sorted({q for _, _, q in sa} & {q for _, _, q in sb})
        groups, lo = [], 0
        for hi in both:
            groups.append(",".join(str(x) for x, p, q in sa if lo <= p and q <= hi) + "|" + ",".join(str(x) for x, p, q in sb if lo <= p and q <= hi)) if len(sa) < 400 else None
            lo = hi
        if len(sa) >= 400:
            groups = plain_groups(sa, sb, both)
        count.update(links)
        each.append((len(sa), len(sb), groups, links))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (i, _), x in zip(rows, each):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            top = sum(count[k] == best[k[1]] for k in links)
            out.append((i, n_a, n_b, len(groups), len(links), top, sum(count[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def plain_links(sa, sb):
    out, j = [], 0
    for x, p, q in sa:
        while sb[j][2] <= p:
            j += 1
        k = j
        while k < len(sb) and sb[k][1] < q:
            out.append((x, sb[k][0]))
            k += 1
    return out


def plain_groups(sa, sb, both):
    out, i, j = [], 0, 0
    for hi in both:
        own_a, own_b = [], []
        while i < len(sa) and sa[i][2] <= hi:
            own_a.append(str(sa[i][0]))
            i += 1
        while j < len(sb) and sb[j][2] <= hi:
            own_b.append(str(sb[j][0]))
            j += 1
        out.append(",".join(own_a) + "|" + ",".join(own_b))
    return out


ODD = [
    None, "", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a  b  ", "a\n b", "a\n  b", "a \n b", "x\n\n  y", "\n", "\t \t", "it's we'll  I'd", "don 't", "<|endoftext|> x",
    "a <|endoftext|>", "<s>a</s> <unk> <0x41> ", "▁", "a ▁b", "a▁ b", "日本 語 です", "é é ﬁ K İ", "😀 😀😀", "a b 　 c", "a  b", "\x1c a\x1d b", "\x00 a\x00", "12 345,678  9", "a" * 3000,
    "a b " * 900, "word" * 200 + " " + "word" * 200, "\r\n x\r\n", "a\x85 b", "﻿a b", "ä" * 400, "x  " * 300, " ​ a",
]


def test_alignment_equals_libraries(spark, libraries):
    r = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", "é", "日", "don't", "1984", ",", "<s>", "\t", "Straße", "▁" if r.random() < 0 else "_", "internationalisation"]
    rows = [(k, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(40)))) for k in range(150)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "the a b"), (None, "the a b"), (3, rows[3][1]), (3, "other text")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n_a int, pair int, n int").repartition(3)
    assert sorted(map(tuple, alignment.align_tokenizers(df).collect()), key=str) == brute(rows, libraries)


def test_alignment_of_the_test_tables(spark, data, libraries):
    rows = [tuple(x) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.op12_tokenizer_alignment(spark, data).collect()), key=str) == brute(rows, libraries)


def test_pair_counts_are_sorted_and_whole(spark, libraries, monkeypatch):
    for name, value in (("LINKS", 50), ("PAIRS", 20)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in alignment.pair_counts(alignment.align_texts(df, "doc_id", "text", None, None)).collect()]
    assert len({p for p, _ in got}) == len(got)
    n_links = sum(x[4] for x in brute(rows, libraries))
    assert sum(n for _, n in got) == n_links


@pytest.mark.parametrize("cuts", [{}, {"KEPT": 5, "GROUP": 50}, {"KEPT_BYTES": 3000, "GROUP": 50, "CALL": 1}, {"CALL": 7, "GROUP": 1}])
def test_caches_that_are_full_change_nothing(libraries, monkeypatch, cuts):
    for name, value in cuts.items():
        monkeypatch.setattr(alignment, name, value)
    cache = alignment.Cache(alignment.Aligner(None, None))
    texts = ODD * 2
    want = {i: x for i, *x in brute(list(enumerate(texts)), libraries)}
    k = 0
    for counts, pairs, each, digests in alignment.aligned_texts(cache, pa.array(texts)):
        for j, digest in enumerate(digests):
            assert [*(int(x[j]) for x in counts), digest] == [*want[k][:4], want[k][6]], texts[k]
            k += 1
        assert len(pairs) == each.sum()
    assert k == len(texts)


def test_links_come_back_as_they_were_packed():
    r = random.Random(4)
    texts = [[(r.randrange(1 << 20) << 32) | r.randrange(1 << 20) for _ in range(r.choice([0, 1, 40]))] * r.choice([1, 3]) for _ in range(30)]
    values = alignment.packed(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]))
    for t, value in zip(texts, values):
        pairs, times = alignment.unpacked(value)
        assert dict(zip(pairs.tolist(), times.tolist())) == dict(Counter(t))


def test_sums_add_up_over_parts():
    held = [np.array([5, 8]), np.array([2, 1])]
    pair, n = alignment._summed(held, [(np.array([5, 7]), np.array([6, 3])), (np.array([7, 9]), np.array([2, 2]))])
    assert pair.tolist() == [5, 7, 8, 9] and n.tolist() == [8, 5, 1, 2]


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).collect() == []
