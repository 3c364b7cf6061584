"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "word_bpe_49k.json"
#: Pieces of text whose encoding a task keeps, at most; then it starts anew.
KEPT = 300_000
#: Letters up to here have no combining forms and the same case rules everywhere.
_PLAIN = "\u024f"
#: Characters that splitters take differently, or that lower-casing takes apart.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u0130]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    out = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Bpe:
    """Vocabulary, sorted merge pairs, and the splitter of a word-end BPE file."""

    def __init__(self, path: str | None = None):
        import json

        import regex
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.width = len(self.tokens)
        pair = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        by = np.argsort(pair, kind="stable")
        self.pairs, self.ranks, self.into = pair[by], by, into
        self.library = Tokenizer.from_file(path)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.marks = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None

    def split(self, piece: str) -> list[bytes | int]:
        """The words of a piece without white space, as bytes; special tokens as ids."""
        if (piece.isascii() or max(piece) <= _PLAIN) and "<|" not in piece and not _ODD.search(piece):
            low = piece.lower()
            return [low.encode()] if low.isalpha() else [w.encode() for w in self.words.findall(low)]
        out: list[bytes | int] = []
        at = 0
        for m in [*(self.marks.finditer(piece) if self.marks else []), None]:
            part = piece[at : m.start()] if m else piece[at:]
            if part:
                part = self.library.normalizer.normalize_str(part)
                out += [bytes(self.byte_of[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many words at once.

        All symbols lie in one flat array. In each round every word's lowest-rank pair is found by
        binary search over the sorted pair keys and merged wherever it stands, from left to right;
        words without such a pair leave.
        """
        lens = np.array([len(w) for w in words], np.int64)
        sym = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lens)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        far = len(self.pairs)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), far - 1)
            rank = np.where((self.pairs[at] == key) & (word[:-1] == word[1:]), self.ranks[at], far)
            rank = np.append(rank, far)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            low = np.repeat(best, size)
            ended = low == far
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                go = ~ended
                sym, word, rank, low = sym[go], word[go], rank[go], low[go]
                if not len(sym):
                    break
            hit = rank == low
            # of touching hits (a pair of twins in a run) every second stands
            where = np.flatnonzero(hit)
            fresh = np.concatenate(([True], np.diff(where) != 1))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            sym = sym.copy()
            sym[where] = self.into[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        return sym[by], np.searchsorted(word[by], np.arange(len(words) + 1))

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        parts = [self.split(p) for p in pieces]
        number: dict[bytes, int] = {}
        for part in parts:
            for w in part:
                if not isinstance(w, int):
                    number.setdefault(w, len(number))
        ids, offs = self.merge(list(number)) if number else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        ids, offs = ids.tolist(), offs.tolist()
        out = []
        for part in parts:
            own: list[int] = []
            for w in part:
                if isinstance(w, int):
                    own.append(w)
                else:
                    i = number[w]
                    own += ids[offs[i] : offs[i + 1]]
            out.append(own)
        return out

    def encode(self, text: str) -> list[int]:
        from .token_counts import pieces

        return [i for part in self.encode_pieces(pieces(text)) for i in part]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids`` between spaces, as this vocabulary, which has no decoder, is read."""
        return " ".join([self.tokens[i] for i in ids])


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_tokens, ids_sha256, decoded_sha256).

    Whole texts are split at ASCII white space; pieces that a task meets for the first time in a
    group of texts go through the merge rounds together, and their ids and decoded tokens are
    kept for later texts (KEPT pieces at most).

    Null or empty text: no tokens, digests of the empty string. Null ids, ties and repeated rows:
    each row stays by itself. A text without white space is one piece. Extra columns are ignored.
    Empty input gives no rows.
    """
    from .token_counts import pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        known: dict[str, tuple[int, str, str]] = {}
        for batch in batches:
            cols: list[list] = [[], [], []]
            for lo, hi, split in _text_groups(batch.column(1), pieces):
                new = list({p for own in split for p in own}.difference(known))
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = list({p for own in split for p in own})
                for p, ids in zip(new, bpe.encode_pieces(new)):
                    known[p] = (len(ids), " ".join(map(str, ids)), bpe.decode(ids))
                for own in split:
                    got = [known[p] for p in own]
                    cols[0].append(sum([g[0] for g in got]))
                    cols[1].append(hashlib.sha256(" ".join([g[1] for g in got if g[0]]).encode()).hexdigest())
                    cols[2].append(hashlib.sha256(" ".join([g[2] for g in got if g[0]]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def _text_groups(column: pa.Array, pieces, limit: int = 1 << 20):
    """(from, to, pieces of each text) for runs of about ``limit`` characters."""
    split, size, lo = [], 0, 0
    for i, x in enumerate(column):
        text = x.as_py() or ""
        split.append(pieces(text))
        size += len(text)
        if size >= limit:
            yield lo, i + 1, split
            split, size, lo = [], 0, i + 1
    if split:
        yield lo, lo + len(split), split


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
