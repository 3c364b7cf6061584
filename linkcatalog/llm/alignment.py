"""Two tokenizers aligned over one corpus: how often each pair of their tokens covers the same bytes."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import materialize, table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments whose alignment a task keeps, at most, and the bytes that these take, about; then it starts anew.
KEPT, KEPT_BYTES = 400_000, 120 << 20
#: Characters of texts that are aligned together, and of segments that go to a tokenizer in one string, about.
GROUP, CALL = 1 << 20, 1 << 16
#: Pairs whose partial counts a task holds before it hands them on, and links that it gathers before it sums them up.
PAIRS, LINKS = 1 << 20, 1 << 21
#: A space after anything but white space. No token of A spans it, as its splitter starts a piece there, nor one of B,
#: whose pieces have spaces in front alone.
_CUT = re.compile(r"(?<=\S)(?= )")
#: The letter by which B writes a space.
_B_SPACE = "▁"


class Aligned:
    """Segments with their tokens and groups as columns: ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` of each, the
    links of all end to end, the groups' text of each; ``good``: whether its tokens join to its bytes."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = np.zeros(0, np.int64)
        self.links, self.good, self.groups = np.zeros(0, np.int64), np.zeros(0, bool), []

    def add(self, parts: list[Aligned]) -> None:
        for name in ("n_a", "n_b", "n_groups", "n_links", "links", "good"):
            setattr(self, name, np.concatenate((getattr(self, name), *[getattr(p, name) for p in parts])))
        for p in parts:
            self.groups += p.groups


class Aligner:
    """Both vocabularies, and the alignment of many segments at once."""

    def __init__(self, path_a: str | None, path_b: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        if path_a is None or path_b is None:
            import public_tokenizers

            path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {x: i for i, x in enumerate(byte_letters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_B_SPACE, " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(_B_SPACE)
        #: whether segments may be cut off at all
        self.cuts = not any(_B_SPACE in self.b.id_to_piece(i).lstrip(_B_SPACE) for i in range(len(self.bytes_b)))
        # each id as text with what stands behind it: a comma, a bar after the last of A, a semicolon after the last of B
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        self.marked = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.width)]
        self.marked_size = np.array([len(x) for x in self.marked], np.int64)

    def segments(self, text: str) -> list[str]:
        """The space and the text, cut where no token of either vocabulary goes on."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def _ids(self, segments: list[str]) -> tuple[list[int], list[int]]:
        """Ids of both for segments end to end: as one string where all end in anything but white space, so that no
        token of either goes on from one to the next, else one by one."""
        if not segments[0][-1].isspace():
            segments = ["".join(segments)]
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        b = [ids if len(s) > 1 else [self.space] for s, ids in zip(segments, b)]
        return list(itertools.chain.from_iterable(a)), list(itertools.chain.from_iterable(b))

    def align(self, segments: list[str]) -> list[Aligned]:
        """All segments, in their order; those that end in white space come last."""
        out: list[Aligned] = []
        held: list[str] = []
        size = 0
        for s in segments:
            if held and (size >= CALL or s[-1].isspace() != held[-1][-1].isspace()):
                self._align(held, out)
                held, size = [], 0
            held.append(s)
            size += len(s)
        if held:
            self._align(held, out)
        return out

    def _align(self, segments: list[str], out: list[Aligned]) -> None:
        """Both token sequences cut the same bytes. Between neighbouring ends of either lies one token of each,
        and two tokens that overlap do so in one such stretch: the stretches are the links, and the ends
        that both share close the groups. Where tokens do not join to the bytes the halves are tried alone."""
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        ids_a, ids_b = self._ids(segments)
        whole = b"".join(raw)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            if len(segments) > 1:
                half = len(segments) // 2
                self._align(segments[:half], out)
                self._align(segments[half:], out)
                return
            bad = Aligned()
            bad.n_a = bad.n_b = bad.n_groups = bad.n_links = np.zeros(1, np.int64)
            bad.good, bad.groups = np.zeros(1, bool), [b""]
            out.append(bad)
            return
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        stretch = both[np.flatnonzero(np.diff(both, append=-1))]
        at_a, at_b = np.searchsorted(end_a, stretch), np.searchsorted(end_b, stretch)
        close = stretch[(end_a[at_a] == stretch) & (end_b[at_b] == stretch)]
        until = np.cumsum([len(x) for x in raw])
        count = lambda ends: np.diff(np.searchsorted(ends, until, "right"), prepend=0)
        made = Aligned()
        made.n_a, made.n_b, made.n_groups, made.n_links = count(end_a), count(end_b), count(close), count(stretch)
        made.links, made.good = a[at_a] << 32 | b[at_b], np.ones(len(raw), bool)
        # ids as text: those of A and then those of B, group by group
        of_a, of_b = np.searchsorted(close, end_a), np.searchsorted(close, end_b)
        words = np.concatenate((a + self.width * (close[of_a] == end_a), b + 2 * self.width * (close[of_b] == end_b)))
        words = words[np.argsort(np.concatenate((2 * of_a, 2 * of_b + 1)), kind="stable")]
        text = b"".join([self.marked[w] for w in words.tolist()])
        cuts = np.concatenate(([0], np.cumsum(self.marked_size[words])))[np.concatenate(([0], np.cumsum(made.n_a + made.n_b)))].tolist()
        made.groups = [text[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        out.append(made)


class Cache:
    """Alignments of the segments that a task has met."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.all = Aligned()
        self.room = 0

    def numbers(self, wanted: list[str]) -> np.ndarray:
        """The row in ``all`` of each segment, in order; new ones are aligned together."""
        number = self.number
        new = [s for s in dict.fromkeys(wanted) if s not in number]
        if len(number) + len(new) > KEPT or self.room > KEPT_BYTES:
            self.clear()
            number = self.number
            new = list(dict.fromkeys(wanted))
        if new:
            new.sort(key=lambda s: s[-1].isspace())
            links = len(self.all.links)
            self.all.add(self.aligner.align(new))
            self.room += 8 * (len(self.all.links) - links) + sum(map(len, self.all.groups[len(number) :])) + 4 * sum(map(len, new)) + 250 * len(new)
            number.update(zip(new, range(len(number), len(number) + len(new))))
        return np.fromiter(map(number.__getitem__, wanted), np.int64, len(wanted))


def aligned_texts(cache: Cache, column: pa.Array) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[str]]]:
    """For groups of texts: (n_a, n_b, n_groups, n_links of each text; pairs; how many links each text has; digest of
    each text's groups). A null, empty or untrue text has none. A text with a segment whose tokens do not join to its
    bytes is aligned once more as one segment, which decides."""
    for texts in _text_groups(column):
        split = [cache.aligner.segments(t) if t else [] for t in texts]
        rows = cache.numbers([s for own in split for s in own])
        ends = np.cumsum([len(own) for own in split])
        good = cache.all.good[rows]
        if not good.all():
            # one segment each, if that is true; else none
            bad = np.unique(np.searchsorted(ends, np.flatnonzero(~good), "right")).tolist()
            for k in bad:
                split[k] = [" " + texts[k]]
            rows = cache.numbers([s for own in split for s in own])
            ends = np.cumsum([len(own) for own in split])
            good = cache.all.good[rows]
            doc = np.searchsorted(ends, np.flatnonzero(good), "right")
            rows, ends = rows[good], np.searchsorted(doc, np.arange(len(split)), "right")
        held = cache.all
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        per = lambda x: _sums(x[rows], starts, ends)
        counts = [per(held.n_a), per(held.n_b), per(held.n_groups), per(held.n_links)]
        n = held.n_links[rows]
        begin = np.cumsum(held.n_links) - held.n_links
        pairs = held.links[np.arange(n.sum()) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)]
        digests, listed = [], rows.tolist()
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            digests.append(hashlib.sha256(b"".join([held.groups[i] for i in listed[lo:hi]])[:-1]).hexdigest() if hi > lo else "")
        yield counts, pairs, counts[3], digests


def _sums(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x)))
    return total[ends] - total[starts]


def _text_groups(column: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


# Links as they are stored: the different pairs of a text, ascending, by their steps, byte by byte of these, and how often
# each stands.


def packed(pairs: np.ndarray, each: np.ndarray) -> list[bytes]:
    """One value for each text; ``each``: links of each text, whose pairs stand end to end."""
    doc = np.repeat(np.arange(len(each)), each)
    order = np.lexsort((pairs, doc))
    pairs, doc = pairs[order], doc[order]
    first = np.flatnonzero((np.diff(pairs, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    times = np.diff(np.append(first, len(pairs)))
    pairs, doc = pairs[first], doc[first]
    # 47 bits hold both ids: 24 of A, 23 of B
    pairs = (pairs >> 32) << 23 | pairs & 0x7FFFFF
    steps = np.diff(pairs, prepend=0)
    fresh = np.flatnonzero(np.diff(doc, prepend=-1))
    steps[fresh] = pairs[fresh]
    cuts = np.searchsorted(doc, np.arange(len(each) + 1)).tolist()
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        planes = steps[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6].T
        out.append(np.ascontiguousarray(planes).tobytes() + times[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    return out


def unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times) of a text."""
    n = len(value) // 10
    data = np.frombuffer(value, np.uint8)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = data[: 6 * n].reshape(6, n).T
    pairs = np.cumsum(steps.view(np.int64).ravel())
    times = np.ascontiguousarray(data[6 * n :].reshape(4, n).T).view("<u4").ravel()
    return (pairs >> 23) << 32 | pairs & 0x7FFFFF, times.astype(np.int64)


def align_texts(docs: DataFrame, id_col: str, text_col: str, path_a: str | None, path_b: str | None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links): each text through both tokenizers, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(Aligner(path_a, path_b))
        for batch in batches:
            at = 0
            for counts, pairs, each, digests in aligned_texts(cache, batch.column(1)):
                arrays = [batch.column(0).slice(at, len(digests)), *[pa.array(x, pa.int64()) for x in counts], pa.array(digests, pa.string()), pa.array(packed(pairs, each), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_COUNTS, "groups_sha256", "links"])
                at += len(digests)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, links binary")


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n) by pair within shards that cover ranges of it: A's id in the high and B's in the low half of
    ``pair``, n how many links hold them linked in all of ``aligned``.

    A task sums up its own links by np.unique and hands the sums on, some PAIRS at a time; the sums are sorted
    globally by ranges of the pair, and each run of one pair is summed up as it streams by.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for value in batch.column(0):
                parts.append(unpacked(value.as_py()))
                size += len(parts[-1][0])
                if size >= LINKS:
                    held, parts, size = _summed(held, parts), [], 0
                    if len(held[0]) >= PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["pair", "n"])
                        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        held = _summed(held, parts)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["pair", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pair = np.concatenate((pair, batch.column(0).to_numpy(zero_copy_only=False)))
            n = np.concatenate((n, batch.column(1).to_numpy(zero_copy_only=False)))
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            if len(first) > 1:
                total = np.add.reduceat(n, first)
                yield pa.RecordBatch.from_arrays([pa.array(pair[first][:-1]), pa.array(total[:-1])], names=["pair", "n"])
                pair, n = pair[first][-1:], total[-1:]
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(pair[:1]), pa.array([int(n.sum())], pa.int64())], names=["pair", "n"])

    sums = materialize(aligned.select("links").mapInArrow(partial, "pair long, n long"), "pair-sums")
    return sums.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(runs, "pair long, n long")


def _summed(held: list[np.ndarray], parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Partial sums with more links."""
    links, each = (np.concatenate([held[k], *[p[k] for p in parts]]) for k in (0, 1))
    pair, at = np.unique(links, return_inverse=True)
    return [pair, np.bincount(at, each, minlength=len(pair)).astype(np.int64)]


class CountShards:
    """The counts of all pairs as sorted shards, which a task maps into memory and searches.

    Spark brings the shards' Parquet files to each executor, from whatever store they are in; there the first
    task to need one unpacks it beside, and the others map the same file. So a task holds the pages that it
    touches. The shards are bounded by the product of the vocabularies, whatever the corpus.
    """

    def __init__(self, names: list[str]):
        self.shards = []
        for name in names:
            pair, n = self._open(name)
            if len(pair):
                self.shards.append((int(pair[-1]), pair, n))
        self.shards.sort(key=lambda x: x[0])
        self.last = np.array([x[0] for x in self.shards], np.int64)

    @staticmethod
    def _open(name: str) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq

        packed = SparkFiles.get(name)
        plain = f"{packed}.npy"
        if not os.path.exists(plain):
            found = pq.read_table(packed)
            both = np.stack([found[c].to_numpy().astype(np.int64) for c in ("pair", "n")])
            own = f"{plain}.{os.getpid()}.tmp"
            with open(own, "wb") as f:
                np.save(f, both)
            os.replace(own, plain)
        both = np.load(plain, mmap_mode="r")
        return both[0], both[1]

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        shard = np.searchsorted(self.last, pairs)
        for k in np.unique(shard):
            _, pair, n = self.shards[k]
            rows = np.flatnonzero(shard == k)
            out[rows] = n[np.searchsorted(pair, pairs[rows])]
        return out


def _share(spark: SparkSession, counts: DataFrame) -> list[str]:
    """The files of a stored table go to the executors; their names there."""
    names = []
    for file in counts.inputFiles():
        spark.sparkContext.addFile(file)
        names.append(file.rsplit("/", 1)[1])
    return names


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """One row per input row: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Each text, a space in front, is encoded by both vocabularies without special tokens. Tokens stand for bytes; where
    tokens of both end they cut the text into groups, and tokens whose bytes overlap are linked. A pair of ids
    counts how many links of the whole corpus hold it. n_best: links whose count is the highest that their B id
    has, ties included; count_sum: the counts of all links. groups_sha256 digests the groups' ids.

    Texts are cut into segments at spaces that no token spans; a task aligns each segment once, as long as it is
    kept. What comes of a text is stored with its links, about a byte for each of its characters, so that no text
    is encoded twice. B's best counts come to every task, one for each B id; all counts are looked up in
    CountShards.

    Null or empty texts, and those whose tokens of either do not join to the same bytes: zeros, digest ''. Null
    ids, ties and repeated rows: each row stays and counts. Empty input gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    aligned = materialize(align_texts(docs, id_col, text_col, path_a, path_b), "aligned-texts")
    counts = materialize(pair_counts(aligned), "pair-counts")
    best_of = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).collect()
    best = np.zeros(1 + max([b for b, _ in best_of], default=0), np.int64)
    for b, n in best_of:
        best[b] = n
    names = _share(spark, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = CountShards(names)
        for batch in batches:
            parts = [unpacked(x.as_py()) for x in batch.column(batch.schema.get_field_index("links"))]
            pairs, times = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))
            ends = np.cumsum([len(p[0]) for p in parts])
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            n = shards(pairs)
            top = times * (n == best[pairs & 0xFFFFFFFF])
            sums = [pa.array(_sums(x, starts, ends), pa.int64()) for x in (top, n * times)]
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *_COUNTS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*own[:5], *sums, own[5]], names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    kinds = ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS, "n_best", "count_sum"))
    return aligned.mapInArrow(run, f"{kinds}, groups_sha256 string").withColumnRenamed("doc_id", id_col)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
