"""Token counts: batches balanced by bytes, texts split at safe boundaries, lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "word_bpe_49k.json"
#: Bytes that one call of the library gets, about.
CALL_BYTES = 1 << 16
#: Characters of texts whose new pieces are encoded together, about.
GROUP = 1 << 20
#: Pieces whose lengths a task keeps, and characters of them, at most; then it starts anew. Longer pieces than LONG aren't kept.
KEPT, KEPT_CHARS = 400_000, 8 << 20
#: White space is dropped by this vocabulary's splitter and joins with nothing, neither in
#: normal forms nor in special tokens: a text's count is the sum over its pieces between.
_PIECES = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_SPLIT = re.compile(r"[\x1c-\x1f\x85]")


def pieces(text: str) -> list[str]:
    """Runs between white space, ASCII only where the text has control characters that str.split
    takes for white space and the vocabulary doesn't."""
    return _PIECES.findall(text) if _NOT_SPLIT.search(text) else text.split()


#: Characters beyond which a run without white space is cut, and where: around ASCII digits, each of which this
#: vocabulary's splitter takes alone, next to ASCII letters or digits, which no normal form joins.
LONG = 4096
_CUT = re.compile(r"(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def cut_long(own: list[str]) -> list[str]:
    """Pieces of which those of more than LONG characters are cut at safe places, into some LONG characters each.
    A run without such a place (one word to the vocabulary, whose merges may span it) stays whole."""
    if not any(len(x) > LONG for x in own):
        return own
    out = []
    for x in own:
        at = 0
        if len(x) > LONG:
            for m in _CUT.finditer(x):
                if m.start() - at >= LONG:
                    out.append(x[at : m.start()])
                    at = m.start()
        out.append(x[at:])
    return out


def _open(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _balanced(new: list[str]) -> Iterator[list[str]]:
    """Calls of about CALL_BYTES bytes each, long pieces together."""
    new.sort(key=len)
    held, size = [], 0
    for x in new:
        held.append(x)
        size += len(x) + 8
        if size >= CALL_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _groups(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_tokens(
    docs: DataFrame, limit: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: (id, n_bytes, n_tokens, over_limit).

    n_tokens is what the tokenizers library gives for the whole text without added special
    tokens, truncation or padding; special strings inside a text count as the library takes
    them. Texts are split at ASCII white space; the pieces of a group of texts that a task meets for the
    first time go to the library in calls of CALL_BYTES each, pieces of like length together; their lengths
    are kept and added up. Runs of more than LONG
    characters without white space are cut around digits.

    Null or empty text: 0 bytes, 0 tokens. Null ids, ties and repeated rows: each row is counted by
    itself. Extra columns are ignored. Empty input gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _open(path)
        known: dict[str, int] = {}
        room = 0
        for batch in batches:
            sizes, counts = [], []
            for texts in _groups(batch.column(1)):
                split = [cut_long(pieces(text)) for text in texts]
                wanted = set().union(*split)
                new = list(wanted.difference(known))
                if len(known) + len(new) > KEPT or room > KEPT_CHARS:
                    known, room, new = {}, 0, list(wanted)
                for call in _balanced(new):
                    known.update(zip(call, map(len, tokenizer.encode_batch_fast(call, add_special_tokens=False))))
                sizes += [len(text.encode("utf-8", "surrogatepass")) for text in texts]
                counts += [sum(map(known.__getitem__, own)) for own in split]
                room += sum(map(len, new))
                while new and len(new[-1]) > LONG:  # they stand last, by their length
                    room -= len(new[-1])
                    del known[new.pop()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("doc_id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
