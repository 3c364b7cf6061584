"""Lines that many documents share stay in one of them; what stays is told by keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, table

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that may be taken for hot at once, at most, and rows of the sample that tells them. A key is hot if it has
#: over 1 / HOT_KEYS of the sample and HOT_LEAST rows, so there are never more, whatever the input.
HOT_KEYS, HOT_SAMPLE, HOT_LEAST = 1 << 16, 1 << 24, 32
_KEY = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def mark_lines(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, pos, h1, h2): a row for each line whose key has ``least_chars`` code points. th tells texts
    apart, h1 and h2 are the key's 128-bit hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _SMALL))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(_lines(low)).alias("pos", "line"))
    keyed = rows.where(F.octet_length("line") >= least_chars).select("doc_id", "th", "pos", F.btrim("line", F.lit(_BLANKS)).alias("key"))
    keyed = keyed.where(F.length("key") >= least_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def hot_keys(marks: DataFrame) -> DataFrame:
    """The keys with a large share of a sample of the marks: HOT_KEYS at most. They only take another way."""
    n = marks.count()
    rate = min(1.0, HOT_SAMPLE / max(1, n))
    least = max(HOT_LEAST, int(n * rate * 1.1) // HOT_KEYS + 1)
    return marks.sample(rate, seed=5).groupBy(*_KEY).count().where(F.col("count") >= least).select(*_KEY)


def shared_lines(marks: DataFrame, least_docs: int) -> DataFrame:
    """(doc_id, th, pos) of the lines that go: their key is in ``least_docs`` documents and this one's id isn't the
    largest of them.

    Marks are range-partitioned by hash and sorted by document, largest first, and position within it; one
    stream over a key's run meets its first occurrence, which stays, before the others. Keys of a large
    share of all lines never meet in one place: counts and largest ids of theirs are aggregated in the tasks
    first and come back by a broadcast of HOT_KEYS rows at most.
    """
    hot = materialize(hot_keys(marks), "hot-lines")
    cold = marks.join(F.broadcast(hot), _KEY, "left_anti").repartitionByRange("h1")
    run = Window.partitionBy(*_KEY)
    by = run.orderBy(F.col("doc_id").desc_nulls_last(), "th", "pos")
    fresh = ~(F.lag("th").over(by).eqNullSafe(F.col("th")) & F.lag("doc_id").over(by).eqNullSafe(F.col("doc_id")))
    streamed = cold.withColumn("fresh", fresh).withColumn("largest", F.first("doc_id").over(by))
    streamed = streamed.withColumn("n_docs", F.sum(F.col("fresh").cast("int")).over(run))
    found = streamed.where((F.col("n_docs") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("largest"))).select("doc_id", "th", "pos")
    of_hot = marks.join(F.broadcast(hot), _KEY)
    totals = of_hot.groupBy(*_KEY, "doc_id", "th").agg(F.lit(1).alias("one")).groupBy(*_KEY)
    totals = totals.agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest")).where(F.col("n_docs") >= least_docs)
    gone = of_hot.join(F.broadcast(totals), _KEY).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    return found.union(gone.select("doc_id", "th", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_dropped, keep): for each document that loses lines, which ones stay.

    keep: array of (word, bits) by word: bit b of ``bits`` tells whether line 64 * word + b stays. Words of
    lines that all stay are left out, so a bitmap is as long as what it drops.
    """
    marks = materialize(mark_lines(docs, least_chars, id_col, text_col), "line-marks")
    lost = shared_lines(marks, least_docs).select("doc_id", "th", F.expr("pos div 64").cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = lost.groupBy("doc_id", "th", "word").agg(F.bit_or("bit").alias("bits"))
    kept = F.struct("word", F.bitwise_not("bits").alias("bits"))
    maps = words.groupBy("doc_id", "th").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(kept)).alias("keep"))
    maps = materialize(maps, "keep-bitmaps")
    discard(marks)
    return maps


def _every_word(keep: Column) -> Column:
    """The bits of each word from 0 to the last one told."""
    gap = lambda w, i: w["word"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"]) - 1
    return F.flatten(F.transform(keep, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(w, i)), F.array(w["bits"]))))


def drop_shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of ``docs`` as a struct, whatever its columns' names, its lines
    counted, those dropped counted, and the text of the others.

    Texts are split at line feeds. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
    lower-cased. Keys of at least ``least_chars`` code points found in at least ``least_docs`` documents lose all
    their lines except in the largest id holding them, which keeps all of its own.

    Null or empty text: one empty line. Rows that agree in id and text are one document. Null ids are below
    all others; rows that share the largest id all keep the line, and so do null ids where no other holds
    it. Empty input gives no rows. Only column functions are used.
    """
    maps = keep_bitmaps(docs, least_chars, least_docs, id_col, text_col)
    maps = maps.select("doc_id", "th", "n_dropped", _every_word(F.col("keep")).alias("bits")).hint("shuffle_hash")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own"), F.xxhash64(text).alias("own_th"))
    joined = own.join(maps, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_th") == F.col("th")), "left")
    lines = _lines(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))

    def stays(_, i):
        word = F.coalesce(F.get("bits", F.call_function("div", i, F.lit(64)).cast("int")), F.lit(-1).cast("long"))
        return F.call_function("getbit", word, i % 64) == 1

    kept = F.when(F.col("bits").isNull(), F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_SMALL}') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS largest FROM (SELECT DISTINCT key, doc_id, text FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
j AS (SELECT k.*, shared.key IS NOT NULL AND k.doc_id IS DISTINCT FROM largest AS gone FROM k LEFT JOIN shared ON k.key = shared.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY r
"""
