"""Search over works: filters, keyword backends, order, paging, and links of the hits."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Media types that a search without a type shows.
DEFAULT_TYPES = ("movie", "tv", "anime", "variety", "documentary", "unknown")
TRIGRAM_THRESHOLD = 0.2


def key_column(text: Column) -> Column:
    """Lower-case letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    pieces = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(pieces))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def filter_works(
    works: DataFrame,
    media: DataFrame,
    bridge: DataFrame,
    resources: DataFrame,
    media_types: tuple[str, ...] | None = None,
    year: int | None = None,
    valid_only: bool = False,
    provider: str | None = None,
    include_empty: bool = False,
) -> DataFrame:
    """``valid_only`` and ``provider`` are separate semi-joins: different links may satisfy them.
    Without either, works that have no link at all are left out unless ``include_empty``."""
    out = works.where(F.col("media_type").isin(*(media_types or DEFAULT_TYPES)))
    if year is not None:
        out = out.where(F.col("year") == year)
    seasons = media.select("media_id", "work_id")

    def having(links: DataFrame) -> DataFrame:
        return links.join(seasons, "media_id").select("work_id")

    if valid_only:
        good = resources.where("check_status = 'valid'").select("resource_id")
        out = out.join(having(bridge.join(good, "resource_id", "left_semi")), "work_id", "left_semi")
    if provider:
        own = resources.where(F.col("provider") == provider).select("resource_id")
        out = out.join(having(bridge.join(own, "resource_id", "left_semi")), "work_id", "left_semi")
    if not (valid_only or provider or include_empty):
        out = out.join(having(bridge), "work_id", "left_semi")
    return out


def search_like(works: DataFrame, keyword: str, limit: int, offset: int = 0) -> DataFrame:
    """Title or key contains the keyword, newest first; the keyword's characters are literal."""
    hit = F.contains(F.lower("title"), F.lower(F.lit(keyword))) | F.contains(F.col("norm_key"), key_column(F.lit(keyword)))
    return (works.where(hit) if keyword else works).orderBy(F.desc("work_id")).offset(offset).limit(limit)


def search_trgm(works: DataFrame, keyword: str, limit: int, offset: int = 0) -> DataFrame:
    """Similar or containing, most similar first."""
    key = key_column(F.lit(keyword))
    out = works.withColumn("score", similarity(F.col("norm_key"), key))
    hit = (F.col("score") >= TRIGRAM_THRESHOLD) | F.contains("norm_key", key) | F.contains(F.lower("title"), F.lower(F.lit(keyword)))
    return out.where(hit).orderBy(F.desc("score"), F.desc("work_id")).offset(offset).limit(limit)


#: Folders into which stored postings are dealt by their trigrams.
POSTING_PARTS = 64


def trigram_postings(works: DataFrame, text: str) -> DataFrame:
    """(work_id, n, trigram, part): n counts the work's trigrams, part is the folder of the trigram."""
    own = works.select("work_id", trigrams(F.col(text)).alias("t"))
    rows = own.select("work_id", F.size("t").alias("n"), F.explode("t").alias("trigram"))
    return rows.withColumn("part", (F.crc32("trigram") % POSTING_PARTS).cast("int"))


def store_postings(works: DataFrame, text: str, path: str) -> DataFrame:
    """Writes the postings once, by part and sorted by trigram within, and reads them."""
    rows = trigram_postings(works, text).repartition("part").sortWithinPartitions("part", "trigram")
    rows.write.partitionBy("part").parquet(path)
    return works.sparkSession.read.parquet(path)


def search_postings(postings: DataFrame, keyword: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """(work_id, score) of the works that are similar enough, from the postings of the keyword's few
    trigrams alone: their parts are the folders that are read, the trigrams a filter pushed to the scan;
    counts are combined before the shuffle. Shared and own counts give the same similarity as
    :func:`similarity`."""
    wanted = postings.sparkSession.range(1).select(trigrams(F.lit(keyword)).alias("t")).first()["t"]
    parts = sorted({zlib.crc32(t.encode()) % POSTING_PARTS for t in wanted})
    own = postings.where(F.col("part").isin(*parts) & F.col("trigram").isin(*wanted))
    hits = own.groupBy("work_id", "n").agg(F.count("*").alias("both"))
    score = F.col("both") / (F.col("n") + len(wanted) - F.col("both"))
    return hits.select("work_id", score.alias("score")).where(F.col("score") >= threshold)


def top_links(bridge: DataFrame, resources: DataFrame, k: int = 5) -> DataFrame:
    """Per season the ``k`` first links: valid ones first, then the newest."""
    order = Window.partitionBy("media_id").orderBy(F.when(F.col("check_status") == "valid", 0).otherwise(1), F.desc("resource_id"))
    return bridge.join(resources, "resource_id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def work_detail(works: DataFrame, media: DataFrame) -> DataFrame:
    """Each work with its seasons in order."""
    seasons = media.groupBy("work_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("season", "media_id"))), lambda s: F.concat_ws(":", s["season"].cast("string"), s["media_id"].cast("string"))), ",").alias("seasons"),
        F.count("*").alias("n_seasons"),
    )
    return works.join(seasons, "work_id", "left").withColumn("n_seasons", F.coalesce("n_seasons", F.lit(0)))


def keyset_page(rows: DataFrame, ts: str, key: str, after_ts, after_key: int, size: int) -> DataFrame:
    """The page after (``after_ts``, ``after_key``) in the order ``ts`` nulls first, ``key``."""
    t, k = F.col(ts), F.col(key)
    if after_ts is None:
        after = (t.isNull() & (k > after_key)) | t.isNotNull()
    else:
        after = (t > after_ts) | ((t == after_ts) & (k > after_key))
    return rows.where(after).orderBy(t.asc_nulls_first(), k).limit(size)
