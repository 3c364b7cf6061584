"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SEP_CLASS, discard, global_rank, hash_bucket, materialize, shuffle_hash, table

BUCKET_ROWS = 1024
#: Words in a block, at most; smaller mixes take smaller blocks, so that they too have SLOTS slots.
BLOCK, SLOTS = 1024, 1 << 20
#: Cells of the unit interval in which schedule points meet the sources' intervals.
CELLS = 1024
SLOT_RUN = 1 << 16
GOLDEN = 0.6180339887498949


def source_targets(base: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(sid, source, source_size, target) for each source of ``base(source, size)``.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight until none is above. That is a water level: sources sorted by the level at which they
    are full; the first which the level of the rest doesn't fill fixes it.
    """
    per = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    listed = per.withColumn("sid", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    listed = listed.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("full", F.col("cap") / F.col("w"))
    by_full = one.orderBy("full", "sid")
    up = by_full.rowsBetween(Window.unboundedPreceding, -1)
    down = by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(one) * share - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down)
    listed = listed.withColumn("k", F.row_number().over(by_full)).withColumn("level", level)
    first = F.min(F.when(F.col("full") > F.col("level"), F.struct("k", "level"))).over(one)
    listed = listed.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("cap")).otherwise(F.col("first.level") * F.col("w"))
    return listed.select("sid", "source", "source_size", target.cast("double").alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int, step: float = GOLDEN) -> DataFrame:
    """(sid, r, position): slot ``position`` falls to the source whose stretch of the cumulative targets
    (``sources``: sid, want) holds the fractional part of (position + 1) * step; r ranks a source's slots."""
    total = sources.agg(F.sum("want")).first()[0]
    if not n_slots or not total:
        return spark.createDataFrame([], "sid int, r long, position long")
    one = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    cum = sources.where("want > 0").select("sid", "want", F.sum("want").over(one).alias("to"))
    cum = cum.select("sid", ((F.col("to") - F.col("want")) / F.lit(float(total))).alias("lo"), (F.col("to") / F.lit(float(total))).alias("hi"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    stretches = cum.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    u = (F.col("k") + 1) * F.lit(step)
    points = spark.range(n_slots).withColumnRenamed("id", "k").withColumn("u", u - F.floor(u)).withColumn("cell", cell(F.col("u")))
    hit = points.join(stretches, "cell").where("u >= lo and u < hi")
    ranked = global_rank(hit.select("sid", "k", F.expr(f"k div {SLOT_RUN}").alias("run")), ["sid"], "run", [F.col("k")], "r")
    return ranked.select("sid", "r", F.col("k").alias("position"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int | None = None,
    step: float = GOLDEN,
) -> DataFrame:
    """One row per input row: (id, size, source_size, target, taken, copies, positions, places,
    crc, source).

    size: words ``[^\\x20\\x09-\\x0D]+`` of the text. Within a source the rows are laid end to end
    in a seeded shuffled order, ``most`` times over, and cut into blocks of ``block`` words. The
    schedule of (all targets / block) slots says how many blocks each source gives and where they
    stand: the blocks that join its slots are taken, no others. So the words taken of a source
    differ from its target by the few blocks that a low-discrepancy sequence strays. taken: words
    of the row in taken blocks, repeats counted; positions: the places in the schedule of these
    blocks, one for each piece of the row, ascending; copies: in how many passes the row's middle
    word is taken; places: the positions of these words' blocks, ascending.

    ``block`` None: all targets over SLOTS, from 1 to BLOCK words.

    Hot sources: offsets come from hash-range buckets, blocks join slots on (source, block).
    Null or empty text: size 0, taken 0, no positions; it is copied by the place where it stands.
    Null source: a source of its own, last. Null ids are shuffled by their texts' crc. Ties and
    repeated rows: ordered by crc; each row stays. Empty input gives no rows. Extra columns are
    ignored. Only column functions are used.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    base = materialize(
        docs.select(
            own.alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(f"[^{SEP_CLASS}]+")).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            shuffle_hash(seed, own, F.when(own.isNull(), F.crc32(text))).alias("h"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "mix-rows",
    )
    n_buckets = max(1, -(-base.count() // BUCKET_ROWS))
    sources = materialize(source_targets(base, weights, share, most).withColumn("want", F.round("target").cast("long")), "mix-sources")
    total = sources.agg(F.sum("want")).first()[0] or 0
    size = block or min(BLOCK, max(1, total // SLOTS))
    slots = materialize(schedule(spark, sources.select("sid", "want"), total // size, step), "mix-slots")
    keyed = base.join(
        sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s").withColumn("b", hash_bucket(F.col("h"), n_buckets))
    laid = materialize(
        global_rank(keyed, ["sid"], "b", [F.col("h"), F.col("doc_id"), F.col("crc"), F.col("uid")], "start", "size").drop("b"),
        "mix-laid",
    )
    discard(base)
    discard(sources)
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    piece = laid.select("uid", "sid", "size", "start", "source_size", passes)
    piece = piece.select("uid", "sid", "size", F.expr("pass * source_size + start").alias("a"), F.expr("pass * source_size + start + size").alias("z"))
    piece = piece.withColumn("r", F.explode(F.expr(f"sequence(a div {size}, greatest(a, z - 1) div {size})")))
    words = F.expr(f"least(z, (r + 1) * {size}) - greatest(a, r * {size})")
    # the middle word; a row without words has its place in the block where it stands
    middle = F.expr(f"(a + size div 2) div {size} = r")
    took = piece.select("uid", "sid", "r", words.alias("words"), middle.alias("middle")).join(slots, ["sid", "r"])
    taken = took.groupBy("uid").agg(
        F.sum("words").alias("taken"),
        F.sort_array(F.collect_list(F.when(F.col("words") > 0, F.col("position")))).alias("positions"),
        F.sort_array(F.collect_list(F.when(F.col("middle"), F.col("position")))).alias("places"),
    )
    none = F.array().cast("array<long>")
    return laid.join(taken, "uid", "left").select(
        F.col("doc_id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.size(F.coalesce("places", none)).alias("copies"),
        F.coalesce("positions", none).alias("positions"),
        F.coalesce("places", none).alias("places"),
        "crc",
        "source",
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", position: str | None = None, **options) -> DataFrame:
    """The rows of ``docs``, whole, each as often as the mix takes it (0 to ``most`` times). A copy stands where the
    schedule has the block of its middle word: ``position`` names a column for that place, by which a reader
    sorts who wants the mix's order. Rows come in no order, as files keep none.

    Rows that agree in id, source and text share one list of places. Columns stay as they are,
    whatever their names.
    """
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy(
        F.col(id_col).alias("id"), F.col("source").alias("src"), F.col("crc")
    ).agg(F.max(F.struct("copies", "places")).alias("most"))
    own = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("src"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("crc"),
    ).alias("o")
    plan = plan.where("most.copies > 0").alias("p")
    joined = own.join(plan, [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("id", "src", "crc")])
    repeated = joined.select("o.row", F.explode("p.most.places").alias("at"))
    return repeated.select("row.*", *([F.col("at").alias(position)] if position else []))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    first = F.when(F.size("positions") > 0, F.col("positions")[0])
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), F.size("positions").alias("n_blocks"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '::11') AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM per),
f AS (SELECT *, cap / w AS fullness FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (ORDER BY fullness, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fullness, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, row_number() OVER (ORDER BY fullness, sid) AS k FROM f),
fix AS (SELECT min(k) AS k, min_by(lev, k) AS lev FROM l WHERE fullness > lev),
s AS (SELECT sid, source, source_size, CASE WHEN fix.k IS NULL OR l.k < fix.k THEN cap ELSE fix.lev * w END AS target FROM l, fix),
want AS (SELECT *, CAST(round(target) AS BIGINT) AS want FROM s),
total AS (SELECT CAST(sum(want) AS BIGINT) AS total, least({BLOCK}, greatest(1, CAST(sum(want) AS BIGINT) // {SLOTS})) AS size FROM want),
cum AS (SELECT sid, (CAST(sum(want) OVER (ORDER BY sid) - want AS DOUBLE) / total) AS lo, (CAST(sum(want) OVER (ORDER BY sid) AS DOUBLE) / total) AS hi FROM want, total),
points AS (SELECT k, (k + 1) * {GOLDEN}::DOUBLE - floor((k + 1) * {GOLDEN}::DOUBLE) AS u FROM total, unnest(generate_series(0, total.total // total.size - 1)) AS t(k)),
won AS (SELECT sid, list(k ORDER BY k) AS ks FROM points JOIN cum ON u >= lo AND u < hi GROUP BY sid),
laid AS (SELECT doc_id, d.size, source_size, target, sid, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN want ON d.source IS NOT DISTINCT FROM want.source),
passes AS (SELECT doc_id, sid, p * source_size + start AS a, p * source_size + start + size AS z FROM laid, (VALUES (0), (1)) AS v(p) WHERE size > 0),
took AS (SELECT doc_id, greatest(0, least(z, len(ks) * total.size) - a) AS words, ks[CAST(a // total.size AS BIGINT) + 1:CAST((z - 1) // total.size AS BIGINT) + 1] AS ks
    FROM passes JOIN won USING (sid), total),
sums AS (SELECT doc_id, sum(words) AS taken, min(ks[1]) AS first_position, sum(len(ks)) AS n_blocks FROM took GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_position AS BIGINT) AS first_position,
  CAST(coalesce(n_blocks, 0) AS INTEGER) AS n_blocks FROM laid LEFT JOIN sums USING (doc_id)
"""
