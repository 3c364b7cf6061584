"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets whose sums meet in one window of :func:`global_rank`; these runs' sums meet in another.
RUN = 4096


def global_rank(df: DataFrame, groups: list[str], bucket: str, order: list, out: str, weight=None) -> DataFrame:
    """Adds the 0-based position (or, with ``weight``, the sum of weights before the row) within
    ``groups`` by (``bucket``, ``order``), without ever bringing a group into one task.

    ``bucket`` must be non-decreasing along the wanted order. Rows meet only those of their own
    bucket, bucket sums only those of their run of RUN buckets, and one row per (group, run) meets in
    the last window: a group of 1e11 rows in buckets of 1024 has 24,000 of them.
    """
    keys = [*groups, bucket]
    w = F.lit(1) if weight is None else F.col(weight)
    before = lambda c, by: F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = df.groupBy(*keys).agg(F.sum(w).cast("long").alias("_sum")).withColumn("_run", F.expr(f"`{bucket}` div {RUN}"))
    runs = sums.groupBy(*groups, "_run").agg(F.sum("_sum").alias("_of_run"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    runs = runs.withColumn("_start", before("_of_run", whole.orderBy("_run"))).drop("_of_run")
    sums = sums.withColumn("_off", before("_sum", Window.partitionBy(*groups, "_run").orderBy(bucket))).drop("_sum")
    offs = _joined(sums, runs, [*groups, "_run"]).select(*keys, (F.col("_off") + F.col("_start")).alias("_off"))
    inner = Window.partitionBy(*keys).orderBy(*order)
    own = F.row_number().over(inner) - 1 if weight is None else before(weight, inner)
    joined = _joined(df.withColumn("_in", own), offs, keys)
    return joined.withColumn(out, (F.col("_in") + F.col("_off")).cast("long")).drop("_in", "_off")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    out = left.join(right, [left[k].eqNullSafe(right[k]) for k in keys], "left")
    for k in keys:
        out = out.drop(right[k])
    return out
