"""Streaming jobs: deduplicated ingest, latest state of links, and the check state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkcatalog.operators import ingest
from linkcatalog.storage import new_path

STATE = "link long, checks long, status string, attempts int, flips int"


def dedupe_messages(posts: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first post of each key within the watermark: state stays as small as the delay."""
    return posts.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"))


def check_machine(checks: DataFrame) -> DataFrame:
    """Per link the checks seen, the last status, how often in a row, and changes of validity.

    ``checks``: link, check_id, checked_at, status. Within a batch checks go by time and id.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, status, attempts, flips = state.get if state.exists else (0, "", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["checked_at", "check_id"])
        for new in rows["status"]:
            flips += (new == "valid") != (status == "valid")
            attempts = attempts + 1 if new == status else 1
            n, status = n + 1, new
        state.update((n, status, int(attempts), int(flips)))
        yield pd.DataFrame({"link": [key[0]], "checks": [n], "status": [status], "attempts": [attempts], "flips": [flips]})

    return checks.groupBy("link").applyInPandasWithState(
        fold, STATE, "checks long, status string, attempts int, flips int", "update", GroupStateTimeout.NoTimeout
    )


def ingest_batches(read_stored: Callable[[int], DataFrame], write: Callable[[DataFrame, int], None], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new posts against stored hashes; only created rows are written, by ``write(rows,
    epoch)``, which a retried batch calls again with the same rows (it overwrites what the epoch wrote)."""

    def run(batch: DataFrame, epoch: int) -> None:
        write(ingest.created_rows(batch, ingest.ingest_many(batch, read_stored(epoch), order), order), epoch)

    return run


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there, batch by batch into Parquet in the shared folder with its
    checkpoint beside it, and reads the result. A batch has a folder of its own that a retry
    overwrites; mode ``complete`` keeps the last batch alone."""
    spark = stream.sparkSession
    at = new_path(spark, name)
    last: dict[str, int] = {}

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
        last["epoch"] = epoch

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if "epoch" not in last:
        return spark.createDataFrame([], stream.schema)
    one = f"{at}/out/epoch={last['epoch']}" if mode == "complete" else f"{at}/out"
    return spark.read.schema(stream.schema).parquet(one)
