"""Structured Streaming forms of the daily counts, windows, deduplication and triggers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import shared_folder


def stream_of(spark: SparkSession, folder: str, table: str, per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, with the schema that they have."""
    r = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}.parquet").schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as a timestamp, with the watermark; rows without one are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, late)


def windowed(events: DataFrame, ts: str, key: str, value: str, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """n, total per window and key. A trailing window of k days, both ends in, is one of k + 1 days that slides by one."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    x = timed(events, ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """start, end, n of every run of a key's events with less than ``gap`` between them."""
    x = timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_of(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row per keys, as long as repeats come within the watermark: state is kept no longer."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark(keys)


def alerts(events: DataFrame, key: str, ts: str, value: str, *, rows: int = 5, above: float = 0.0, cooldown: str = "1 day", late: str = "1 day", keep: str = "30 days") -> DataFrame:
    """key, ts, level whenever the mean of a key's last ``rows`` values rises above ``above`` and no alert of the key is younger than cooldown.

    State per key: its last values and the time of its last alert; a key of
    which nothing came for ``keep`` (cooldown at least) beyond the watermark is
    forgotten. Rows of a batch are taken in order of time, batches as they come;
    NULL values are passed over, rows later than the watermark dropped.
    """
    wait = pd.Timedelta(cooldown).value // 1000  # microseconds

    lasts = max(pd.Timedelta(keep), pd.Timedelta(cooldown)).value // 1_000_000  # milliseconds

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=[key, ts, "level"])
            return
        held, last = state.get if state.exists else ([], -(2**62))
        held = list(held)
        out = []
        batch = pd.concat(list(frames)).dropna(subset=[ts, value]).sort_values(ts, kind="stable")
        was = len(held) == rows and sum(held) / rows > above
        for t, v in zip(batch[ts], batch[value]):
            held = [*held, float(v)][-rows:]
            now = len(held) == rows and sum(held) / rows > above
            at = t.value // 1000
            if now and not was and at - last >= wait:
                out.append((k[0], t, sum(held) / rows))
                last = at
            was = now
        state.update((held, last))
        newest = int(batch[ts].iloc[-1].value // 1_000_000) if len(batch) else 0
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + lasts)
        yield pd.DataFrame(out, columns=[key, ts, "level"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    x = timed(events, ts, late).select(key, ts, value)
    return x.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} timestamp, level double", "held array<double>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for the files that are there now, as a table in the shared folder.

    "complete" overwrites with each batch, "append" adds to it; a batch that is
    done again after a failure writes the same rows in the same place.
    """
    spark = stream.sparkSession
    out, log = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    schema = stream.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
