"""Structured Streaming jobs over event logs.

Each takes a streaming frame and gives one; ``drain`` runs one over the files there are and reads what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import checkpointed


def event_stream(spark: SparkSession, path: str, name: str, per_trigger: int = 64) -> DataFrame:
    """The events of a Parquet file or folder, as a stream of its files."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", per_trigger)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in batch.inputFiles()[:1]):
        # a stream watches a folder: here the one that holds the file
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(path.rstrip("/").rpartition("/")[0])
    return reader.parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """(window start, keys, n): counts by event time; rows later than the watermark are dropped."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, ts: str, width: str, slide: str, late: str, *keys: str) -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n): runs of events no further apart than the gap."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def decayed_counters(events: DataFrame, key: str, ts: str, half_seconds: float) -> DataFrame:
    """(key, weight, at): a counter per key that halves in ``half_seconds`` and counts each event once, kept as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def update(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        weight, at = state.get if state.exists else (0.0, 0.0)
        for frame in frames:
            for t in sorted(frame[ts].astype("int64") // 1000 / 1e6):
                older = t < at
                weight = weight + 0.5 ** ((at - t) / half_seconds) if older else weight * 0.5 ** ((t - at) / half_seconds if at else 0.0) + 1.0
                at = max(at, t)
        state.update((weight, at))
        yield pd.DataFrame({key: [group[0]], "weight": [weight], "at": [at]})

    return events.select(key, ts).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, weight double, at double", "weight double, at double", "update", GroupStateTimeout.NoTimeout)


def delivered_ranges(requests: DataFrame, session: str, order: str, query: str, lo: str, hi: str, ttl: float) -> DataFrame:
    """Requests with ``seen``: whether an earlier, different query of the session, within the time to live, delivered the range.

    A delivery counts once another query of the session follows it, which is a lag over the session's order; the
    streamed form keeps the same two states.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(session).orderBy(order)
    changed = F.when(F.lag(query).over(by) == F.col(query), 0).otherwise(1)
    runs = requests.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = runs.select(F.col(session).alias("s"), F.col(order).alias("t"), F.col("_run").alias("r"), F.col(lo).alias("l"), F.col(hi).alias("h"))
    here = (F.col("s") == F.col(session)) & (F.col("l") <= F.col(lo)) & (F.col("h") >= F.col(hi)) & (F.col("r") < F.col("_run")) & (F.col(order) - F.col("t") <= ttl)
    found = runs.join(earlier, here, "left_semi").withColumn("seen", F.lit(True))
    rest = runs.join(earlier, here, "left_anti").withColumn("seen", F.lit(False))
    return found.unionByName(rest).drop("_c", "_run")


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over the files that are there and reads its output, from the shared folder."""
    spark = stream.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        checkpointed(spark.range(1))
    root = f"{context._jsc.sc().getCheckpointDir().get().rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return spark.range(0).toDF("id")
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{root}/out")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
