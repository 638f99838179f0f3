"""Streams: the screening rules per record, windowed counts and running tallies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.operators.distances import anchor_evidence, nearest_anchor
from cladeflow.operators.screening import ClockModel, divergence_z, predicted_date, status
from cladeflow.session import stored


def screen(records: DataFrame, m: ClockModel, anchors: DataFrame, taxon: str, divergence: str, date: str, seq: str) -> DataFrame:
    """records plus the evidence of their nearest anchors, status, predicted_date, z. anchors: taxon, date, seq, fixed
    for the run. Stateless, so the same call serves a table and a stream: a stream's result over all batches equals the table's."""
    x = anchor_evidence(records, anchors, taxon, seq, date)
    missing = F.length(F.regexp_replace(F.upper(seq), "[ACGTU]", ""))
    st = status(m, F.col(date), F.try_divide(missing, F.length(seq)), missing, F.col(divergence), F.col("nn"), F.col("nn_date"), F.col("left_d"), F.col("right_d"), F.col("halves_differ"), F.col("halves_gap"), F.length(seq))
    return x.withColumn("status", st).withColumn("predicted_date", predicted_date(F.col(divergence), m)).withColumn("z", divergence_z(F.col(divergence), F.col(date), m))


def nearest_in_stream(records: DataFrame, anchors: DataFrame, taxon: str, seq: str) -> DataFrame:
    """Nearest anchor of each streamed record; anchors are fixed for the run."""
    return nearest_anchor(records, anchors, taxon, seq)


def windowed_counts(events: DataFrame, time: str, kind: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and kind; rows more than `late` behind the newest are dropped."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, length, slide), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def running_tally(screened: DataFrame, key: str) -> DataFrame:
    """key, seen, flagged: totals kept in the state store, updated by every batch."""
    def count(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, flagged = state.get if state.exists else (0, 0)
        for f in frames:
            seen += len(f)
            flagged += int((f["status"] != "PASS").sum())
        state.update((seen, flagged))
        yield pd.DataFrame({"key": [str(group[0])], "seen": [seen], "flagged": [flagged]})

    return screened.groupBy(key).applyInPandasWithState(count, "key string, seen long, flagged long", "seen long, flagged long", "update", "NoTimeout")


def run_to_table(stream: DataFrame, checkpoint: str, mode: str = "append", map_batch=None) -> DataFrame:
    """Run a stream over everything that is there and return its rows (complete mode: the last
    state). Every batch is written once as a table; a restart goes on from the checkpoint."""
    spark: SparkSession = stream.sparkSession
    batches: dict[int, DataFrame] = {}

    def keep(df: DataFrame, batch: int) -> None:
        batches[batch] = stored(map_batch(df) if map_batch else df)

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return batches[max(batches)]
    out = None
    for k in sorted(batches):
        out = batches[k] if out is None else out.unionByName(batches[k])
    return out


