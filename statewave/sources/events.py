"""Event tables as regularly sampled recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewave.operators.index import dense_index

EVENT_FS = 10.0


def events_signal(spark: SparkSession, folder: str, by: str = "table") -> DataFrame:
    """The events table as ``recording_id, sample_idx, eeg, emg``.

    ``by="table"`` is one long recording (``event_id`` is already dense); ``by="user"``
    makes every user a recording and numbers that user's events in ``event_id`` order.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    eeg = F.col("value").cast("double").alias("eeg")
    emg = F.get_json_object("props", "$.k").cast("double").alias("emg")
    if by == "table":
        return events.select(F.lit("all").alias("recording_id"),
                             F.col("event_id").alias("sample_idx"), eeg, emg)
    keyed = events.select(F.col("user_id").cast("string").alias("recording_id"), "event_id",
                          eeg, emg)
    return dense_index(keyed, "recording_id", "event_id", "sample_idx").select(
        "recording_id", "sample_idx", "eeg", "emg")
