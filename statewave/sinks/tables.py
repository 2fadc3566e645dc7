"""Spark writers for result tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

REC = "recording_id"


def write_table(df: DataFrame, path: Path, order: list[str], fmt: str = "csv",
                single: bool = True) -> Path:
    """Write a table in row order.

    A single recording is written without its id; several are partitioned by it, so one
    recording's rows can be read without the others.
    """
    if single:
        out = df.drop(REC).orderBy(*order) if order else df.drop(REC)
        out.write.mode("overwrite").option("header", True).format(fmt).save(str(path))
    else:
        keys = [REC, *order]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option(
            "header", True).partitionBy(REC).format(fmt).save(str(path))
    return path
