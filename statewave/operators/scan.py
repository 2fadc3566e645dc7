"""Ordered prefix products over the blocks of a recording.

Filters and hidden Markov models are recurrences, yet inside a block their effect on the
running state is one small matrix. Multiplying those matrices in block order gives the
state at every block border. Runs of ``fanout`` blocks are multiplied first, then runs of
runs, so a task sees at most ``fanout`` matrices however long a recording is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.functions.arrays import list_column, rows_of
from statewave.functions.semiring import product
from statewave.operators.blocks import REC

FANOUT = 512


def block_scan(elements: DataFrame, lead: tuple[int, ...], dim: int, algebra: str,
               max_blocks: int, reverse: bool = False, fanout: int = FANOUT) -> DataFrame:
    """State vector entering every block.

    ``elements`` has ``recording_id, block, start, m``: ``m`` is the flattened
    ``lead x dim x dim`` matrix of the block (row vector times matrix) and ``start`` the
    flattened ``lead x dim`` vector that enters the first block (null elsewhere). With
    ``reverse`` the walk goes from the last block down. ``max_blocks`` is the largest number
    of blocks of any recording; it decides how many levels are needed. The result has
    ``recording_id, block, carry``.
    """
    order = -F.col("block") if reverse else F.col("block")
    level = elements.select(REC, "block", order.alias("at"), "start", "m")
    return _scan(level, lead, dim, algebra, max_blocks, fanout).select(REC, "block", "carry")


def _scan(level: DataFrame, lead, dim: int, algebra: str, n: int, fanout: int) -> DataFrame:
    matrix, vector = (*lead, dim, dim), (*lead, dim)

    def along(keys: list[str], first: str):
        """Rows sorted by keys and place, any number of runs in a task: a run's state is carried on."""
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = state = None
            for batch in batches:
                out = []
                names = zip(*(batch.column(k).to_pylist() for k in keys))
                for name, begin, m in zip(names, rows_of(batch.column(first)), rows_of(batch.column("m"))):
                    if name != key:
                        key, state = name, begin.reshape(vector)
                    out.append(state.ravel())
                    state = product(state, m.reshape(matrix), algebra)
                yield pa.RecordBatch.from_arrays([batch.column(REC), batch.column("block"), list_column(out)],
                                                 names=[REC, "block", "carry"])
        return walk

    def walked(rows: DataFrame, keys: list[str], first: str) -> DataFrame:
        return rows.select(*keys, "block", "at", first, "m").repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(
            along(keys, first), schema)

    schema = f"{REC} string, block bigint, carry array<double>"
    if n <= fanout:
        return walked(level, [REC], "start")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        starts = pdf["start"].dropna()
        total = np.asarray(pdf["m"].iloc[0]).reshape(matrix)
        for m in pdf["m"].iloc[1:]:
            total = product(total, np.asarray(m).reshape(matrix), algebra)
        return pd.DataFrame({
            REC: [pdf[REC].iloc[0]], "block": [pdf["run"].iloc[0]], "at": [pdf["run"].iloc[0]],
            "start": [starts.iloc[0] if len(starts) else None], "m": [total.ravel()]})

    runs = level.withColumn("run", F.floor(F.col("at") / F.lit(float(fanout))).cast("bigint"))
    coarse = runs.groupBy(REC, "run").applyInPandas(
        multiply, f"{REC} string, block bigint, at bigint, start array<double>, m array<double>")
    entry = _scan(coarse, lead, dim, algebra, -(-(n - 1) // fanout) + 1, fanout).select(
        REC, F.col("block").alias("run"), F.col("carry").alias("carry_in"))
    return walked(runs.join(entry, [REC, "run"]), [REC, "run"], "carry_in")


def both_ways(elements: DataFrame, lead: tuple[int, ...], dim: int, algebra: str) -> DataFrame:
    """``recording_id, block, enter, leave``: states that enter every block from both sides.

    As two calls of ``block_scan``, for recordings of at most ``FANOUT`` blocks. ``elements`` has
    ``recording_id, block, start, m``; the way back uses the transposed matrices and begins with zeros.
    """
    matrix, vector = (*lead, dim, dim), (*lead, dim)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        hops = [np.asarray(m).reshape(matrix) for m in pdf["m"]]
        state, enter = np.asarray(pdf["start"].iloc[0], dtype=float).reshape(vector), []
        for m in hops:
            enter.append(state.ravel())
            state = product(state, m, algebra)
        state, leave = np.zeros(vector), []
        for m in hops[::-1]:
            leave.append(state.ravel())
            state = product(state, np.swapaxes(m, -1, -2), algebra)
        return pd.DataFrame({REC: pdf[REC], "block": pdf["block"], "enter": enter, "leave": leave[::-1]})

    return elements.groupBy(REC).applyInPandas(
        walk, f"{REC} string, block bigint, enter array<double>, leave array<double>")
