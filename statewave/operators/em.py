"""Expectation-maximisation by passes over the blocks of long recordings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewave.functions.arrays import list_column, rows_of
from statewave.operators.blocks import REC
from statewave.session import cut_lineage

#: Recordings whose sums a task holds at a time.
HELD = 64


def summed(rows: DataFrame, inputs: list[str], answer: Callable[..., np.ndarray], carried: list[str],
           finish: Callable[..., dict], schema: str) -> DataFrame:
    """One row per recording from the sum of what its blocks answer.

    ``answer`` turns a block's ``inputs`` into a vector and a task adds up those of its blocks, so a
    recording is a few rows when it is shuffled, the only time in a pass. ``carried`` are float arrays that
    are the same in all blocks; ``finish`` takes them and the sum and returns the columns of ``schema``.
    """
    names = list(dict.fromkeys([*inputs, *carried]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        part = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal part
            columns = [list_column(list(c)) for c in zip(*totals.values())]
            out = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([part] * len(totals), pa.int64()),
                                              *columns], names=[REC, "part", "v", *carried])
            part += 1
            totals.clear()
            return out

        for batch in batches:
            cells = {n: c.to_pylist() if pa.types.is_integer(c.type) else rows_of(c)
                     for n, c in zip(names, batch.columns[1:])}
            for i, name in enumerate(batch.column(0).to_pylist()):
                v = answer(*(cells[n][i] for n in inputs))
                if name in totals:
                    totals[name][0] += v
                    continue
                if len(totals) >= HELD:
                    yield flush()
                totals[name] = [v, *(cells[n][i].copy() for n in carried)]
        if totals:
            yield flush()

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = np.sum(np.stack(pdf["v"].to_list()), axis=0)
        row = finish(*(np.asarray(pdf[c].iloc[0]) for c in carried), total)
        return pd.DataFrame({REC: pdf[REC].iloc[:1].to_list(), **{c: [v] for c, v in row.items()}})

    arrays = "".join(f", {c} array<double>" for c in ["v", *carried])
    return rows.select(REC, *names).mapInArrow(add, f"{REC} string, part bigint{arrays}").groupBy(
        REC).applyInPandas(close, f"{REC} string, {schema}")


def any_of(state: DataFrame, *conditions: Column) -> list[bool]:
    """Whether any row meets each condition, in one job; ``state`` has a row per recording."""
    found = state.select(*[c.cast("int").alias(f"c{i}") for i, c in enumerate(conditions)]).coalesce(1)
    return [bool(v) for v in found.agg(*[F.max(c) for c in found.columns]).first()]


STATE = "p array<double>, prev array<double>, aux array<double>"


def run_passes(state: DataFrame, step: Callable[[DataFrame], DataFrame], iterations: int) -> DataFrame:
    """Iterate ``state`` (``recording_id, p, prev, aux``) until every model is done.

    ``p`` are the parameters, ``prev`` those before the last update, ``aux`` a likelihood per
    model followed by a done flag per model. ``step`` gives the next state. Recordings whose models are
    all done leave the loop.
    """
    finished = None
    open_ = F.expr("exists(slice(aux, int(size(aux) / 2) + 1, int(size(aux) / 2)), d -> d = 0)")
    for _ in range(iterations):
        after = cut_lineage(step(state))
        going, done = any_of(after, open_, ~open_)
        state = after.filter(open_) if done else after
        if done:
            settled = after.filter(~open_)
            finished = settled if finished is None else finished.unionByName(settled)
        if not going:
            break
    return state if finished is None else finished.unionByName(state)


def settle(ll: np.ndarray, aux: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Models that were done before this step, and the next ``aux``."""
    half = len(aux) // 2
    before, was_done = aux[:half], aux[half:].astype(bool)
    done = was_done | (np.abs(ll - before) < tolerance)
    return was_done, np.concatenate([np.where(was_done, before, ll), done.astype(float)])
