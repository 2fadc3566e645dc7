"""Dense positions and neighbours without ever sorting a whole recording in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_index(df: DataFrame, key: str, order: str, out: str, span: int = 65536,
                block: Column | None = None) -> DataFrame:
    """Number the rows of every key 0, 1, 2 ... in ``order``.

    A key may hold a third of the table, so rows are ranked inside (key, block) and the
    block totals - one row per block - give the offsets. ``block`` defaults to
    ``order div span`` and must not decrease along ``order``.
    """
    block = F.expr(f"{order} div {span}") if block is None else block
    tagged = df.withColumn("_block", block)
    totals = tagged.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(key, "_block").orderBy(order)
    return (
        tagged.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_block"])
        .withColumn(out, (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop("_block", "_rank", "_offset")
    )


def with_previous(df: DataFrame, key: str, index: str, columns: list[str],
                  block: int = 4096) -> DataFrame:
    """Add ``prev_<column>`` from the row with ``index - 1`` of the same key.

    The last row of a block also travels to the following block as a halo row, so one
    shuffle on (key, block) is enough and no task sees more than ``block + 1`` rows of it.
    ``index`` has to be dense.
    """
    own = F.expr(f"{index} div {block}")
    last = F.expr(f"{index} % {block} = {block - 1}")
    spread = df.withColumn(
        "_block",
        F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))),
    )
    order = W.partitionBy(key, "_block").orderBy(index)
    for name in columns:
        spread = spread.withColumn(f"prev_{name}", F.lag(name).over(order))
    return spread.filter(F.col("_block") == own).drop("_block")


def run_lengths(df: DataFrame, key: str, index: str, state: str, block: int = 4096) -> DataFrame:
    """Run-length encoding: one row per maximal run of equal ``state`` values.

    Runs are first closed inside blocks. Only the two outermost runs of a block can
    continue in a neighbour, so only those (at most two rows per block) are merged per key.
    """
    own = F.expr(f"{index} div {block}")
    inside = W.partitionBy(key, "_block").orderBy(index)
    pieces = (
        df.select(key, index, state, own.alias("_block"))
        .withColumn("_new", F.coalesce(F.col(state) != F.lag(state).over(inside), F.lit(True)))
        .withColumn("_island", F.sum(F.col("_new").cast("int")).over(inside))
        .groupBy(key, "_block", "_island")
        .agg(F.first(state).alias(state), F.min(index).alias("run_start"),
             F.max(index).alias("_end"))
    )
    rim = W.partitionBy(key, "_block")
    pieces = pieces.withColumn("_islands", F.max("_island").over(rim))
    outer = (F.col("_island") == 1) | (F.col("_island") == F.col("_islands"))
    chain = W.partitionBy(key).orderBy("run_start")
    joins = F.coalesce(
        (F.col(state) == F.lag(state).over(chain))
        & (F.col("run_start") == F.lag("_end").over(chain) + 1), F.lit(False))
    merged = (
        pieces.filter(outer)
        .withColumn("_starts", F.when(joins, 0).otherwise(1))
        .withColumn("_group", F.sum("_starts").over(chain))
        .groupBy(key, "_group")
        .agg(F.first(state).alias(state), F.min("run_start").alias("run_start"),
             F.max("_end").alias("_end"))
        .select(key, state, "run_start", "_end")
    )
    return (
        pieces.filter(~outer).select(key, state, "run_start", "_end").unionByName(merged)
        .select(key, state, "run_start",
                (F.col("_end") - F.col("run_start") + 1).cast("bigint").alias("run_length"))
    )


def transition_counts(df: DataFrame, key: str, index: str, state: str) -> DataFrame:
    """Counts of consecutive state pairs per key."""
    return (
        with_previous(df.select(key, index, state), key, index, [state])
        .filter(F.col(f"prev_{state}").isNotNull())
        .groupBy(key, F.col(f"prev_{state}").alias("from_state"), F.col(state).alias("to_state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def transition_matrix(df: DataFrame, key: str, index: str, state: str,
                      pseudocount: float = 0.0, n_states: int | None = None) -> DataFrame:
    """Row-normalised transition probabilities; with ``n_states`` the full grid is emitted."""
    counts = transition_counts(df, key, index, state)
    if n_states is not None:
        grid = (
            df.select(key).distinct()
            .withColumn("from_state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
            .withColumn("to_state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
        )
        counts = grid.join(counts, [key, "from_state", "to_state"], "left").fillna(0, ["n"])
    row = W.partitionBy(key, "from_state")
    weight = F.col("n") + F.lit(float(pseudocount))
    return counts.withColumn("probability", weight / F.sum(weight).over(row))
