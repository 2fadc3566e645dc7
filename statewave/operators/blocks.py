"""Block layout: bounded runs of consecutive rows of one recording packed in arrays.

All order-dependent work (filters, hidden Markov models, k-means draws) runs on blocks, so
a recording of any length is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewave.session import cut_lineage, maybe_broadcast

REC = "recording_id"
SIGNAL_BLOCK = 131072
ROW_BLOCK = 4096
ROWS_PER_TASK = 16 * ROW_BLOCK
#: Most blocks of a recording whose models are fitted in a task.
BLOCKS_PER_FIT = 32


def recording_lengths(samples: DataFrame, index: str = "sample_idx") -> DataFrame:
    """One row per recording with its number of rows (``index`` is dense from 0)."""
    return samples.groupBy(REC).agg((F.max(index) + 1).alias("n_rows"))


def signal_blocks(samples: DataFrame, lengths: DataFrame, n_recordings: int,
                  size: int = SIGNAL_BLOCK) -> DataFrame:
    """Pack ``(recording_id, sample_idx, eeg, emg)`` rows into arrays of about ``size``.

    The last block takes the remainder, so no block is shorter than the filters' edge
    padding unless the whole recording is.
    """
    last = F.greatest(F.expr(f"n_rows div {size}"), F.lit(1)) - 1
    packed = (
        samples.select(REC, "sample_idx", "eeg", "emg")
        .join(maybe_broadcast(lengths, n_recordings, 64), REC)
        .withColumn("block", F.least(F.expr(f"sample_idx div {size}"), last))
        .groupBy(REC, "block")
        .agg(
            F.sort_array(F.collect_list(F.struct("sample_idx", "eeg", "emg"))).alias("rows"),
            F.max(last).alias("last_block"),
        )
    )
    return packed.select(
        REC, "block", "last_block", F.col("rows")[0]["sample_idx"].alias("start_idx"),
        F.col("rows.eeg").alias("eeg"), F.col("rows.emg").alias("emg"),
    )


@dataclass
class Blocks:
    """Feature rows packed for model fitting.

    ``df`` holds ``recording_id, block, start_idx, n_rows, x`` with ``x`` a flat row-major
    array of at most ``size`` rows of ``width`` values; ``lengths`` the rows per recording.
    """

    df: DataFrame
    lengths: DataFrame
    width: int
    size: int
    n_recordings: int
    n_long: int
    max_blocks: int
    fit_rows: int = 0
    n_vast: int = 0

    def short(self) -> "Blocks":
        """Recordings that fit one block: a model sees all of their rows in one task."""
        return Blocks(self.df.filter(F.col("n_rows") <= self.size),
                      self.lengths.filter(F.col("n_rows") <= self.size), self.width, self.size,
                      self.n_recordings - self.n_long, 0, 1, self.fit_rows)

    def long(self) -> "Blocks":
        """Recordings of several blocks."""
        return Blocks(self.df.filter(F.col("n_rows") > self.size),
                      self.lengths.filter(F.col("n_rows") > self.size), self.width, self.size,
                      self.n_long, self.n_long, self.max_blocks, self.fit_rows, self.n_vast)

    def gathered(self, models: int = 1) -> tuple[DataFrame, int]:
        """Recordings of several blocks, but at most ``fit_rows`` rows, in one row for each share of
        their models: ``recording_id, share, x``, and the number of shares.

        An iteration over so few rows costs less than a job, and models do not depend on each other,
        so a few recordings are dealt to a task for each model.
        """
        spark = self.df.sparkSession
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        count = self.n_long - self.n_vast
        shares = max(1, min(models, -(-tasks // max(count, 1))))
        whole = self.df.filter((F.col("n_rows") > self.size) & (F.col("n_rows") <= self.fit_rows)).groupBy(REC).agg(
            F.sort_array(F.collect_list(F.struct("block", "x"))).alias("rows")).select(REC, F.flatten("rows.x").alias("x"))
        dealt = max(1, min(count * shares, tasks))
        return whole.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionById(
            dealt, F.expr(f"int(pmod(hash({REC}) + share, {dealt}))")).select(REC, "share", "x"), shares

    def vast(self) -> "Blocks":
        """Recordings of more than ``fit_rows`` rows: models are fitted by passes over all blocks."""
        return Blocks(self.df.filter(F.col("n_rows") > self.fit_rows), self.lengths.filter(F.col("n_rows") > self.fit_rows),
                      self.width, self.size, self.n_vast, self.n_vast, self.max_blocks, self.fit_rows, self.n_vast)

    def with_state(self, state: DataFrame, row_bytes: int) -> DataFrame:
        """Bring each recording's model state to its blocks.

        The state is broadcast while its counted size fits the session's limit and joined
        by shuffle (AQE splits skewed recordings) beyond it.
        """
        return self.df.join(maybe_broadcast(state, self.n_recordings, row_bytes), REC)


def feature_blocks(table: DataFrame, index: str, columns: list[str],
                   size: int = ROW_BLOCK, fit_rows: int | None = None) -> Blocks:
    """Pack the feature rows of every recording; ``index`` is dense from 0.

    ``fit_rows`` is the most rows of a recording that a task fits models to; blocks smaller than usual
    have no larger tasks.
    """
    if fit_rows is None:
        fit_rows = size * BLOCKS_PER_FIT if size >= ROW_BLOCK else size
    lengths = cut_lineage(recording_lengths(table, index))
    n, longest, n_long, n_vast, total, rows = lengths.agg(
        F.count(F.lit(1)), F.max("n_rows"), F.sum((F.col("n_rows") > size).cast("int")),
        F.sum((F.col("n_rows") > fit_rows).cast("int")),
        F.sum(F.ceil(F.col("n_rows") / size)), F.sum("n_rows")).first()
    # fitting costs far more than its bytes suggest: ask for tasks by rows, not by size
    shuffle = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(total or 1, max(shuffle, (rows or 1) // ROWS_PER_TASK)))
    packed = (
        table.select(REC, F.col(index).alias("_i"), F.expr(f"{index} div {size}").alias("block"),
                     F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
        .repartition(tasks, REC, "block")
        .groupBy(REC, "block")
        .agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("rows"))
        .join(maybe_broadcast(lengths, n, 64), REC)
    )
    df = packed.select(
        REC, "block", F.col("rows")[0]["_i"].alias("start_idx"), "n_rows",
        F.flatten(F.col("rows._x")).alias("x"),
    )
    return Blocks(cut_lineage(df), lengths, len(columns), size, n, n_long or 0,
                  ((longest or 1) - 1) // size + 1, fit_rows, n_vast or 0)


def sum_vectors(parts: DataFrame, vector: str) -> DataFrame:
    """Element-wise sum of an array column per recording.

    Every position is a group of its own with map-side partial sums, so a recording that
    owns most blocks does not end up in one task before it is aggregated.
    """
    cells = parts.select(REC, F.posexplode(vector).alias("pos", "value"))
    return (
        cells.groupBy(REC, "pos").agg(F.sum("value").alias("value"))
        .groupBy(REC).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("cells"))
        .select(REC, F.col("cells.value").alias("stats"))
    )
