"""Session defaults, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the largest size in bytes that a plan's guess may have.
GUESS_BITS = 62


def get_spark(app: str = "statewave", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests, benches and the command line.

    On a cluster the caller brings a session; nothing here overrides its settings.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and restart its plan there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.

    A checkpoint keeps the size that the optimizer guessed, and a join's guess is the product of
    its sides'. In a loop it squares from pass to pass, until the driver spends its time and memory
    on the digits of one number; a guess beyond any data is therefore dropped.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors.")
            folder = tempfile.mkdtemp(prefix="statewave-checkpoint-")
        sc.setCheckpointDir(folder)
    kept = df.checkpoint(eager=True)
    plan = kept._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= GUESS_BITS:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), kept._jdf.schema(), False), spark)


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own limit for broadcast sides, in bytes (-1 switches them off)."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = raw.strip().lower().rstrip("b")
    if text and text[-1] in units:
        return int(float(text[:-1]) * units[text[-1]])
    return int(text)


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Broadcast a side whose size was counted and lies under the session's limit.

    Above the limit the frame is returned without a hint, so the join shuffles and AQE
    splits skewed keys.
    """
    if rows * bytes_per_row <= broadcast_limit(df.sparkSession):
        return F.broadcast(df)
    return df
