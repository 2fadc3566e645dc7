"""Delimited text: separator, header and column roles, then numeric channels by position."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewave.config import InputConfig
from statewave.operators.index import dense_index
from statewave.sources.selectors import normalize_selector

# Separators in order of preference.
SEPARATORS = [",", ";", "\t", " "]


def sniff_separator(lines: list[str]) -> str:
    """Most frequent separator of the first line that is not blank; comma if there is none."""
    first = next((line.strip() for line in lines if line.strip()), "")
    best = max(SEPARATORS, key=first.count)
    return best if first.count(best) else ","


def is_number(token: str) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


def sniff_header(lines: list[str], separator: str) -> bool:
    """A header exists where any token of the first line is not a number."""
    first = next((line.strip() for line in lines if line.strip()), None)
    return first is not None and not all(
        is_number(t.strip().strip('"')) for t in first.split(separator))


def resolve_column(names: list[str], numeric: list[str], selector: str | int | None,
                   fallback: str, required: bool) -> str | None:
    """Column for a channel: the selected one, the one with the channel's name, or the first
    numeric one. Positions select only where the file has no header."""
    lower = {n.lower(): n for n in names}
    if selector is not None:
        text = f"_c{selector}" if isinstance(selector, int) else selector
        hit = text if text in names else lower.get(text.lower())
        if hit is None and required:
            raise ValueError(f"Column '{selector}' was not found in CSV input.")
        return hit
    if fallback in lower:
        return lower[fallback]
    if numeric:
        return numeric[0]
    if required:
        raise ValueError("No numeric EEG column could be identified in CSV input.")
    return None


def pair_channels(rows: DataFrame, order: str, eeg: Column, emg: Column | None,
                  block: Column | None = None) -> DataFrame:
    """``recording_id, sample_idx, eeg, emg`` from text columns.

    Cells that are not numbers are dropped in each channel on its own and both channels are
    cut to the shorter one, so a hole in one channel shifts it against the other.
    """
    def channel(value: Column, name: str) -> DataFrame:
        columns = ["recording_id", F.col(order).alias("_order"), value.try_cast("double").alias(name)]
        if block is not None:
            columns.append(block.alias("_file_block"))
        kept = rows.select(*columns).filter(F.col(name).isNotNull() & ~F.isnan(name))
        return dense_index(kept, "recording_id", "_order", "sample_idx",
                           block=None if block is None else F.col("_file_block")).select(
            "recording_id", "sample_idx", name)

    left = channel(eeg, "eeg")
    if emg is None:
        return left.withColumn("emg", F.lit(None).cast("double"))
    return left.join(channel(emg, "emg"), ["recording_id", "sample_idx"])


def recording_name(table: DataFrame) -> Column:
    """The file's path below the folder that holds all files; the base name if they lie in one."""
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    if len(folders) < 2:
        return F.col("_metadata.file_name")
    shared = posixpath.commonpath([unquote(urlsplit(f).path) for f in folders])
    path = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/")
    return F.substring(path, len(shared) + 2, 1 << 20)


def read_csv(spark: SparkSession, path: str, config: InputConfig | None = None) -> DataFrame:
    """Read one file, or a glob of files of the same layout, as one recording per file."""
    cfg = config or InputConfig()
    peek = [r[0] for r in spark.read.text(path).limit(50).collect()]
    separator = cfg.csv_separator if cfg.csv_separator is not None else sniff_separator(peek)
    header = cfg.csv_has_header if cfg.csv_has_header is not None else sniff_header(peek, separator)
    table = spark.read.option("sep", separator).option("header", header).option(
        "ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = table.columns
    text = [F.trim(F.col(f"`{n}`")) for n in names]
    filled = [t.isNotNull() & (t != "") for t in text]
    bad = table.agg(*[F.max((f & t.try_cast("double").isNull()).cast("int")).alias(f"b{i}")
                      for i, (t, f) in enumerate(zip(text, filled))],
                    *[F.max(f.cast("int")).alias(f"f{i}") for i, f in enumerate(filled)]).first()
    numeric = [n for i, n in enumerate(names) if not bad[f"b{i}"] and bad[f"f{i}"] is not None]
    eeg = resolve_column(names, numeric, normalize_selector(cfg.csv_eeg_column), "eeg", True)
    emg = resolve_column(names, numeric, normalize_selector(cfg.csv_emg_column), "emg", False)
    tagged = table.select(
        recording_name(table).alias("recording_id"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{eeg}`").alias("_eeg"),
        (F.col(f"`{emg}`") if emg is not None else F.lit(None).cast("string")).alias("_emg"))
    # rows keep file order inside a split, splits are ordered by their byte offset
    return pair_channels(tagged, "_row", F.trim("_eeg"), None if emg is None else F.trim("_emg"),
                         block=F.col("_start"))
