"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, read up to twice. A document's
virtual finish time is the number of its source's words up to its end, divided by the source's
target, so that all sources reach their targets at time one. The mix is the sequence of all
documents in order of finish time, cut where the total budget is spent, which is time one;
the document that crosses it gives only its first words.

Targets: sources sorted by code point, null last, weigh 5, 2, 1, repeating, and share 150 % of
all words by weight; a target stops at twice its source's words, and the excess is shared out
again by weight until none is above.

Null texts have no words, are taken with zero words and never appear in the mixed sequence.
Repeated rows are separate documents; rows that agree in id, source and size may swap their
places without changing the result as a whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewave.llm.store import saved
from statewave.llm.text import count_words, plain

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix-1"
#: Shuffled order is that of md5 values; rows are summed in cells of equal leading hex digits.
ROWS_PER_CELL = 2000
DIGITS_PER_LEVEL = 3


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the plan's own columns: ``__size``, ``__source`` (never null) and ``__order``."""
    return docs.withColumns({
        "__size": count_words(F.col(text_col)),
        "__source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "__order": F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")),
    })


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (``__source``, ``source_size``) gets its ``target``.

    A source is cut to its cap if its cap lies below its share of what the sources with smaller
    ratios of size to weight leave over; all later ones share the rest by weight. One small
    table with a row per source, whatever the number of documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("__source") == "n", "__source")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("__source") == "n", "__source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rows = sizes.select("*", weight.alias("weight")).select(
        "*", (F.lit(SHARE) * F.sum("source_size").over(everything)).alias("budget"),
        (F.lit(MOST_REPEATS) * F.col("source_size")).alias("cap"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).alias("weight_left"),
        (MOST_REPEATS * F.coalesce(F.sum("source_size").over(before), zero)).alias("cap_before"))
    rows = rows.withColumn("capped", F.col("cap").cast("double") * F.col("weight_left")
                           <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
    free = lambda c: F.sum(F.when(~F.col("capped"), F.col(c))).over(everything)
    taken = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), zero)
    share = F.col("weight") * ((F.col("budget") - taken) / free("weight"))
    return rows.select("__source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double"))
                       .otherwise(share).alias("target"))


def cell_offsets(cells: DataFrame, digits: int) -> DataFrame:
    """Words of the same source before each cell, level by level so that no window is long."""
    offsets = None
    for end in range(min(DIGITS_PER_LEVEL, digits), digits + DIGITS_PER_LEVEL, DIGITS_PER_LEVEL):
        end, start = min(end, digits), end - DIGITS_PER_LEVEL
        level = cells.groupBy("__source", F.substring("__cell", 1, end).alias("__cell")).agg(F.sum("words").alias("words"))
        parent = F.substring("__cell", 1, max(start, 0))
        order = Window.partitionBy("__source", parent).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        level = level.select("__source", "__cell", parent.alias("__parent"),
                             F.coalesce(F.sum("words").over(order), F.lit(0)).alias("before"))
        if offsets is not None:
            above = offsets.select("__source", F.col("__cell").alias("__parent"), F.col("before").alias("above"))
            level = level.join(above, ["__source", "__parent"]).withColumn("before", F.col("before") + F.col("above"))
        offsets = level.select("__source", "__cell", "before")
        if end == digits:
            break
    return offsets


def plan_mix(rows: DataFrame) -> DataFrame:
    """Every row of ``sized`` with ``__source_size``, ``__target``, ``__before`` and ``__taken``.

    ``__before`` is the number of words of the same source before the document in shuffled
    order. Rows are shuffled once, by source and cell; a source of any size spreads over as
    many cells as it has rows for.
    """
    digits = max(1, math.ceil(math.log(max(rows.count(), 1) / ROWS_PER_CELL, 16)))
    rows = rows.withColumn("__cell", F.substring("__order", 1, digits))
    cells = rows.groupBy("__source", "__cell").agg(F.sum("__size").alias("words"))
    sources = source_targets(cells.groupBy("__source").agg(F.sum("words").alias("source_size")))
    cells = cell_offsets(cells, digits).join(sources, "__source").select(
        "__source", "__cell", F.col("before").alias("__cell_before"),
        F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    order = Window.partitionBy("__source", "__cell").orderBy(
        "__order", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(cells, ["__source", "__cell"]).withColumn(
        "__before", F.col("__cell_before") + F.coalesce(F.sum("__size").over(order), F.lit(0)))
    return rows.withColumn("__taken", sum((taken_in(k) for k in range(MOST_REPEATS)), F.lit(0)).cast("long"))


def taken_in(repeat: int) -> Column:
    """Words of a document that its ``repeat``-th reading adds: none, its first ones or all."""
    left = F.floor(F.col("__target") + 0.5) - repeat * F.col("__source_size") - F.col("__before")
    return F.greatest(F.lit(0), F.least(left, F.col("__size")))


def finish_time(repeat: Column) -> Column:
    words = repeat * F.col("__source_size") + F.col("__before") + F.col("__size")
    return F.when(F.col("__target") > 0, words / F.col("__target"))


def readings(plan: DataFrame) -> DataFrame:
    """A row for each reading of a document that the budget reaches, in order of finish time.

    Adds ``__words`` (the words read) and ``__finish``. The order is global: rows are range
    partitioned and sorted by finish time.
    """
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("repeat"), taken_in(k).alias("words"))
                              for k in range(MOST_REPEATS)]), lambda r: r["words"] > 0)
    rows = plan.withColumn("__reading", F.explode(each)).withColumns({
        "__words": F.col("__reading")["words"].cast("long"), "__finish": finish_time(F.col("__reading")["repeat"])})
    return rows.orderBy("__finish", "__source", "__order")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed sequence: the documents' own columns, a row for each reading.

    A document that is read twice appears twice. One that is read in part has its text cut
    after the last word read; ``n_chars``, if there, follows the text.
    """
    own = plain(docs)
    rows = readings(saved(plan_mix(sized(own))))
    text = F.when(F.col("__words") < F.col("__size"), first_words(F.col("text"), F.col("__words"))).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in own.columns:
        out["n_chars"] = F.when(F.col("__words") < F.col("__size"), F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in own.columns]).toDF(*docs.columns)


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document, as ``op2_mixing`` returns it, in order of first finish time."""
    plan = plan_mix(saved(sized(plain(docs).select("doc_id", "text", "source")).drop("text", "source")))
    return plan.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__taken").alias("taken"),
        finish_time(F.lit(0)).alias("first_finish")).orderBy("first_finish", "doc_id")
