"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Here a group is cut
into value buckets by approximate bounds first; exact ranks come from bucket totals plus a
sort inside each bucket, so a group that holds most of the data is still spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 64
BUFFER_ROWS = 131072  # largest group that one aggregation buffer may hold


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, n``: equal values collapse before anything is sorted."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(counts: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles: ``keys, q`` with one entry per probability.

    ``counts`` is the output of ``value_counts``.
    """
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    groups = counts.groupBy(*keys).agg(
        F.percentile_approx("value", F.array(*[F.lit(c) for c in cuts]), F.lit(1000)).alias("cuts"),
        F.sum("n").alias("total"))
    tagged = counts.join(groups, keys).withColumn(
        "bucket", F.expr("size(filter(cuts, c -> c < value))")).drop("cuts")
    totals = tagged.groupBy(*keys, "bucket").agg(F.sum("n").alias("in_bucket"))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "bucket",
                            F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        tagged.withColumn("_upto", F.sum("n").over(inside))
        .join(offsets, [*keys, "bucket"])
        .withColumn("last", F.col("offset") + F.col("_upto") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    # a probability needs the values at the ranks around q * (total - 1)
    where = F.array(*[F.lit(float(p)) for p in probs])
    spot = F.transform(where, lambda p: p * (F.col("total") - 1))
    low = F.floor(F.col("p.spot"))
    hit = ranked.withColumn("p", F.explode(F.filter(
        F.transform(spot, lambda s, i: F.struct(i.alias("i"), s.alias("spot"))),
        lambda p: (F.floor(p["spot"]) <= F.col("last"))
        & (F.least(F.floor(p["spot"]) + 1, F.col("total") - 1) >= F.col("first")))))
    high = F.least(low + 1, F.col("total") - 1)
    covers = lambda rank: (rank >= F.col("first")) & (rank <= F.col("last"))
    pairs = hit.groupBy(*keys, F.col("p.i").alias("i"), F.col("p.spot").alias("spot")).agg(
        F.max(F.when(covers(low), F.col("value"))).alias("a"),
        F.max(F.when(covers(high), F.col("value"))).alias("b"))
    part = F.col("spot") - F.floor("spot")
    rise = F.col("b") - F.col("a")
    value = F.when(part < 0.5, F.col("a") + rise * part).otherwise(F.col("b") - rise * (1 - part))
    return pairs.select(*keys, "i", value.alias("v")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).select(
        *keys, F.col("s.v").alias("q"))


def split_candidates(cells: DataFrame, keys: list[str], value: str, limit: int,
                     max_rows: int) -> DataFrame:
    """Sorted candidate thresholds per group: ``keys, thresholds``.

    Up to ``limit`` distinct values give the midpoints between neighbours, more give the
    distinct quantiles from 5 % to 95 %. Groups with a single value are left out.
    ``max_rows`` is the counted size of the largest group: groups that fit an aggregation
    buffer are done in one aggregation, larger ones by bucketed ranks.
    """
    step = 0.9 / (limit - 1) if limit > 1 else 0.0
    probs = [0.05 + step * i for i in range(limit)]

    def middles(v: str):
        return F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1),
                          lambda a, b: (a + b) / 2.0)

    if max_rows <= BUFFER_ROWS:
        groups = cells.groupBy(*keys).agg(
            F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("q"),
            F.sort_array(F.collect_set(value)).alias("v"))
        return groups.filter(F.size("v") > 1).select(*keys, F.when(
            F.size("v") <= limit, middles("v")).otherwise(F.sort_array(F.array_distinct("q")))
            .alias("thresholds"))
    counts = value_counts(cells, keys, value)
    kinds = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"))
    few = counts.join(kinds.filter(F.col("distinct").between(2, limit)), keys).groupBy(
        *keys).agg(F.sort_array(F.collect_list("value")).alias("v"))
    many = counts.join(kinds.filter(F.col("distinct") > limit).drop("distinct"), keys)
    quantiles = exact_quantiles(many, keys, probs).select(
        *keys, F.sort_array(F.array_distinct("q")).alias("thresholds"))
    return few.select(*keys, middles("v").alias("thresholds")).unionByName(quantiles)
