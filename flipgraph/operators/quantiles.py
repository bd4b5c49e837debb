"""Exact quantiles of groups of any size: values are counted, and counts added up in ranges of values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipgraph.session import cut


def running_counts(values: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, x, _upto, _all): each distinct value with the number of values up to it and of all in its group; written.

    Equal values are counted first, with map-side combine; the counts are cut into ranges of (by, x), so that no task
    holds a whole group. Null values do not count; null keys are a group.
    """
    counts = values.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(counts.repartitionByRange(parts, *by, x).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(*by, "_range").agg(F.sum("_n").alias("_s"))  # a row per group and range
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_range").alias("_at"), before.alias("_before"), F.sum("_s").over(w).alias("_all"))
    here = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)), F.col("_range") == F.col("_at"))
    within = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return cut(ranges.withColumn("_in", within).join(offsets, here).select(*by, x, (F.col("_in") + F.col("_before")).alias("_upto"), "_all"), "counts")


def quantiles(values: DataFrame, x: str, by: list[str], wanted: dict[str, float], upper: bool = False) -> DataFrame:
    """(by, one column per name): interpolated quantiles of each group that has a value; upper: the value at the place
    floor(n * p) instead, so that of an even number of values the upper middle one is the median."""
    c = running_counts(values, x, by)

    def at(place) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col(x).cast("double")))

    out = []
    for name, p in wanted.items():
        place = F.col("_all") * F.lit(p) if upper else (F.col("_all") - 1) * F.lit(p)
        a, b = at(F.floor(place)), at(F.ceil(place))
        out.append((a if upper else a + (b - a) * F.max(place - F.floor(place))).alias(name))
    return c.groupBy(*by).agg(*out)


def joined(rows: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``more``, both a row per group; null keys match."""
    if not by:
        return rows.join(more, F.lit(True), "left")  # one row each
    other = more.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), *(c for c in more.columns if c not in by))
    return rows.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))), "left").drop(*(f"_k{i}" for i in range(len(by))))
