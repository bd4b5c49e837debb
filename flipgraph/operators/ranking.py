"""Ranking operators: stable ranks, agreement of rankings, and retrieval metrics."""

from __future__ import annotations

from bisect import bisect
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipgraph.operators.aggregates import count_if, rnd
from flipgraph.operators.skew import hot_keys, salted_lookup
from flipgraph.session import cut


def ranked(scores: DataFrame, by: list[str], order: Column | None = None, tie: str = "element_id", name: str = "rn") -> DataFrame:
    """Rank 1 is the highest score; equal scores in the order of ``tie``. Nulls come last."""
    order = F.desc_nulls_last("score") if order is None else order
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))


def ranked_split(scores: DataFrame, by: list[str], order: Column | None = None, tie: str = "element_id", name: str = "rn") -> DataFrame:
    """As ``ranked``, for groups of any size: no task sorts a whole group.

    Rows are cut into ranges of (by, order, tie), ranked within their range, and get the number of their group's rows
    in earlier ranges added. One table is written. Null keys are a group.
    """
    order = F.desc_nulls_last("score") if order is None else order
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(scores.repartitionByRange(parts, *by, order, tie).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per group and range
    sizes = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = ranges.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order, tie)))
    here = (F.col("_range") == F.col("_at")) & reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)))
    return rows.join(offsets, here).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*scores.columns, name)


def with_groups(df: DataFrame, by: list[str], spread: str, *aggregates: Column) -> DataFrame:
    """Adds aggregates of each group to its rows; the rows of a hot group go to several tasks. Null keys get nulls."""
    sums = cut(df.groupBy(*by).agg(*aggregates, F.count("*").alias("_n")), "groups")
    return salted_lookup(df, sums.drop("_n"), by, hot_keys(sums, by, "_n"), F.col(spread))


def average_rank(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """Ascending rank, equal values share the mean of their places."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0)


@F.pandas_udf(T.DoubleType())
def tau_of(ranks: pd.Series) -> pd.Series:
    """Rank correlation of lists of different ranks with their order; null below two ranks. Counts inversions by insertion."""
    out = []
    for r in ranks:
        n = 0 if r is None else len(r)
        if n < 2:
            out.append(None)
            continue
        seen, inverted = [], 0
        for x in r:
            at = bisect(seen, x)
            inverted += len(seen) - at
            seen.insert(at, x)
        out.append(1.0 - 4.0 * inverted / (n * (n - 1)))
    return pd.Series(out, dtype="float64")


def _in_order(first: str, then: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(first).alias("a"), F.col(then).alias("b")))), lambda x: x["b"])


def kendall(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a and b: (by, element_id, rn), ranks without ties. tau over the shared elements; null below two of them.

    A group is one ranking of one explanation, whose elements become one list; no pairs are formed.
    """
    both = a.select(*by, "element_id", F.col("rn").alias("ra")).join(b.select(*by, "element_id", F.col("rn").alias("rb")), [*by, "element_id"])
    lists = both.groupBy(*by).agg(F.count("*").alias("shared"), _in_order("ra", "rb").alias("ranks"))
    return lists.select(*by, "shared", rnd(tau_of("ranks")).alias("tau"))


def topk_agreement(a: DataFrame, b: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """a and b: (by, element_id, rn). First place equal, top-k sets equal, equal places and whether all are."""
    j = a.select(*by, "element_id", F.col("rn").alias("ra")).join(b.select(*by, "element_id", F.col("rn").alias("rb")), [*by, "element_id"], "full")
    same = F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))
    top = (F.coalesce(F.col("ra") <= k, F.lit(False)) != F.coalesce(F.col("rb") <= k, F.lit(False))).cast("int")
    first = same & (F.col("ra") == 1)
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.max(first).alias("same_first"), (F.sum(top) == 0).alias("same_topk"), count_if(same).alias("same_places"), F.min(same).alias("same_ranking"))


def identity_tau(perms: DataFrame, by: list[str]) -> DataFrame:
    """perms: (by, pos, idx). tau of each index permutation against the identity; 1 below two items."""
    lists = perms.groupBy(*by).agg(F.count("*").alias("n"), _in_order("pos", "idx").alias("ranks"))
    return lists.select(*by, "n", rnd(F.coalesce(tau_of("ranks"), F.lit(1.0))).alias("tau"))


def best_noise_rank(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: (by, rn, is_noise). First noise rank in both conventions: from 1 or null, and from 0 or the number of items."""
    first = F.min(F.when(F.col("is_noise"), F.col("rn")))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), first.alias("rank_from_1"), F.coalesce(first - 1, F.count("*")).cast("long").alias("rank_from_0"))


def noise_in_topk(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """rows: (by, rn, is_noise). Noise within the top k, as a share of all noise and of the places that there are."""
    z, top = F.col("is_noise"), F.col("rn") <= k
    each = rows.groupBy(*by).agg(F.least(F.count("*"), F.lit(k)).cast("long").alias("k_eff"), count_if(z & top).alias("in_topk"), count_if(z).alias("n_noise"))
    part = F.col("in_topk").cast("double")
    return each.select(*by, "k_eff", "in_topk", "n_noise", rnd(F.coalesce(part / F.nullif(F.col("n_noise"), F.lit(0)), F.lit(0.0))).alias("of_noise"), rnd(F.coalesce(part / F.nullif(F.col("k_eff"), F.lit(0)), F.lit(0.0))).alias("of_places"))


def latest(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """The latest row per key; of equal times the one with the lowest ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(time), tie)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cheapest(df: DataFrame, by: list[str], cost: str, tie: str) -> DataFrame:
    """The row with the lowest cost per key, nulls last; ties by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(cost), tie)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def minmax_scaled(df: DataFrame, by: list[str], x: str, name: str, flat: float = 1.0) -> DataFrame:
    """(x - min) / (max - min) per key; ``flat`` where all values are equal."""
    lo, hi = F.col("_lo"), F.col("_hi")
    rows = with_groups(df, by, x, F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return rows.withColumn(name, F.when(hi == lo, F.lit(flat)).otherwise((F.col(x) - lo) / (hi - lo))).drop("_lo", "_hi")


def max_scaled(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """x / max per key; x itself where the largest value is 0."""
    top = F.col("_top")
    return with_groups(df, by, x, F.max(x).alias("_top")).withColumn(name, F.when(top == 0, F.col(x)).otherwise(F.col(x) / top)).drop("_top")


def ndcg(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """rows: (by, element_id, relevance, score). NDCG at k: the gain of places with equal scores is their mean.

    0 where there is no relevance to gain. Relevance must not be negative.
    """
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "element_id"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance"), "element_id"))
    gain = rows.withColumn("p", pos).withColumn("i", best).withColumn("shared", F.avg("relevance").over(Window.partitionBy(*by, "score")))

    def discounted(value: str, place: str) -> Column:
        return F.sum(F.when(F.col(place) <= k, F.col(value) / F.log2(F.col(place) + 1.0)).otherwise(0.0))

    ideal = discounted("relevance", "i")
    return gain.groupBy(*by).agg(F.count("*").alias("n"), rnd(F.when(ideal > 0, discounted("shared", "p") / ideal).otherwise(0.0)).alias("ndcg"))


def average_precision(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: (by, element_id, score, is_gold). Mean precision at the places of gold items; null without gold."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "element_id")
    run = rows.withColumn("rn", F.row_number().over(w)).withColumn("tp", F.sum(F.col("is_gold").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by).agg(count_if(F.col("is_gold")).alias("n_gold"), rnd(F.avg(F.when(F.col("is_gold"), F.col("tp") / F.col("rn")))).alias("ap"))


def recall_at(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """rows: (by, element_id, score, is_gold). Recall in the top k, and precision in the top |gold|."""
    g = F.col("is_gold")
    r = ranked(rows, by).withColumn("n_gold", F.sum(g.cast("int")).over(Window.partitionBy(*by)))
    return r.groupBy(*by).agg(F.max("n_gold").alias("n_gold"), rnd(count_if(g & (F.col("rn") <= k)) / F.nullif(F.max("n_gold"), F.lit(0))).alias("recall"), rnd(count_if(g & (F.col("rn") <= F.col("n_gold"))) / F.nullif(F.max("n_gold"), F.lit(0))).alias("r_precision"))


def pair_recovery(pairs: DataFrame, by: list[str], is_pair: Column) -> DataFrame:
    """pairs: (by, value). Whether the wanted pair has the largest and the smallest value of its group."""
    w = Window.partitionBy(*by)
    r = pairs.withColumn("hi", F.max("value").over(w)).withColumn("lo", F.min("value").over(w)).where(is_pair)
    return r.groupBy(*by).agg(F.max((F.col("value") == F.col("hi")).cast("int")).alias("is_max"), F.max((F.col("value") == F.col("lo")).cast("int")).alias("is_min"))


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two columns per key; null where one of them does not vary."""
    r = average_rank(average_rank(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, a, "_ra"), by, b, "_rb")
    n = F.count("*").cast("double")
    sa, sb, sab = F.sum("_ra"), F.sum("_rb"), F.sum(F.col("_ra") * F.col("_rb"))
    va, vb = F.sum(F.col("_ra") * F.col("_ra")) - sa * sa / n, F.sum(F.col("_rb") * F.col("_rb")) - sb * sb / n
    return r.groupBy(*by).agg(F.count("*").alias("n"), rnd(F.when((va > 1e-9) & (vb > 1e-9), (sab - sa * sb / n) / F.sqrt(va * vb)), 5).alias("rho"))
