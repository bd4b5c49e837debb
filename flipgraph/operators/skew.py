"""Join helper that splits hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the left rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002
#: Into how many parts the rows of a hot key are split, at most.
MAX_SALTS = 256


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", share: float = HOT_SHARE) -> list:
    """Keys with more than ``share`` of all rows, with their part counts; at most ``1 / share`` rows reach the driver.

    ``counts`` has one row per key and is best a written table.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    floor = max(int(total * share), 1)
    salts = F.least(F.lit(MAX_SALTS), F.ceil(F.col(n) / F.lit(floor)) + 1).cast("int").alias("salts")
    return counts.where(F.col(n) > floor).select(*keys, salts).collect()


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], hot: list, spread: Column, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key; rows of hot keys go to several tasks.

    hot: from hot_keys. spread: any column of ``left`` that differs between the rows of a key.
    Null keys match nothing, as in SQL.
    """
    if not hot:
        return left.join(right, keys, how)
    spark = left.sparkSession
    types = ", ".join(f"`{k}` {right.schema[k].dataType.simpleString()}" for k in keys)
    table = F.broadcast(spark.createDataFrame(hot, f"{types}, salts int"))  # at most 1 / HOT_SHARE rows
    at = F.coalesce(F.pmod(F.xxhash64(spread), F.col("salts")), F.lit(0)).cast("int")
    a = left.join(table, keys, "left").withColumn("_salt", at).drop("salts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    b = right.join(table, keys, "left").withColumn("_salt", parts).drop("salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
