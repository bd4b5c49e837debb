"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_id(df: DataFrame, id_col: str, *columns) -> DataFrame:
    """``id_col`` as ``rec`` and ``columns``, one row per id: re-delivered rows have equal content.

    A row without an id cannot be a re-delivery and stays a record of its own, under a negative ``rec``.
    """
    rec = F.coalesce(F.col(id_col), -1 - F.monotonically_increasing_id())
    return df.select(rec.alias("rec"), *columns).dropDuplicates(["rec"])
