"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.session import cut
from flipgraph.sources.tables import table

#: Items that one task packs together, about; more items make more tasks, not larger ones.
ITEMS_PER_SHARD = 20_000
#: A container of the first pass that is filled to at most this share is packed again, as one item, with others.
LOOSE = 0.75


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container number of each item, by the sum-of-squares rule, and how many containers there are.

    count[g] is the number of open containers with ``g`` units left. An item goes where the sum of count[g] ** 2
    over 0 < g < capacity becomes smallest: into an open container, or into a new one. Of equal places the one
    with the least space left is taken, a new container last; of equal containers the latest.
    Sizes must lie between 1 and the capacity.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_ones: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, n = np.empty(len(sizes), np.int64), 0
    huge = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        before, after = count[size:capacity], count[: capacity - size]
        change = after - before  # half of what the sum changes by, less one
        change = np.where(before > 0, 2 * change + 2, huge)
        if len(change) and before[0]:
            change[0] = 1 - 2 * before[0]  # filled up: it leaves the sum
        best = int(change.argmin()) if len(change) else 0
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if len(change) and change[best] <= fresh:
            gap = best + size
            box = open_ones[gap].pop()
            count[gap] -= 1
        else:
            gap, box, n = capacity, n, n + 1
        left = gap - size
        if left:
            open_ones[left].append(box)
            count[left] += 1
        placed[i] = box
    return placed, n


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """As ``sum_of_squares``, but the largest item goes first, and each into the fullest container that has room."""
    gaps: list[tuple[int, int]] = []  # (space left, container), sorted
    placed, n = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            left, box = gaps.pop(at)
        else:
            left, box, n = capacity, n, n + 1
        insort(gaps, (left - size, box))
        placed[i] = box
    return placed, n


def _pack(rule, most: int):
    """Rows arrive sorted by (spec_id, shard); a shard is packed when it is complete, or ``most`` rows of it are there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, used = None, {}  # containers of the shard that is being read, by its key

        def done(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal used
            key = int(part["spec_id"].iloc[0]), int(part["shard"].iloc[0])
            box, n = rule(part["tokens"].to_numpy(), int(part["capacity"].iloc[0]))
            first = used.get(key, 0)
            used = {key: first + n}
            return part.assign(box=(part["shard"].to_numpy().astype(np.int64) << 32) + first + box)

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rest["spec_id"].to_numpy(), rest["shard"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield done(rest.iloc[a:b])
            rest = rest.iloc[starts[-1] :] if len(starts) else None
            if rest is not None and len(rest) >= most:
                yield done(rest)
                rest = None
        if rest is not None and len(rest):
            yield done(rest)

    return run


def _shards(items: DataFrame, n_items: int, per_shard: int, key: Column, rule=sum_of_squares) -> DataFrame:
    """Packs ``items`` (spec_id, capacity, tokens, ...) in shards by hash; adds shard and box."""
    shards = max(1, -(-n_items // per_shard))
    rows = items.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(6)), F.lit(shards)).cast("int"))
    rows = rows.repartition("spec_id", "shard").sortWithinPartitions("spec_id", "shard", F.xxhash64(key, F.lit(7)), "tokens")
    names = rows.columns
    return rows.mapInPandas(_pack(rule, 4 * per_shard), rows.withColumn("box", F.lit(0).cast("long")).schema).select(*names, "box")


def pack(documents: DataFrame, specs: DataFrame, id_col: str, tokens: Column, per_shard: int = ITEMS_PER_SHARD, loose: float = LOOSE) -> DataFrame:
    """(spec_id, doc, piece, tokens, container): every document in a container of each capacity.

    A document above the capacity is split: pieces that fill a container each, and a last one that is packed
    like any other item. No other document is split. Documents of no or unknown size take no space; they come
    out with ``container`` null and ``tokens`` 0. Repeated ids count as documents of their own. A spec
    without a positive capacity gives no rows.

    Items are dealt to shards by the hash of their document's id, those without an id by their place in the table, so the
    packing does not depend on how the table is split; a shard of many equal ids is packed in pieces. Each shard is packed by the sum-of-squares rule; containers that stay
    loose are then packed again across the shards, as items of their filled size, the fullest first and each where
    it fits best. Few containers per shard stay loose, so the second pass is small.
    """
    specs_ = [(r["spec_id"], r["capacity"]) for r in specs.where("capacity > 0").distinct().limit(1001).collect()]
    if len(specs_) > 1000:
        raise ValueError("more than 1000 capacities")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("doc"), F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    if not specs_:
        return spark.createDataFrame([], f"spec_id int, doc {docs.schema['doc'].dataType.simpleString()}, piece int, tokens long, container string")
    each = F.explode(F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in specs_)))
    sized = docs.withColumn("row", F.monotonically_increasing_id()).select("doc", "row", "size", each.alias("spec")).select("doc", "row", "size", "spec.*")
    full = F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int")
    sized = cut(sized.withColumn("full", full).withColumn("tokens", F.col("size") - F.col("full") * F.col("capacity")), "sizes")
    whole = sized.where("full > 0").select("spec_id", "doc", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.col("capacity").alias("tokens"), F.concat(F.lit("d"), F.col("row"), F.lit("."), F.col("piece")).alias("container"))
    none = sized.where("size = 0").select("spec_id", "doc", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("container"))
    items = sized.where("tokens > 0").select("spec_id", "capacity", "doc", F.col("full").alias("piece"), "tokens", "row")
    n_items = sized.where("size > 0").count() // len(specs_)
    first = cut(_shards(items, n_items, per_shard, F.when(F.col("doc").isNotNull(), F.xxhash64("doc", "piece")).otherwise(F.col("row"))).drop("shard", "row"), "packed")
    boxes = first.groupBy("spec_id", "capacity", "box").agg(F.sum("tokens").alias("tokens"))
    slack = cut(boxes.where(F.col("tokens") <= loose * F.col("capacity")), "loose")
    again = _shards(slack.withColumnRenamed("box", "old"), max(1, slack.count() // len(specs_)), per_shard, F.col("old"), best_fit_decreasing)
    moved = again.select("spec_id", F.col("old").alias("box"), F.concat(F.lit("m"), F.col("box")).alias("to"))
    packed = first.join(moved, ["spec_id", "box"], "left")
    packed = packed.select("spec_id", "doc", "piece", "tokens", F.coalesce("to", F.concat(F.lit("c"), F.col("box"))).alias("container"))
    return packed.unionByName(whole).unionByName(none)


def usage(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, containers, tokens, filled): how full the containers of each capacity are."""
    counts = packed.where("container IS NOT NULL").groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"))
    counts = counts.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    joined = counts.join(F.broadcast(specs.where("capacity > 0").distinct().limit(1000)), "spec_id")
    return joined.select("spec_id", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))


def byte_tokens(n_tokens: str = "n_tokens", text: str = "text") -> Column:
    """Size in tokens of the byte tokenizer: the stored one, else the text's UTF-8 bytes; null for a null text."""
    return F.when(F.col(text).isNotNull(), F.coalesce(F.col(n_tokens), F.octet_length(text)))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, table(spark, sf_dir, "pack_specs"), "doc_id", byte_tokens()).withColumnRenamed("doc", "doc_id")


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


SQL: dict[str, str] = {}
QUERIES = {"p6_packed": p6_packed, "p6_usage": p6_usage}
