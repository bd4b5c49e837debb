"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipgraph.llm.packing import byte_tokens
from flipgraph.session import cut
from flipgraph.sources.tables import table

#: Rows of one source that share a range of random keys, about: the largest group that one task sorts.
ROWS_PER_RANGE = 50_000
#: The seed of the random order.
SEED = 7


def _sized(documents: DataFrame, id_col: str, source: str, tokens: Column) -> DataFrame:
    size = F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))
    return documents.select(F.col(id_col).alias("doc"), F.col(source).alias("source"), size.alias("tokens"))


def plan_mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: its budget, how many whole passes it takes and the rest of the last pass.

    budget = target_share * size_factor * tokens of all documents. A source is passed at most ``max_repeats``
    times (null: once); where that is too little, or the source has no documents, the budget is not met.
    """
    have = docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    have = cut(have, "sources")
    total = have.agg(F.sum("source_tokens")).first()[0] or 0
    want = targets.where("source IS NOT NULL").groupBy("mix_id", "source").agg(
        F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.max("size_factor").alias("size_factor"))
    budget = F.floor(F.greatest(F.coalesce(F.col("target_share") * F.col("size_factor"), F.lit(0.0)), F.lit(0.0)) * F.lit(total)).cast("long")
    rows = want.join(have, "source", "left").withColumn("budget", budget).fillna(0, ["source_tokens", "source_docs"])
    passes = F.when(F.col("source_tokens") > 0, F.least(F.floor(F.col("budget") / F.col("source_tokens")), F.col("max_repeats").cast("long"))).otherwise(0)
    rows = rows.withColumn("passes", F.greatest(passes, F.lit(0)).cast("int"))
    rest = F.when((F.col("passes") < F.col("max_repeats")) & (F.col("source_tokens") > 0), F.col("budget") - F.col("passes") * F.col("source_tokens")).otherwise(0)
    return rows.withColumn("rest", rest.cast("long"))


def positions(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE, seed: int = SEED) -> DataFrame:
    """Adds ``until``: the tokens of the source up to and with the document, in the source's random order.

    The order is that of a hash of the document's id. The hashes are cut into ranges, so that (source, range)
    never holds many rows even if one source holds all; range sums give each range's offset, and the sums
    within a range are a window over few rows.
    """
    n = docs.count()
    bits = max(0, (max(n, 1) // rows_per_range)).bit_length()
    placed = F.monotonically_increasing_id()  # spreads documents without an id
    key = F.when(F.col("doc").isNull(), F.xxhash64(placed, F.lit(seed))).otherwise(F.xxhash64("doc", F.lit(seed)))
    ranged = docs.withColumn("key", key).withColumn("range", (F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0)).cast("int"))
    ranged = ranged.withColumn("row", F.monotonically_increasing_id())
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    signed = F.shiftrightunsigned("key", 1)  # within a range the leading bits are equal, so this keeps the order
    within = Window.partitionBy("source", "range").orderBy(signed, "key", "doc", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(offsets, ["source", "range"])
    return placed.select("doc", "source", "tokens", (F.col("offset") + F.sum("tokens").over(within)).alias("until"))


def mix(documents: DataFrame, targets: DataFrame, id_col: str, source: str, tokens: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(mix_id, doc, source, tokens, times): how often each document is used in each mix, at least once.

    Every document of a source is used once per whole pass; the last pass takes the source's documents in random
    order up to the exact rest of the budget: a document belongs to it if at least half of it lies within. So the
    source is off its budget by half a document at most, unless the cap or a lack of documents prevents it.
    Documents without source are in no mix; those without size have 0 tokens and share their place in the order.
    Documents of equal ids are rows of their own.
    """
    docs = cut(_sized(documents, id_col, source, tokens), "mix")
    return _used(docs, cut(plan_mix(docs, targets), "plan"), rows_per_range)


def _used(docs: DataFrame, plan: DataFrame, rows_per_range: int) -> DataFrame:
    if plan.count() > 100_000:
        raise ValueError("more than 100 000 targets")
    used = F.broadcast(plan.where("passes > 0 OR rest > 0").select("mix_id", "source", "passes", "rest"))  # at most 100 000 rows
    placed = positions(docs.where("source IS NOT NULL"), rows_per_range).join(used, "source")
    extra = (F.col("until") - F.col("tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    times = F.col("passes") + extra.cast("int")
    return placed.withColumn("times", times).where("times > 0").select("mix_id", "doc", "source", "tokens", "times")


def mix_shares(documents: DataFrame, targets: DataFrame, id_col: str, source: str, tokens: Column) -> DataFrame:
    """Per mix and source: target and actual share of the mix's tokens, and why a target is missed.

    ``limit``: ``cap`` where max_repeats ends the source before its budget, ``absent`` without documents, else null.
    """
    docs = cut(_sized(documents, id_col, source, tokens), "mix")
    plan = cut(plan_mix(docs, targets), "plan")
    used = _used(docs, plan, ROWS_PER_RANGE)
    sums = used.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("times").alias("most_times"))
    rows = plan.join(sums, ["mix_id", "source"], "left").fillna(0, ["used_tokens", "used_docs", "most_times"])
    whole = F.sum("used_tokens").over(Window.partitionBy("mix_id"))  # one row per target
    limit = F.when(F.col("source_tokens") == 0, "absent").when(F.col("budget") > F.col("max_repeats") * F.col("source_tokens"), "cap")
    share = F.when(whole > 0, F.col("used_tokens") / whole)
    return rows.select("mix_id", "source", "target_share", share.alias("actual_share"), "budget", "used_tokens", "used_docs", "most_times", "max_repeats", "source_tokens", limit.alias("limit"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, table(spark, sf_dir, "mix_targets"), "doc_id", "source", byte_tokens()).withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_shares(docs, table(spark, sf_dir, "mix_targets"), "doc_id", "source", byte_tokens())


SQL: dict[str, str] = {}
QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
