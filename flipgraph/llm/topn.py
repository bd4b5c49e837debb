"""Top N items within every group (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.sources.tables import table

#: Rows that a task gathers before it reduces them to N per group.
BUFFER_ROWS = 200_000


def order_codes(scores: np.ndarray, items: pa.Array) -> np.ndarray:
    """Distinct-preserving integer codes: a higher code is a higher score, or an equal score and a lower item.

    Items compare by their UTF-8 bytes, which is the order of code points. Items must not be null.
    """
    ranked = np.unique(scores + 0.0, return_inverse=True)[1].astype(np.int64)
    coded = items.dictionary_encode()
    order = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return ranked * len(order) + (len(order) - 1 - place[coded.indices.to_numpy()])


def bisect_cutoffs(groups: np.ndarray, codes: np.ndarray, n_groups: int, n: int) -> np.ndarray:
    """Per group, a cutoff such that exactly min(n, size) of its codes lie above it; codes differ within a group.

    All groups are bisected at once: each round counts the rows above every open group's midpoint, and rows
    that a round has put above or below their group's bracket take no part in the next.
    """
    low = np.full(n_groups, -1, np.int64)
    cutoff = low.copy()
    size = np.bincount(groups, minlength=n_groups)
    open_groups = size > n
    if n <= 0:
        return np.full(n_groups, np.iinfo(np.int64).max)
    high = np.full(n_groups, codes.max(initial=-1), np.int64)
    above = np.zeros(n_groups, np.int64)  # rows above ``high``
    keep = open_groups[groups]
    g, c = groups[keep], codes[keep]
    while len(g):
        middle = (low + high) >> 1
        upper = c > middle[g]
        count = above + np.bincount(g[upper], minlength=n_groups)
        done = open_groups & (count == n)
        cutoff[done] = middle[done]
        open_groups &= ~done
        more = open_groups & (count > n)
        less = open_groups & (count < n)
        low[more] = middle[more]
        high[less] = middle[less]
        above[less] = count[less]
        keep = open_groups[g] & np.where(more[g], upper, ~upper)
        g, c = g[keep], c[keep]
    return cutoff


def reduce_groups(rows: pa.Table, n: int) -> pa.Table:
    """The best ``n`` items of each group, an item once with its highest score, best first within a group."""
    once = rows.group_by(["grp", "item"], use_threads=False).aggregate([("score", "max")])
    once = once.rename_columns(["grp", "item", "score"])
    if not len(once):
        return once
    coded = once["grp"].combine_chunks().dictionary_encode(null_encoding="encode")
    groups, n_groups = coded.indices.to_numpy(), len(coded.dictionary)
    codes = order_codes(once["score"].to_numpy(), once["item"].combine_chunks())
    kept = np.flatnonzero(codes > bisect_cutoffs(groups, codes, n_groups, n)[groups])
    return once.take(kept[np.lexsort((-codes[kept], groups[kept]))])


def _local(n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BUFFER_ROWS:
                yield from reduce_groups(pa.Table.from_batches(held), n).cast(schema).to_batches()
                held, size = [], 0
        if held:
            yield from reduce_groups(pa.Table.from_batches(held), n).cast(schema).to_batches()

    return run


def _final(n: int, schema: pa.Schema):
    """Rows arrive sorted by group: all but the last group of the buffer are complete."""

    def finish(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        best = reduce_groups(rows, n)
        if len(best):
            coded = best["grp"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.r_[True, coded[1:] != coded[:-1]])
            place = np.arange(len(coded)) - np.repeat(first, np.diff(np.r_[first, len(coded)])) + 1
            yield from best.append_column("place", pa.array(place, pa.int32())).select(schema.names).cast(schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, limit = None, BUFFER_ROWS
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            if len(rest) < limit:
                continue
            grp = rest["grp"].combine_chunks()
            last = grp[-1].as_py()
            same = grp.is_null() if last is None else pc.fill_null(pc.equal(grp, last), False)
            yield from finish(rest.filter(pc.invert(same)))
            rest = reduce_groups(rest.filter(same), n)
        if rest is not None:
            yield from finish(rest)

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, place, item, score): the ``n`` items with the highest scores of each group, places from 1.

    Equal scores are ordered by ascending item, by code points; 0.0 equals -0.0. An item counts once per
    group, with its highest score. Null and NaN scores and null items never count; a null group is a group.
    Empty input gives no rows. Other columns are ignored, whatever their names.

    Every task bisects the cutoffs of all groups in its own rows and passes on at most ``n`` rows per group
    and buffer, so a group of any size leaves few rows; these are shuffled by group and bisected again.
    """
    kind = df.schema[group].dataType
    rows = df.select(F.col(group).alias("grp"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where("item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.schema)
    best = rows.mapInArrow(_local(n, arrow), rows.schema)
    placed = best.selectExpr("grp", "0 AS place", "item", "score").schema
    best = best.repartition("grp").sortWithinPartitions("grp").mapInArrow(_final(n, to_arrow_schema(placed)), placed)
    return best.select(F.col("grp").cast(kind).alias(group), "place", F.col("item").alias(item), F.col("score").alias(score))


def scored_elements(attributions: DataFrame) -> DataFrame:
    """(run_id, element_id, score) of all rows; re-delivered rows need no removal as an element counts once."""
    return attributions.select("run_id", F.explode("shapley_scores").alias("element_id", "score"))


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_group(scored_elements(table(spark, sf_dir, "attributions")), "run_id", "element_id", "score", 3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_top(spark, sf_dir).select("run_id", "place", "element_id")


_BEST = """
WITH x AS (SELECT run_id, unnest(map_keys(shapley_scores)) AS element_id, unnest(map_values(shapley_scores)) AS score FROM attributions),
y AS (SELECT run_id, element_id, max(score + 0.0) AS score FROM x WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
z AS (SELECT run_id, element_id, score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC, element_id) AS INT) AS place FROM y)
"""

SQL = {
    "p5_top": f"{_BEST} SELECT run_id, place, element_id, score FROM z WHERE place <= 3",
    "p5_found": f"{_BEST} SELECT run_id, place, element_id FROM z WHERE place <= 3",
}
QUERIES = {"p5_top": p5_top, "p5_found": p5_found}
