"""Frequency of every distinct value or term (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipgraph.llm.common import one_per_id
from flipgraph.session import hadoop_path, new_folder
from flipgraph.sources.tables import table

#: Separators of a keyword list (fixed values).
KEYWORD_SEPARATORS = r",|;|\||<SEP>"
#: What counts as an outer blank.
BLANKS = " \t\n\x0b\f\r\x85\xa0                　"
#: Marks: at most RARE_RECORDS records; more than one in COMMON_PART of all records.
RARE_RECORDS, COMMON_PART = 2, 10

#: First split: 2 ** FIRST_BITS partitions, more for larger input but 2 ** MOST_FIRST_BITS at most; one above SPLIT_BYTES
#: on disk is split by MORE_BITS further bits, until HASH_BITS are used up.
FIRST_BITS, MOST_FIRST_BITS, MORE_BITS, HASH_BITS, SPLIT_BYTES = 4, 12, 4, 60, 64 << 20
#: Bytes of one partition that one task writes, about; larger partitions are written by several tasks.
TASK_BYTES = 256 << 20
#: Rows that a task gathers before it adds up equal terms, and DuckDB's memory for a partition.
BUFFER_ROWS, DUCK_MEMORY = 400_000, "400MB"

_COUNTED = "field string, term string, hash long, occurrences long, records long"


def clean_term(term: Column) -> Column:
    return F.lower(F.btrim(term, F.lit(BLANKS)))


def record_terms(records: DataFrame) -> DataFrame:
    """(field, term, records) with a row per occurrence; ``records`` is 1 at a term's first place in its record, else 0.

    ``records`` needs the array columns ``type`` (one term each) and ``keyword`` (lists of terms).
    Null arrays and elements and terms of blanks alone give no row.
    """

    def marked(field: str, terms: Column) -> DataFrame:
        ordered = records.select(F.array_sort(F.filter(terms, lambda t: t != "")).alias("s"))
        first = F.transform("s", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("s", i - 1) != t)).cast("long").alias("records")))
        return ordered.select(F.lit(field).alias("field"), F.inline(first))

    lists = F.flatten(F.transform(F.filter("keyword", lambda k: k.isNotNull()), lambda k: F.split(k, KEYWORD_SEPARATORS)))
    return marked("type", F.transform("type", clean_term)).unionByName(marked("keyword", F.transform(lists, clean_term)))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each term within this task's rows, so that a frequent term leaves few rows."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).group_by(["field", "term", "hash"], use_threads=False)
        yield from rows.aggregate([("records", "count"), ("records", "sum")]).rename_columns(["field", "term", "hash", "occurrences", "records"]).to_batches()

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BUFFER_ROWS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _duck(memory: str, spill: str | None):
    """GROUP BY of each partition in DuckDB. Where it may spill nowhere, a partition that does not fit is counted in
    passes over the hash values of its terms, which is slower but needs no disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                part = ds.dataset(path, filesystem=files, format="parquet")
                folder = f"{spill}/{path.strip('/').replace('/', '-')[-60:]}" if spill else ""  # empty: DuckDB spills nowhere
                with duckdb.connect(config={"threads": "1", "memory_limit": memory, "temp_directory": folder}) as con:
                    open_passes = [(1, 0)]
                    while open_passes:
                        of, at = open_passes.pop()
                        con.register("part", part.scanner(batch_size=50_000, use_threads=False).to_reader())
                        counts = con.sql(f"SELECT field, term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records FROM part WHERE hash(term) % {of} = {at} GROUP BY field, term")
                        try:
                            if spill:
                                yield from counts.to_arrow_reader(50_000)
                            else:
                                yield from counts.to_arrow_table().to_batches(50_000)  # whole, so that a failed pass gives no rows
                        except duckdb.OutOfMemoryException:
                            if spill or of >= 1 << 20:
                                raise
                            open_passes += [(2 * of, at), (2 * of, at + of)]

    return run


def _plan_bytes(df: DataFrame) -> int:
    """What Spark's plan expects the input to hold."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def radix_counts(terms: DataFrame, first_bits: int | None = None, more_bits: int = MORE_BITS, split_bytes: int = SPLIT_BYTES, memory: str = DUCK_MEMORY, expected: int | None = None) -> DataFrame:
    """(field, term, occurrences, records) of all terms, by recursive radix partitions on disk.

    terms: rows of (field, term, records), ``records`` 1 where a record's first occurrence of the term is
    counted, else 0. Each task adds up its own rows first; the sums go to the shared folder, partitioned by the
    leading bits of the term's hash, as many as the ``expected`` bytes of input ask for; all partitions of more than
    ``split_bytes`` are read again and split by the next bits in one job, until they are small or the bits are used up. Each
    partition is then one task's GROUP BY in DuckDB, which spills beyond ``memory`` into the shared folder; a shared folder
    that is no file system of the machine takes no spill, there partitions are counted in passes. No rows give no rows.
    """
    spark = terms.sparkSession
    expected = _plan_bytes(terms) if expected is None else expected
    if first_bits is None:
        first_bits = min(max(FIRST_BITS, (expected // split_bytes).bit_length()), MOST_FIRST_BITS)
    hashed = terms.select("field", "term", F.xxhash64("field", "term").alias("hash"), F.col("records").cast("long").alias("records"))
    level = hashed.mapInArrow(_add_up, _COUNTED)
    leaves, used = [], 0
    while level is not None:
        bits = first_bits if used == 0 else more_bits
        radix = F.shiftrightunsigned("hash", 64 - used - bits).bitwiseAND((1 << bits) - 1).cast("int")
        keys = ["parent", "radix"] if used else ["radix"]
        root = new_folder(spark, f"radix{used}")
        writers = min(max(1, expected // (1 << bits) // TASK_BYTES), 64)
        parts = level.withColumn("radix", radix)
        parts.repartition(*keys, F.pmod("hash", F.lit(writers))).write.partitionBy(*keys).parquet(root)
        used += bits
        # One row per partition, of which a level has at most 2 ** bits for every partition that was too large before.
        listed = spark.read.format("binaryFile").load(root).groupBy(*keys).agg(F.sum("length").alias("bytes")).orderBy(*keys).collect() if _any_file(spark, root) else []
        large = [r for r in listed if r["bytes"] > split_bytes and used + more_bits <= HASH_BITS]
        over = {tuple(r[k] for k in keys) for r in large}
        leaves += ["/".join([root, *(f"{k}={r[k]}" for k in keys)]) for r in listed if tuple(r[k] for k in keys) not in over]
        level = None
        if large:
            expected = max(r["bytes"] for r in large)
            numbers = spark.createDataFrame([(*(r[k] for k in keys), i) for i, r in enumerate(large)], ", ".join(f"{k} int" for k in keys) + ", next int")
            level = spark.read.schema(f"{_COUNTED}, " + ", ".join(f"{k} int" for k in keys)).parquet(root).join(F.broadcast(numbers), keys)
            level = level.select("field", "term", "hash", "occurrences", "records", F.col("next").alias("parent"))
    schema = "field string, term string, occurrences long, records long"
    if not leaves:
        return spark.createDataFrame([], schema)
    spill = new_folder(spark, "spill")
    local = spill.removeprefix("file://") if spill.startswith(("file:", "/")) else None
    jobs = spark.createDataFrame([(p if ":" in p else f"file://{p}",) for p in map(_uri, leaves)], "uri string").repartition(min(len(leaves), 4096), "uri")
    return jobs.mapInArrow(_duck(memory, local), schema)


def _any_file(spark: SparkSession, root: str) -> bool:
    files, path = hadoop_path(spark, root)
    return any(s.isDirectory() for s in files.listStatus(path))


def _uri(path: str) -> str:
    """Hadoop writes file:/x where others write file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def mark_terms(counts: DataFrame, n_records: int, rare: int = RARE_RECORDS, part: int = COMMON_PART) -> DataFrame:
    """Adds ``mark``: rare (at most ``rare`` records), common (more than one in ``part`` of all records), else null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * part > n_records, "common")
    return counts.withColumn("mark", mark)


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "explanations")
    ids = rows.agg(F.count_distinct("exp_id"), F.count(F.when(F.col("exp_id").isNull(), 1))).first()
    records = one_per_id(rows, "exp_id", F.col("original_subgraph.entities.type").alias("type"), F.col("original_subgraph.relations.keywords").alias("keyword"))
    return mark_terms(radix_counts(record_terms(records), expected=_plan_bytes(rows)), ids[0] + ids[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_terms(spark, sf_dir).where("mark IS NOT NULL").select("field", "term", "mark")


_TERMS = f"""
WITH r AS (SELECT DISTINCT ON (exp_id) exp_id, original_subgraph AS g FROM explanations),
e AS (SELECT exp_id, 'type' AS field, unnest(list_transform(g.entities, lambda x: x.type)) AS t FROM r),
k AS (SELECT exp_id, 'keyword' AS field, unnest(regexp_split_to_array(k, ',|;|\\||<SEP>')) AS t FROM (SELECT exp_id, unnest(list_transform(g.relations, lambda x: x.keywords)) AS k FROM r)),
t AS (SELECT exp_id, field, lower(trim(t, '{BLANKS}')) AS term FROM (SELECT * FROM e UNION ALL SELECT * FROM k) WHERE t IS NOT NULL),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT exp_id) AS records FROM t WHERE term <> '' GROUP BY 1, 2),
m AS (SELECT field, term, occurrences, records, CASE WHEN records <= {RARE_RECORDS} THEN 'rare' WHEN records * {COMMON_PART} > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)
"""

SQL = {
    "p4_terms": f"{_TERMS} SELECT field, term, occurrences, records, mark FROM m",
    "p4_found": f"{_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
}
QUERIES = {"p4_terms": p4_terms, "p4_found": p4_found}
