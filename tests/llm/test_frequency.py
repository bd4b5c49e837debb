"""Term counts against plain counting, with forced recursion of the radix split."""

import random
from collections import Counter

from flipgraph.llm import frequency as Q

SCHEMA = "rec long, type array<string>, keyword array<string>, term string, records int, hash string"


def expected(rows):
    occ, rec = Counter(), Counter()
    for _, types, keywords, *_ in rows:
        terms = [("type", t.strip(Q.BLANKS).lower()) for t in types or [] if t is not None]
        for k in keywords or []:
            if k is not None:
                parts = k.replace("<SEP>", ",").replace(";", ",").replace("|", ",").split(",")
                terms += [("keyword", p.strip(Q.BLANKS).lower()) for p in parts]
        terms = [t for t in terms if t[1]]
        occ.update(terms)
        rec.update(set(terms))
    return {(f, t, n, rec[f, t]) for (f, t), n in occ.items()}


def counted(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)
    return {(r.field, r.term, r.occurrences, r.records) for r in Q.radix_counts(Q.record_terms(df), **how).collect()}


ROWS = [
    (1, ["Person", " person ", None, "", " ", "PLACE"], ["a, B;c|d<SEP>a", None, " ; ,", "a"]),
    (2, None, None),
    (3, [], []),
    (4, ["person", "x" * 5000], ["b", "ü , Ü", "a b"]),
]


def test_small(spark):
    assert counted(spark, ROWS) == expected(ROWS)


def test_recursion_and_hot_term(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, ["hot", f"t{rnd.randrange(400)}"], [f"k{rnd.randrange(2000)}, hot, hot"]) for i in range(1500)]
    monkeypatch.setattr(Q, "BUFFER_ROWS", 500)
    want = expected(rows)
    assert counted(spark, rows, first_bits=1, more_bits=2, split_bytes=12_000) == want
    few = ROWS * 1
    assert counted(spark, few, first_bits=2, split_bytes=1, more_bits=29) == expected(few)  # bits used up


def test_empty(spark):
    assert counted(spark, []) == set()


def test_marks(spark):
    c = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 10), ("f", "d", 9, 11)], "field string, term string, occurrences long, records long")
    assert {r.term: r.mark for r in Q.mark_terms(c, 100).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}


def test_redelivered_rows_and_missing_ids_count_right(spark):
    from flipgraph.llm.common import one_per_id

    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a")], "exp_id long, t string")
    assert one_per_id(df, "exp_id", "t").count() == 3


def test_tables(same_rows):
    for name, sql in Q.SQL.items():
        same_rows(Q.QUERIES[name], sql)


def test_passes_where_duckdb_may_not_spill(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 400_000
    terms = [f"{'term' * 10}{i % (n // 2)}" for i in range(n)]
    pq.write_table(pa.table({"field": ["f"] * n, "term": terms, "hash": list(range(n)), "occurrences": [1] * n, "records": [1] * n}), tmp_path / "part.parquet")
    batch = pa.RecordBatch.from_arrays([pa.array([f"file://{tmp_path}"])], names=["uri"])
    got = pa.Table.from_batches(list(Q._duck("40MB", None)(iter([batch]))))
    assert got.num_rows == n // 2 and set(got["occurrences"].to_pylist()) == {2} and len(set(got["term"].to_pylist())) == n // 2


def test_first_split_grows_with_the_input(spark):
    terms = spark.range(50).selectExpr("'f' AS field", "concat('t', id) AS term", "1L AS records")
    seen = []
    keep = Q.new_folder
    try:
        Q.new_folder = lambda s, what: seen.append(keep(s, what)) or seen[-1]
        assert Q.radix_counts(terms, expected=100 * Q.SPLIT_BYTES).count() == 50
    finally:
        Q.new_folder = keep
    assert len({int(r.radix) for r in spark.read.parquet(seen[0]).select("radix").distinct().collect()}) > 16
