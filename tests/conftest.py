import math
import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("FLIPGRAPH_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from flipgraph.session import local_session, ship

    s = local_session(cores=4, partitions=4, memory="4g")
    ship(s)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    """A value that compares alike from Spark and DuckDB."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "asDict"):
        return repr({k: plain(x) for k, x in v.asDict().items()})
    if isinstance(v, dict):
        return repr({k: plain(x) for k, x in sorted(v.items(), key=str)})
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf):
    def check(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
        assert got == want

    return check
