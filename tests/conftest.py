import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from gleaner.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle(sf):
    """Runs SQL over the driver's tables; rows come back with columns by name."""
    import duckdb

    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return lambda sql: c.sql(sql).df()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    return repr(round(float(v), 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same():
    """Asserts that two pandas tables hold the same rows, in any order."""

    def check(a, b):
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        rows = lambda t: sorted(tuple(map(plain, r)) for r in t[cols].astype(object).itertuples(index=False, name=None))
        assert rows(a) == rows(b)

    return check
