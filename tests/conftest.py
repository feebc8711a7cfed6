import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local, ship

    s = local(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(frame):
    """Rows as sorted tuples of text, columns by name, so that two engines' results compare."""
    import pandas as pd

    def text(x):
        if hasattr(x, "__len__") and not isinstance(x, (str, bytes, dict)):
            return "[" + ",".join(text(v) for v in x) + "]"
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False))
