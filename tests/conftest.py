import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quernstone import session

    shared = tmp_path_factory.mktemp("shared")
    s = session.build("local[8]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "quantize"):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def same_rows():
    """Compares a DataFrame with a DuckDB relation: columns by name, rows in any order."""

    def compare(df, relation):
        columns = sorted(df.columns)
        names = list(relation.columns)
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
        assert left == right
        return len(left)

    return compare
