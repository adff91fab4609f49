"""Every catalogue query against its SQL on the smallest tables, with names and types of columns."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from loomfield import artifacts  # noqa: F401  registers the queries over files
from loomfield import queries as core

DATA = "/root/testdata/sf0.001"
SAME = {"timestamp": "TIMESTAMP", "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else repr(v)
    return sorted([value(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_matches_sql(spark, con, name):
    got = core.QUERIES[name](spark, DATA)
    want = con.execute(core.SQL[name])
    names, kinds = [d[0] for d in want.description], {d[0]: str(d[1]) for d in want.description}
    assert sorted(got.columns) == sorted(names)
    assert {c: SAME[k] for c, k in got.dtypes} == kinds
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registry_lives_without_the_subpackage(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['loomfield.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-1]) == len(core.QUERIES)
