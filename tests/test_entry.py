"""The registered queries against their SQL on the smallest tables, and the optional part."""

import glob
import os
import subprocess
import sys

import pytest

import __spark_entry__
from lodestone.plans import catalogue

DATA = "/root/testdata/sf0.001"
FAST = ["profiles", "compositions", "cdist_bc", "projection_weighted", "radius_distances", "co_occurrence", "split_exact_totals", "orthology_counts", "u_statistics", "p3_found", "connected_components"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(catalogue.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    for c in got.columns:
        if str(got[c].dtype).startswith(("int", "Int")) and str(want[c].dtype).startswith("float"):
            got[c] = got[c].astype(float)
        if str(want[c].dtype).startswith(("int", "Int")) and str(got[c].dtype).startswith("float"):
            want[c] = want[c].astype(float)
    assert rows(got) == rows(want)


def test_sql_is_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_works_without_the_optional_part():
    code = "import sys\nsys.modules['lodestone.llm'] = None\nimport __spark_entry__ as e\nassert 'p3_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__))).returncode == 0
