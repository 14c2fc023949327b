"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gridloom import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in plans.oracle_sql():
        r = duck.execute(plans.oracle_sql()[name])
        cols = [x[0] for x in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == sorted(repr([plain(row[cols.index(c)]) for c in sorted(cols)]) for row in r.fetchall())


def test_nothing_outside_imports_the_llm_subpackage():
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "gridloom.llm" not in p.read_text() and "import llm" not in p.read_text(), p


def test_entry_point_works_without_the_llm_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'p1_found' in e.queries(), 'p7_ids' in e.queries())"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["True", "False"], out.stderr
