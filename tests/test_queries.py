"""Every query with SQL equals DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from skein.plans import catalog

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def text(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    if getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    a, b = ([i.index(c) for c in sorted(i)] for i in (df.columns, names))
    assert sorted("|".join(text(r[i]) for i in a) for r in got) == sorted("|".join(text(r[i]) for i in b) for r in want.fetchall())


def test_entry_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "skein", tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split("\n")[:2] == [" ".join(sorted(catalog.queries())), " ".join(sorted(catalog.oracle_sql()))]
