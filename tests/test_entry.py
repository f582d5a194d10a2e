"""The driver's entry points, with and without the operators for training data."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from papyra.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted([show(r[c]) for c in cols] for r in df.collect()) == sorted([show(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("orders, heavy", [(0, False), (30, False), (10**9, True)])
def test_network_summary_without_heavy_edges(spark, tmp_path, orders, heavy):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.where(f"l_orderkey < {orders}") if t == "lineitem" else df).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalog.queries()["audit_network_summary"](spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()["audit_network_summary"]).fetchall()
    assert [tuple(r) for r in got.collect()] == want and (want[0][got.columns.index("g3_total_edge_weight")] is not None) == heavy


def test_imports_without_training_operators(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    package = tmp_path / "papyra"
    package.mkdir()
    for p in (root / "papyra").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert 'cooc_edges' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
