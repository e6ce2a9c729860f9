"""Every candle query against its SQL twin on the smallest tables; the entry works without the text subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tickforge.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent
FITS = ("q20_logit_table", "q35_fit_by_symbol", "q37_walk_forward")


def norm(frame, columns):
    frame = frame[sorted(columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    rows = [tuple(None if x is None or x != x else str(float(x)) if isinstance(x, (int, float)) else str(x) for x in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    folder = SF if name not in FITS else "/root/testdata/sf0.01"  # the smallest tables have too few rows to fit
    got = registry.QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert norm(got, got.columns) == norm(want, got.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tickforge"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "tickforge").mkdir()
    for p in (ROOT / "tickforge").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "tickforge" / p.name)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 24 and not any(k.startswith('op') for k in e.queries())"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    run()
    (tmp_path / "tickforge" / "llm" / "__pycache__").mkdir(parents=True)  # a folder left over
    (tmp_path / "corpus_pipeline.py").write_text("import tickforge.llm.queries")
    run()
