import importlib.util
from pathlib import Path

import pytest

SPEC = importlib.util.spec_from_file_location("__spark_entry__", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
ENTRY = importlib.util.module_from_spec(SPEC)
SPEC.loader.exec_module(ENTRY)


def test_names():
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())
    assert all(callable(q) for q in ENTRY.queries().values())


def test_flagship(spark):
    assert ENTRY.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["url_dedup_first", "story_categories", "same_story_edges", "stream_dedup", "context_budget"])
def test_sql_gives_the_same_rows(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    df = ENTRY.queries()[name](spark, small)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(f"select {', '.join(columns)} from ({ENTRY.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want))
