import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["info_counts", "aabb_query", "remap_groups", "connectivity_count", "set_intersection", "concat_groups_aggregate", "trx_roundtrip"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("orders", "lineitem", "events", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    ours = entry.queries()[name](spark, SMALL)
    columns = sorted(ours.columns)
    theirs = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").df()
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in theirs.itertuples(index=False))


@pytest.mark.parametrize("name", ["stream_build", "tck_roundtrip"])
def test_files_are_in_the_shared_folder(spark, name, tmp_path, monkeypatch):
    from tractlake.operators import near

    monkeypatch.setattr(near, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert entry.queries()[name](spark, SMALL).count() > 0 and os.listdir(tmp_path / "shared")


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
