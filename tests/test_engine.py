"""Cases that go through a connection, against DuckDB; the driver runs all of them over larger tables."""

from types import SimpleNamespace

import duckdb
import pytest

from plainfold import connect
from plainfold.plans import engine

SF = "/root/testdata/sf0.001"
SOME = [*engine.SESSIONS, "key_uniqueness", "changes_with_subqueries", "transaction_commit", "several_alterations", "boolean_arithmetic"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_duckdb(spark, name):
    db = duckdb.connect()
    for table in (*engine.DEFINED, "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = engine.queries()[name](spark, SF)
    want = db.execute(engine.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    plain = lambda rows, of: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[of.index(c)] for c in columns)]) for r in rows)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_rows_of_a_dataframe_are_appended(spark, tmp_path):
    with connect(tmp_path / "db", spark=spark) as conn:
        conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v REAL DEFAULT 0.5)")
        assert conn.append("t", spark.range(3), ["id"]) == 3 and conn.append("t", spark.range(3, 4).selectExpr("id", "id / 2")) == 1
        assert conn.execute("SELECT * FROM t").fetchall() == [(0, 0.5), (1, 0.5), (2, 0.5), (3, 1.5)]
    assert not list((tmp_path / "db/.plainfold").glob("scratch-*"))


def test_folders_of_dead_processes_go(spark, tmp_path):
    with connect(tmp_path / "db", spark=spark):
        pass
    dead, mine = tmp_path / "db/.plainfold/scratch-99999999-x", tmp_path / "db/.plainfold/scratch-1-x"
    dead.mkdir(), mine.mkdir()
    connect(tmp_path / "db", spark=spark).close()
    assert not dead.exists() and mine.exists()


def test_a_database_must_be_where_files_can_be_locked():
    def session(root, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=SimpleNamespace(master=master))

    for root, master in (("s3://bucket/x", "local[4]"), (None, "yarn")):
        with pytest.raises(ValueError):
            engine.folder(session(root, master))
    assert engine.folder(session(None, "local[4]")).is_dir()
