"""Data changes, definitions, transactions, files."""

import json
import multiprocessing
import sqlite3
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plainfold import DataError, IntegrityError, InterfaceError, NotSupportedError, OperationalError, ProgrammingError, connect, problems
from plainfold.sources import tables
from plainfold.sources.tables import Col, Schema, encoded, read_checked, replace_file, scan


@pytest.fixture
def conn(spark, tmp_path):
    with connect(tmp_path / "db", spark=spark, timeout=0.3) as c:
        yield c


def rows(conn, table="t"):
    return conn.execute(f"SELECT * FROM {table}").fetchall()


SCRIPTS = [
    ["UPDATE t SET score = score + 1 WHERE id > 1"], ["UPDATE t SET id = id + 1"], ["UPDATE t SET name = tag, tag = name WHERE tag IS NOT NULL"], ["DELETE FROM t WHERE score > 1"],
    ["DELETE FROM t WHERE NOT score > 1"], ["DELETE FROM t"], ["INSERT INTO t (name, id) VALUES ('x', 10), ('y', -11)", "UPDATE t SET score = 0.5 WHERE score IS NULL"],
    ["INSERT INTO t SELECT id + 100, name, score, 'copy' FROM t WHERE id IN (1, 2)"], ["UPDATE t SET tag = UPPER(name) || '!' WHERE id IN (SELECT MAX(id) FROM t)", "DELETE FROM t WHERE id IN (SELECT MIN(id) FROM t)"],
    ["UPDATE t SET score = CASE WHEN id = 1 THEN NULL ELSE 2 END"],
]


@pytest.mark.parametrize("script", SCRIPTS)
def test_changes_as_sqlite(conn, script):
    lite = sqlite3.connect(":memory:")
    start = ["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, score REAL, tag TEXT)", "INSERT INTO t VALUES (1, 'a', 1.5, 'x'), (2, 'b', NULL, NULL), (3, 'c', -2.0, 'y'), (4, 'd', 4, 'x')"]
    for sql in start:
        conn.execute(sql), lite.execute(sql)
    for sql in script:
        if "id + 1" in sql and "INSERT" not in sql:  # checked after the statement here
            lite.execute("UPDATE t SET id = -id - 1"), lite.execute("UPDATE t SET id = -id")
            assert conn.execute(sql).rowcount == 4
        else:
            assert conn.execute(sql).rowcount == lite.execute(sql).rowcount
    order = "SELECT * FROM t ORDER BY id"
    assert conn.execute(order).fetchall() == lite.execute(order).fetchall()


def test_types_and_constraints(conn):
    conn.execute("CREATE TABLE IF NOT EXISTS t (id INT, b BOOLEAN DEFAULT TRUE, r REAL DEFAULT 1, s VARCHAR(3) DEFAULT 'info', d DATE, ts DATETIME, PRIMARY KEY (id, s))")
    conn.execute("INSERT INTO t (id, d, ts) VALUES (?, ?, ?)", [1, date(2020, 1, 2), datetime(2020, 1, 2, 3, 4, 5)])
    conn.execute("INSERT INTO t VALUES (2, 0, NULL, '', '2020-12-31', '2020-01-01T05:06:07')")
    assert rows(conn) == [(1, True, 1.0, "info", "2020-01-02", "2020-01-02 03:04:05"), (2, False, None, "", "2020-12-31", "2020-01-01T05:06:07")]
    assert conn.catalog.csv("t").read_text() == "id,b,r,s,d,ts\n1,true,1.0,info,2020-01-02,2020-01-02 03:04:05\n2,false,\\N,,2020-12-31,2020-01-01T05:06:07\n"
    before = conn.catalog.csv("t").read_bytes()
    for sql, error in [
        ("INSERT INTO t (id) VALUES (1)", IntegrityError), ("INSERT INTO t (s) VALUES ('x')", IntegrityError), ("INSERT INTO t (id) VALUES ('x')", DataError), ("INSERT INTO t (id) VALUES (1.0)", DataError),
        ("INSERT INTO t (id, s) VALUES (5, 5)", DataError), ("INSERT INTO t (id, d) VALUES (5, 'x')", DataError), ("INSERT INTO t (id) VALUES (9223372036854775808)", DataError),
        ("INSERT INTO t (id, zz) VALUES (1, 2)", ProgrammingError), ("INSERT INTO t (id) VALUES (1, 2)", ProgrammingError), ("UPDATE t SET id = NULL", IntegrityError), ("UPDATE t SET id = 7, s = 'q'", IntegrityError),
        ("UPDATE t SET s = 5", DataError), ("UPDATE t SET zz = 5", ProgrammingError), ("CREATE TABLE t (a INT)", ProgrammingError), ("CREATE TABLE x (a BLOB)", NotSupportedError), ("CREATE TABLE x (a)", ProgrammingError),
        ("CREATE TABLE x (_rowid_ INT)", ProgrammingError), ("CREATE TABLE x (a INT UNIQUE)", NotSupportedError), ("CREATE TABLE x (a INT DEFAULT 'q')", DataError), ("CREATE TABLE x (a INT, a TEXT)", ProgrammingError),
        ("DROP TABLE x", ProgrammingError), ("ALTER TABLE t DROP COLUMN zz", ProgrammingError), ("CREATE VIEW v AS SELECT 1", NotSupportedError),
    ]:
        with pytest.raises(error):
            conn.execute(sql)
    assert conn.catalog.csv("t").read_bytes() == before
    assert conn.execute("INSERT INTO t (id, d) VALUES (3, CURRENT_DATE)").rowcount == 1


def test_alter(conn):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL)")
    conn.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (2, "b")])
    with pytest.raises(IntegrityError):
        conn.execute("ALTER TABLE t ADD COLUMN n INT NOT NULL")
    conn.execute("ALTER TABLE t ADD COLUMN n INT NOT NULL DEFAULT 7")
    conn.execute("ALTER TABLE t RENAME COLUMN name TO label")
    assert conn.execute("SELECT label, n FROM t ORDER BY id").fetchall() == [("a", 7), ("b", 7)]
    conn.execute("ALTER TABLE t DROP COLUMN n")
    conn.execute("ALTER TABLE t RENAME TO u")
    assert conn.catalog.names() == ["u"] and rows(conn, "u") == [(1, "a"), (2, "b")]
    for sql, error in [("ALTER TABLE u RENAME COLUMN id TO _rowid_", ProgrammingError), ("ALTER TABLE u ADD COLUMN k INT PRIMARY KEY", NotSupportedError), ("ALTER TABLE u RENAME COLUMN id TO label", ProgrammingError)]:
        with pytest.raises(error):
            conn.execute(sql)
    conn.execute("ALTER TABLE u DROP COLUMN label")
    with pytest.raises(ProgrammingError):
        conn.execute("ALTER TABLE u DROP COLUMN id")
    conn.execute("DROP TABLE u")
    conn.execute("DROP TABLE IF EXISTS u")
    assert conn.catalog.names() == []
    conn.execute("CREATE TABLE m (a INT, b INT, PRIMARY KEY (a, b))")
    conn.execute("INSERT INTO m VALUES (1, 1), (1, 2)")
    with pytest.raises(IntegrityError):
        conn.execute("ALTER TABLE m DROP COLUMN b")


def test_transactions(conn, spark):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INT)")
    conn.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, v INT)")
    conn.execute("INSERT INTO t VALUES (1, 1)")
    other = connect(conn.catalog.root, spark=spark, timeout=0.1)
    for sql in ("COMMIT", "ROLLBACK"):
        with pytest.raises(ProgrammingError):
            conn.execute(sql)
    conn.commit()
    conn.execute("BEGIN")
    conn.execute("INSERT INTO t VALUES (2, 2)")
    conn.execute("UPDATE t SET v = 9 WHERE id = 1")
    conn.execute("INSERT INTO u SELECT id, v FROM t")
    assert rows(conn) == [(1, 9), (2, 2)] and rows(other) == [(1, 1)] and conn.in_transaction
    with pytest.raises(OperationalError):
        other.execute("INSERT INTO t VALUES (3, 3)")
    for sql, error in (("BEGIN", ProgrammingError), ("CREATE TABLE x (a INT)", NotSupportedError)):
        with pytest.raises(error):
            conn.execute(sql)
    with pytest.raises(IntegrityError):
        conn.execute("INSERT INTO t VALUES (1, 1)")
    conn.execute("COMMIT")
    assert rows(other) == [(1, 9), (2, 2)] == rows(other, "u")
    conn.execute("BEGIN TRANSACTION")
    conn.execute("DELETE FROM t")
    conn.rollback()
    assert rows(conn) == rows(other) == [(1, 9), (2, 2)]
    other.execute("BEGIN")
    other.execute("DELETE FROM t")
    other.close()
    with pytest.raises(InterfaceError):
        other.execute("SELECT 1")
    assert rows(conn) == [(1, 9), (2, 2)]


def test_a_crash_after_the_journal_is_made_good(conn, spark, monkeypatch):
    for t in ("t", "u"):
        conn.execute(f"CREATE TABLE {t} (id INTEGER PRIMARY KEY)")
    conn.execute("BEGIN")
    for t in ("t", "u"):
        conn.execute(f"INSERT INTO {t} VALUES (1)")
    real = replace_file

    def failing(path, parts):
        if path.name == "u.csv":
            raise OSError("crash")
        real(path, parts)

    monkeypatch.setattr("plainfold.database.replace_file", failing)
    with pytest.raises(OSError):
        conn.commit()
    monkeypatch.undo()
    assert conn.catalog.journal.exists() and ("warning", "a journal is left over; the next connection replays it") in problems(conn.catalog.root)
    assert rows(connect(conn.catalog.root, spark=spark), "u") == [(1,)] and not conn.catalog.journal.exists()
    for text in ("{", json.dumps({"version": 2, "files": {}}), "[]"):
        conn.catalog.journal.write_text(text)
        with pytest.raises(OperationalError):
            connect(conn.catalog.root, spark=spark)


def _hold(folder, ready, done):
    from plainfold.database import Locks

    locks = Locks(folder, 1)
    locks.begin()
    ready.set()
    done.wait(20)


def test_writers_of_other_processes_wait(conn):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    context = multiprocessing.get_context("spawn")
    ready, done = context.Event(), context.Event()
    process = context.Process(target=_hold, args=(conn.locks.folder, ready, done))
    process.start()
    assert ready.wait(30)
    with pytest.raises(OperationalError):
        conn.execute("INSERT INTO t VALUES (1)")
    assert rows(conn) == []
    done.set()
    process.join()
    assert conn.execute("INSERT INTO t VALUES (1)").rowcount == 1


AWKWARD = ["", "\\N", "\\\\N", "\\", "a,b", 'q"q', "a\nb", "a\r\nb", "\r", " x ", "é😀", "NULL", "\\n", '"', '""', "\u0001", ",", "\t", "#", "--"]


@pytest.mark.parametrize("alone", [True, False])
def test_awkward_texts_round_trip(spark, tmp_path, alone):
    columns = (Col("s", "text"),) if alone else (Col("s", "text"), Col("n", "integer"), Col("r", "real"))
    schema = Schema("t", columns)
    data = [(x,) if alone else (x, i, x and 1e16 * i) for i, x in enumerate([*AWKWARD, None])]
    data = [tuple(None if v == "" and j == 2 else v for j, v in enumerate(r)) for r in data]
    path = tmp_path / "t.csv"
    replace_file(path, encoded(data, schema))
    assert [tuple(r) for _, r in read_checked(path, schema)] == data
    assert [tuple(r)[1:] for r in scan(spark, path, schema).orderBy("_rowid_").collect()] == data


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1) | st.none(), st.floats(allow_nan=False, allow_infinity=False) | st.none(), st.booleans() | st.none(), st.text(st.characters(blacklist_characters="\0", blacklist_categories=("Cs",))) | st.none(), st.dates().map(str) | st.none())))
def test_files_round_trip(tmp_path, data):
    schema = Schema("t", tuple(Col(n, k) for n, k in zip("abcde", ("integer", "real", "boolean", "text", "date"), strict=True)))
    path = tmp_path / "t.csv"
    replace_file(path, encoded(data, schema))
    assert [tuple(r) for _, r in read_checked(path, schema)] == data
    assert Schema.load(schema.dump()) == schema


@pytest.mark.parametrize("text", ["", "x,y\n", "id,n\n1\n", "id,n\n1,2,3\n", "id,n\nx,2\n", "id,n\n1,yes\n"])
def test_bad_files(conn, text):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n BOOLEAN NOT NULL)")
    conn.catalog.csv("t").write_text(text)
    with pytest.raises(OperationalError):
        conn.execute("SELECT * FROM t")
    assert [how for how, _ in problems(conn.catalog.root)] == ["error"]


@pytest.mark.parametrize("text", ["{", "[]", "version: 2", "version: 1\ntable: 3", "version: 1\ntable: t\ncolumns: {}", "version: 1\ntable: t\ncolumns: [{name: a, type: blob}]", "version: 1\ntable: t\ncolumns: [{name: a, type: text, x: 1}]", "version: 1\ntable: t\ncolumns: [3]"])
def test_bad_schemas(text):
    with pytest.raises(OperationalError):
        Schema.load(text)


def test_checker_and_paths(conn):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n TEXT NOT NULL)")
    assert problems(conn.catalog.root) == []
    conn.catalog.csv("t").write_bytes(b"id,n\r\n1,a\r\n1,\\N\r\n")
    (conn.catalog.root / "lost.csv").write_text("a\n")
    found = problems(conn.catalog.root)
    assert [how for how, _ in found] == ["error", "error", "warning", "warning"] and "line 3" in found[0][1]
    assert conn.execute("SELECT COUNT(*) FROM t").fetchall() == [(2,)]
    for name in ("../x", "a b", "1a", ""):
        with pytest.raises(ProgrammingError):
            tables.identifier(name)


def test_readers_do_not_wait_for_a_long_write(conn, spark, monkeypatch):
    """A write that takes longer than the reader's timeout, while the reader asks."""
    import threading

    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INT)")
    conn.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    other, began, over = connect(conn.catalog.root, spark=spark, timeout=0.1), threading.Event(), threading.Event()
    real = type(conn)._checked

    def slow(self, df, schema):
        began.set()
        assert over.wait(60)
        yield from real(self, df, schema)

    monkeypatch.setattr(type(conn), "_checked", slow)
    writer = threading.Thread(target=conn.execute, args=("UPDATE t SET v = 9",))
    writer.start()
    assert began.wait(60)
    lazy = other.sql("SELECT v FROM t")
    assert rows(other) == [(1, 1), (2, 2)]
    with pytest.raises(OperationalError):  # but a second writer does
        other.execute("DELETE FROM t")
    over.set()
    writer.join()
    assert rows(other) == [(1, 9), (2, 9)]
    assert sorted(r.v for r in lazy.collect()) == [1, 2]  # as the table was when it was asked for


def test_a_pending_journal_is_replayed_before_lazy_queries(conn, spark):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    other = connect(conn.catalog.root, spark=spark)
    conn.catalog.journal.write_text(json.dumps({"version": 1, "files": {"t": "id\n7\n"}}))
    assert [r.id for r in other.sql("SELECT * FROM t").collect()] == [7] and not conn.catalog.journal.exists()


def test_a_commit_broken_off_is_finished_by_another_process_of_files(conn, spark, monkeypatch):
    """What a transaction staged lies in files, and stays until the journal that names them has been replayed."""
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    conn.execute("BEGIN")
    for i in range(3):
        conn.execute("INSERT INTO t VALUES (?)", [i])
    assert len(list(conn.scratch.root.glob("*-t.csv"))) == 1
    monkeypatch.setattr(type(conn.catalog), "replay", lambda self: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        conn.commit()
    conn.close()
    monkeypatch.undo()
    with connect(conn.catalog.root, spark=spark) as other:
        assert rows(other) == [(0,), (1,), (2,)]
    assert not list((conn.catalog.root / ".plainfold").glob("journal*"))


@pytest.mark.parametrize("text, told", [
    ("id,n\n1,x\n2\n", "t.csv: line 3: 1 fields, expected 2"), ("id,n\n1,x\n\n2,y\n", "t.csv: line 3: 0 fields, expected 2"), ("id,n\n1,x,y\n", "t.csv: line 2: 3 fields, expected 2"), ("id,n\nabc,x\n", "t.csv: line 2, column 'id': not an integer: 'abc'"),
    ("id,n\n1,\"x\n", "t.csv: line 2: "), ("id,m\n1,x\n", "t.csv: header ['id', 'm'] isn't ['id', 'n']"), ("", "t.csv: the file is empty, even of a header"),
])
def test_bad_records_are_told_by_line_whatever_is_asked(conn, text, told):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n TEXT)")
    conn.catalog.csv("t").write_text(text)
    for sql in ("SELECT * FROM t", "SELECT COUNT(*) FROM t", "SELECT n FROM t WHERE n = 'z'", "DELETE FROM t"):
        with pytest.raises(OperationalError) as exc:
            conn.execute(sql)
        assert told in str(exc.value)
    assert conn.catalog.csv("t").read_text() == text


def test_line_ends_within_fields_stay(conn):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n TEXT)")
    conn.catalog.csv("t").write_bytes(b'id,n\r\n1,"x\r\ny"\r\n2,"p\nq"\r\n')
    assert rows(conn) == [(1, "x\r\ny"), (2, "p\nq")]
    conn.execute("INSERT INTO t VALUES (3, 'z')")
    assert conn.catalog.csv("t").read_bytes() == b'id,n\n1,"x\r\ny"\n2,"p\nq"\n3,z\n'


@pytest.mark.parametrize("split", [1, 7, 64, 1000])
def test_files_are_scanned_in_pieces(spark, tmp_path, monkeypatch, split):
    schema = Schema("t", (Col("n", "integer"), Col("s", "text")))
    data = [(i, AWKWARD[i % len(AWKWARD)] * (1 + i % 3)) for i in range(60)]
    path = tmp_path / "t.csv"
    replace_file(path, encoded(data, schema))
    monkeypatch.setattr(tables, "SPLIT", split if split > 1 else 200)
    df = scan(spark, path, schema)
    assert [tuple(r)[1:] for r in df.orderBy("_rowid_").collect()] == data
    assert [r[0] for r in df.orderBy("_rowid_").select("_rowid_").collect()] == list(range(60))
    replace_file(path, [*encoded(data, schema), "x,y\n"])
    with pytest.raises(Exception, match="line 62, column 'n'"):
        scan(spark, path, schema).collect()


def test_values_of_queries_are_checked_as_constants_are(conn):
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, b BOOLEAN, d DATE, ts DATETIME, s TEXT NOT NULL DEFAULT 'x')")
    conn.execute("INSERT INTO t (id, b, d, ts) SELECT 1, 1, '2020-02-29', '2020-02-29T01:02:03.5'")
    conn.execute("INSERT INTO t (id, d, ts) SELECT 2, CAST('2020-01-01' AS DATE), CAST('2020-01-01 10:00:00' AS DATETIME)")
    assert rows(conn) == [(1, True, "2020-02-29", "2020-02-29T01:02:03.5", "x"), (2, None, "2020-01-01", "2020-01-01 10:00:00", "x")]
    for sql, error in [
        ("INSERT INTO t (id, b) SELECT 3, 2", DataError), ("INSERT INTO t (id, d) SELECT 3, '2021-02-29'", DataError), ("INSERT INTO t (id, ts) SELECT 3, 'noon'", DataError), ("INSERT INTO t (id, s) SELECT 3, NULL", IntegrityError),
        ("INSERT INTO t (id, d) SELECT 3, 5", DataError), ("UPDATE t SET d = s", DataError), ("UPDATE t SET s = NULLIF(s, 'x')", IntegrityError), ("UPDATE t SET id = 1.5", DataError), ("INSERT INTO t (id) SELECT 1", IntegrityError), ("INSERT INTO t (id) SELECT 3, 4", ProgrammingError),
    ]:
        with pytest.raises(error):
            conn.execute(sql)
    assert len(rows(conn)) == 2
