"""Queries that go through the engine: a database filled from the driver's tables, statements run on it by its connection, and
what it holds or says afterwards.

``CASES`` has, by name, the tables to fill in (with their columns), the statements, the question asked at the end and the
DuckDB text that must give the same rows. A statement that must fail stands with the name of its error; that it fails so,
and changes nothing, is part of the case. ``SESSIONS`` has cases that take more than one connection or are no statements;
they give rows of what was seen.
"""

from __future__ import annotations

import atexit
import io
import json
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import Error, connect, problems, tools
from ..database import Connection
from ..sources import tables as files
from ..sources.tables import Col, Schema, encoded, read_checked, replace_file

#: table: definition of its columns, in the order of the driver's tables.
DEFINED = {
    "region": "r_regionkey INTEGER PRIMARY KEY, r_name TEXT NOT NULL",
    "nation": "n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER DEFAULT 0",
    "supplier": "s_suppkey INTEGER PRIMARY KEY, s_name TEXT NOT NULL, s_nationkey INTEGER, s_acctbal REAL DEFAULT 1.5",
    "customer": "c_custkey INTEGER PRIMARY KEY, c_name TEXT NOT NULL, c_nationkey INTEGER, c_acctbal REAL, c_mktsegment TEXT DEFAULT 'none'",
    "part": "p_partkey INTEGER PRIMARY KEY, p_name TEXT, p_brand TEXT, p_type TEXT, p_size INTEGER, p_retailprice REAL",
    "labels": "doc_id INTEGER PRIMARY KEY, quality INTEGER, toxic BOOLEAN NOT NULL DEFAULT FALSE",
}


def folder(spark: SparkSession) -> Path:
    """A new folder for a database: below spark.checkpoint.dir where that is a path of this machine, which all executors
    share; a temporary one where it's unset and they all run here. It goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    at = urlparse(root or "")
    if root and at.scheme not in ("", "file"):
        raise ValueError(f"a database needs a folder that files can be locked and renamed in, not {root}")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if root:
        Path(at.path).mkdir(parents=True, exist_ok=True)
    out = Path(tempfile.mkdtemp(prefix="plainfold-db-", dir=at.path if root else None))
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def filled(spark: SparkSession, sf_dir: str, *names: str, strict: bool = False) -> Connection:
    """A database that holds these of the driver's tables."""
    conn = connect(folder(spark) / "db", spark=spark, strict=strict)
    conn.spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for name in names:
        conn.execute(f"CREATE TABLE {name} ({DEFINED[name]})")
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(c.split()[0] for c in DEFINED[name].split(", ")))
        conn.append(name, rows.orderBy(rows.columns[0]))
    return conn


def error(act: Callable) -> str:
    """The name of the error that ``act`` ends in; empty without one."""
    try:
        act()
    except Error as exc:
        return type(exc).__name__
    return ""


def case(spark: SparkSession, sf_dir: str, names: str, statements: list, question: str) -> DataFrame:
    conn = filled(spark, sf_dir, *names.split())
    for x in statements:
        sql, want, params = (*x, None)[:3] if isinstance(x, tuple) else (x, "", None)
        got = error(lambda sql=sql, params=params: conn.execute(sql, params))
        if got != want:
            raise AssertionError(f"{sql}: {got or 'no error'} instead of {want or 'none'}")
    return conn.sql(question)


SUPPLIER = "s_suppkey::bigint s_suppkey, s_name, s_nationkey::bigint s_nationkey, s_acctbal"
NATION = "n_nationkey::bigint n_nationkey, n_name, n_regionkey::bigint n_regionkey"
REGION = "SELECT r_regionkey::bigint AS r_regionkey, r_name FROM region"

#: name: tables, statements (text, or text and the error's name), question, DuckDB's text.
CASES: dict[str, tuple[str, list, str, str]] = {
    "insert_values": ("region", ["INSERT INTO region VALUES (100, 'north'), (-101, 'it''s, \"far\"')", "INSERT INTO region (r_name, r_regionkey) VALUES ('\\N', (102))"], "SELECT * FROM region",
        REGION + " UNION ALL VALUES (100, 'north'), (-101, 'it''s, \"far\"'), (102, '\\N')"),
    "insert_expressions": ("region", ["INSERT INTO region VALUES (50 + 3 * 2, UPPER('a') || 'b'), (7 / 2 + 90, CASE WHEN 1 > 2 THEN 'x' ELSE LENGTH('four') END || '')"], "SELECT * FROM region",
        REGION + " UNION ALL VALUES (56, 'Ab'), (93, '4')"),
    "insert_select_result": ("supplier", ["INSERT INTO supplier (s_suppkey, s_name) SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_acctbal < 0"], "SELECT * FROM supplier",
        f"SELECT {SUPPLIER} FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, NULL, 1.5 FROM supplier WHERE s_acctbal < 0"),
    "insert_select_limit": ("supplier", ["INSERT INTO supplier SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3"], "SELECT * FROM supplier",
        f"SELECT {SUPPLIER} FROM supplier UNION ALL (SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3)"),
    "insert_defaults": ("nation", ["INSERT INTO nation (n_nationkey) VALUES (100)", "INSERT INTO nation VALUES (101, 'x', NULL)"], "SELECT * FROM nation",
        f"SELECT {NATION} FROM nation UNION ALL VALUES (100, NULL, 0), (101, 'x', NULL)"),
    "insert_arity_errors": ("region", [("INSERT INTO region VALUES (100)", "ProgrammingError"), ("INSERT INTO region (r_regionkey) VALUES (100, 'x')", "ProgrammingError"), ("INSERT INTO region (nope) VALUES (1)", "ProgrammingError"), ("INSERT INTO region SELECT 1", "ProgrammingError")], "SELECT * FROM region", REGION),
    "row_validation": ("labels", [("INSERT INTO labels VALUES ('x', 1, TRUE)", "DataError"), ("INSERT INTO labels VALUES (-1, 1.5, TRUE)", "DataError"), ("INSERT INTO labels VALUES (-1, 1, 2)", "DataError"), ("INSERT INTO labels VALUES (-1, 1, NULL)", "IntegrityError"),
        ("INSERT INTO labels SELECT doc_id, 'one', toxic FROM labels", "DataError"), ("INSERT INTO labels SELECT 0 - doc_id - 1, quality, NULLIF(toxic, TRUE) FROM labels", "IntegrityError"), ("UPDATE labels SET toxic = 3", "DataError"), "INSERT INTO labels VALUES (-1, NULL, 1)"],
        "SELECT * FROM labels", "SELECT doc_id, quality::bigint AS quality, toxic = 1 AS toxic FROM labels UNION ALL VALUES (-1, NULL, TRUE)"),
    "key_uniqueness": ("region nation", [("INSERT INTO region VALUES (0, 'twice')", "IntegrityError"), ("INSERT INTO region VALUES (100, 'a'), (100, 'b')", "IntegrityError"), ("UPDATE region SET r_regionkey = 7", "IntegrityError"), "UPDATE region SET r_regionkey = r_regionkey + 1",
        "CREATE TABLE pair (a INT, b INT, PRIMARY KEY (a, b))", "INSERT INTO pair SELECT n_regionkey, n_nationkey FROM nation", ("INSERT INTO pair SELECT n_regionkey, n_nationkey FROM nation LIMIT 1", "IntegrityError")],
        "SELECT r.r_regionkey, r.r_name, p.b FROM region r LEFT JOIN pair p ON p.a = r.r_regionkey", "SELECT (r.r_regionkey + 1)::bigint AS r_regionkey, r.r_name, n.n_nationkey::bigint AS b FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey + 1"),
    "update_result": ("supplier", ["UPDATE supplier SET s_acctbal = s_acctbal + 100, s_name = UPPER(s_name) || s_acctbal WHERE NULLIF(s_nationkey, 3) > 5"], "SELECT s_suppkey, s_nationkey, s_acctbal, LENGTH(s_name) AS n FROM supplier",
        "SELECT s_suppkey::bigint AS s_suppkey, s_nationkey::bigint AS s_nationkey, CASE WHEN s_nationkey > 5 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey > 5 THEN length(upper(s_name) || s_acctbal) ELSE length(s_name) END AS n FROM supplier"),
    "update_swaps_and_positions": ("nation", ["UPDATE nation SET n_regionkey = n_nationkey, n_nationkey = n_regionkey * 100 + n_nationkey", "UPDATE nation SET n_name = NULL WHERE n_regionkey IN (SELECT MAX(n_regionkey) FROM nation)"], "SELECT * FROM nation",
        "SELECT (n_regionkey * 100 + n_nationkey)::bigint AS n_nationkey, CASE WHEN n_nationkey < (SELECT max(n_nationkey) FROM nation) THEN n_name END AS n_name, n_nationkey::bigint AS n_regionkey FROM nation"),
    "delete_result": ("nation", ["DELETE FROM nation WHERE NULLIF(n_regionkey, 1) >= 2"], "SELECT * FROM nation", f"SELECT {NATION} FROM nation WHERE n_regionkey < 2"),
    "delete_all_rows": ("nation", ["DELETE FROM nation"], "SELECT COUNT(*) AS n FROM nation", "SELECT 0::bigint AS n"),
    "changes_with_subqueries": ("nation supplier", ["DELETE FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)", "UPDATE nation SET n_regionkey = -1 WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"], "SELECT * FROM nation",
        "SELECT n_nationkey::bigint AS n_nationkey, n_name, (CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN -1 ELSE n_regionkey END)::bigint AS n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)"),
    "refused_changes": ("region", [("UPDATE region SET r_name = 'x' FROM region", "NotSupportedError"), ("UPDATE region SET (r_name) = ('x')", "NotSupportedError"), ("INSERT OR IGNORE INTO region VALUES (0, 'x')", "NotSupportedError"), ("DELETE FROM region RETURNING r_name", "NotSupportedError"), ("INSERT INTO region DEFAULT VALUES", "NotSupportedError")], "SELECT * FROM region", REGION),
    "create_table": ("region", ["CREATE TABLE t (id BIGINT PRIMARY KEY, name VARCHAR(10) NOT NULL, price REAL DEFAULT -0.5, ok BOOL, day DATE, at TIMESTAMP)", "CREATE TABLE IF NOT EXISTS t (x INT)", "INSERT INTO t (id, name, ok, day, at) SELECT r_regionkey, r_name, r_regionkey > 1, '2020-02-29', '2020-02-29 01:02:03' FROM region", ("CREATE TABLE t (x INT)", "ProgrammingError")], "SELECT * FROM t",
        "SELECT r_regionkey::bigint AS id, r_name AS name, -0.5::double AS price, r_regionkey > 1 AS ok, '2020-02-29' AS day, '2020-02-29 01:02:03' AS at FROM region"),
    "default_validation": ("region", [("CREATE TABLE t (a INT DEFAULT 'x')", "DataError"), ("CREATE TABLE t (a DATE DEFAULT '2020-13-01')", "DataError"), ("CREATE TABLE t (a INT DEFAULT (1 + 1))", "NotSupportedError"), "CREATE TABLE t (a INT PRIMARY KEY, b DATE DEFAULT '2020-01-31')", "INSERT INTO t (a) SELECT r_regionkey FROM region"], "SELECT * FROM t", "SELECT r_regionkey::bigint AS a, '2020-01-31' AS b FROM region"),
    "refused_definitions": ("region", [("CREATE TABLE t (a BLOB)", "NotSupportedError"), ("CREATE TABLE t (a INT UNIQUE)", "NotSupportedError"), ("CREATE TABLE t (_rowid_ INT)", "ProgrammingError"), ("CREATE TABLE t (a INT, a INT)", "ProgrammingError"), ("CREATE TABLE t AS SELECT 1", "NotSupportedError"), ("CREATE VIEW v AS SELECT 1", "NotSupportedError"), ("CREATE INDEX i ON region (r_name)", "NotSupportedError"), ("SELECT * FROM t", "ProgrammingError")], "SELECT * FROM region", REGION),
    "drop_table": ("region nation", ["DROP TABLE region", "DROP TABLE IF EXISTS region", ("DROP TABLE region", "ProgrammingError"), ("SELECT * FROM region", "ProgrammingError")], "SELECT * FROM nation", f"SELECT {NATION} FROM nation"),
    "alter_add_default": ("region", ["ALTER TABLE region ADD COLUMN note TEXT DEFAULT 'new'", "ALTER TABLE region ADD COLUMN n INT", ("ALTER TABLE region ADD COLUMN m INT NOT NULL", "IntegrityError"), ("ALTER TABLE region ADD COLUMN k INT PRIMARY KEY", "NotSupportedError"), ("ALTER TABLE region ADD COLUMN n INT", "ProgrammingError"), "INSERT INTO region (r_regionkey, r_name) VALUES (9, 'x')"], "SELECT * FROM region",
        "SELECT r_regionkey::bigint AS r_regionkey, r_name, 'new' AS note, NULL::bigint AS n FROM region UNION ALL VALUES (9, 'x', 'new', NULL)"),
    "drop_column": ("nation", ["ALTER TABLE nation DROP COLUMN n_name", ("ALTER TABLE nation DROP COLUMN n_name", "ProgrammingError"), "ALTER TABLE nation DROP COLUMN n_nationkey", ("ALTER TABLE nation DROP COLUMN n_regionkey", "ProgrammingError")], "SELECT * FROM nation", "SELECT n_regionkey::bigint AS n_regionkey FROM nation"),
    "rename_column": ("region", ["ALTER TABLE region RENAME COLUMN r_name TO name", ("ALTER TABLE region RENAME COLUMN name TO r_regionkey", "ProgrammingError"), ("ALTER TABLE region RENAME COLUMN name TO _rowid_", "ProgrammingError"), ("INSERT INTO region (r_regionkey) VALUES (100)", "IntegrityError")], "SELECT * FROM region", "SELECT r_regionkey::bigint AS r_regionkey, r_name AS name FROM region"),
    "rename_table": ("region nation", [("ALTER TABLE region RENAME TO nation", "ProgrammingError"), "ALTER TABLE region RENAME TO area", ("SELECT * FROM region", "ProgrammingError")], "SELECT * FROM area", REGION),
    "several_alterations": ("region", ["ALTER TABLE region ADD COLUMN a INT DEFAULT 5, DROP COLUMN r_name, RENAME COLUMN a TO b"], "SELECT * FROM region", "SELECT r_regionkey::bigint AS r_regionkey, 5::bigint AS b FROM region"),
    "transaction_commit": ("region nation", ["BEGIN", "DELETE FROM nation WHERE n_regionkey > 1", "INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation", "UPDATE region SET r_name = 'old' WHERE r_regionkey < 100", "COMMIT", ("COMMIT", "ProgrammingError")], "SELECT * FROM region",
        "SELECT r_regionkey::bigint AS r_regionkey, 'old' AS r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey <= 1"),
    "transaction_rollback": ("region", ["BEGIN TRANSACTION", ("BEGIN", "ProgrammingError"), "DELETE FROM region", ("INSERT INTO region VALUES (1, NULL)", "IntegrityError"), "ROLLBACK", ("ROLLBACK", "ProgrammingError")], "SELECT * FROM region", REGION),
    "transaction_refuses_definitions": ("region", ["BEGIN", "INSERT INTO region VALUES (100, 'x')", ("CREATE TABLE t (a INT)", "NotSupportedError"), ("DROP TABLE region", "NotSupportedError"), ("ALTER TABLE region ADD COLUMN a INT", "NotSupportedError"), "COMMIT"], "SELECT * FROM region", REGION + " UNION ALL VALUES (100, 'x')"),
    "bound_parameters": ("part", [("SELECT ?", "ProgrammingError", []), ("SELECT ?", "ProgrammingError", [1, 2]), ("SELECT :a", "ProgrammingError", {}), ("SELECT ?", "ProgrammingError", {"a": 1}), ("SELECT ?", "ProgrammingError", [object()]), ("SELECT :a", "", {"a": 1, "more": 2}), ("INSERT INTO part (p_partkey, p_name, p_retailprice) VALUES (?, ?, ?)", "", [-1, "o'\\Neil ?", 1e16])],
        "SELECT p_partkey, p_name, p_size, p_retailprice FROM part", "SELECT p_partkey, p_name, p_size::bigint AS p_size, p_retailprice FROM part UNION ALL VALUES (-1, 'o''\\Neil ?', NULL, 1e16)"),
    "refused_statements": ("region", [("", "ProgrammingError"), ("SELECT 1; SELECT 2", "ProgrammingError"), ("SELECT FROM", "ProgrammingError"), ("EXPLODE region", "NotSupportedError"), ("SELECT nope FROM region", "ProgrammingError"), ("SELECT * FROM region ORDER BY 9", "ProgrammingError"), ("SELECT DISTINCT r_name FROM region ORDER BY r_regionkey + 1", "NotSupportedError"),
        ("SELECT r_name FROM region UNION SELECT r_name FROM region ORDER BY nope", "ProgrammingError"), ("SELECT r_regionkey / 0 FROM region", "OperationalError"), ("SELECT 1 % 0", "OperationalError"), ("SELECT r_name FROM region LIMIT 1 + 1", "NotSupportedError")], "SELECT * FROM region", REGION),
    "boolean_arithmetic": ("labels", [], "SELECT SUM(toxic) AS s, AVG(toxic) AS a, SUM(toxic * 2 + 1) AS t, SUM(CASE toxic WHEN 1 THEN 10 ELSE 20 END) AS c, SUM(CASE WHEN toxic BETWEEN 0 AND 0 THEN 1 ELSE 0 END) AS b, SUM(CASE WHEN toxic IN (1, 5) THEN 1 ELSE 0 END) AS i FROM labels",
        "SELECT sum(toxic)::bigint AS s, avg(toxic) AS a, sum(toxic * 2 + 1)::bigint AS t, sum(CASE WHEN toxic = 1 THEN 10 ELSE 20 END)::bigint AS c, count_if(toxic = 0)::bigint AS b, count_if(toxic = 1)::bigint AS i FROM labels"),
}


# Cases that take more: each gives rows of what was seen, (step, seen), or a table.


def seen(spark: SparkSession, *rows: tuple[str, object]) -> DataFrame:
    return spark.createDataFrame([(step, str(x)) for step, x in rows], "step string, seen string")


def values(*rows: tuple[str, str]) -> str:
    """DuckDB's text of such rows; what is seen is an SQL expression that gives text."""
    return " UNION ALL ".join(f"SELECT '{step}' AS step, {x} AS seen" for step, x in rows)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a canonical file and scanned in many pieces."""
    schema = Schema("part", tuple(Col(c.split()[0], {"INTEGER": "integer", "TEXT": "text", "REAL": "real"}[c.split()[1]]) for c in DEFINED["part"].split(", ")))
    path = folder(spark) / "part.csv"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(*schema.names).withColumn("p_name", F.concat("p_name", F.lit('\r\n"x",\n')))
    replace_file(path, encoded((tuple(r) for r in rows.toLocalIterator()), schema))
    was, files.SPLIT = files.SPLIT, 1 << 14
    try:
        return files.scan(spark, path, schema).drop(files.ROWID)
    finally:
        files.SPLIT = was


def csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told about malformed files; unselected columns are checked, too."""
    conn = filled(spark, sf_dir, "region")
    path = conn.catalog.csv("region")
    good, out = path.read_text(), []
    for step, text in {
        "short": good + "9\n", "long": good + "9,x,y\n", "value": good + "x,y\n", "header": "a,b\n", "empty": "", "blank": good + "\n", "quote": good + '9,"x\n',
    }.items():
        path.write_text(text)
        try:
            conn.execute("SELECT COUNT(*) FROM region")
            out.append((step, "no error"))
        except Error as exc:
            told = str(exc)
            out.append((step, f"{type(exc).__name__} {'line 7' in told} {'r_regionkey' in told} {'header' in told}"))
    path.write_bytes(b'r_regionkey,r_name\r\n1,"a\r\nb"\r\n2,c\r\n')
    out.append(("crlf", conn.execute("SELECT * FROM region").fetchall()))
    return seen(spark, *out)


def canonical_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a table file that the engine wrote."""
    conn = filled(spark, sf_dir, "part")
    conn.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, b TEXT, q TEXT, n INTEGER)")
    conn.execute("INSERT INTO t SELECT p_partkey, NULLIF(p_brand, 'Brand#11'), p_name || ',\"', p_size FROM part")
    return spark.read.text(str(conn.catalog.csv("t"))).select(F.col("value").alias("line")).where("line != 'k,b,q,n'")


def atomic_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that breaks off leaves the old file and nothing else; a reader that has the old one keeps it."""
    conn = filled(spark, sf_dir, "region")
    path, names = conn.catalog.csv("region"), lambda: sorted(p.name for p in conn.catalog.root.glob("*"))
    before, there = path.read_bytes(), names()

    def broken():
        yield "half"
        raise OSError("full")

    try:
        replace_file(path, broken())
        failed = "no"
    except OSError:
        failed = "yes"
    lazy = conn.sql("SELECT COUNT(*) AS n FROM region")
    same = path.read_bytes() == before and names() == there
    conn.execute("DELETE FROM region")
    return seen(spark, ("failed", failed), ("unchanged", same), ("lazy", lazy.first()[0]), ("now", conn.execute("SELECT COUNT(*) FROM region").fetchone()[0]))


def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas read and written, and what is refused."""
    conn = filled(spark, sf_dir, "supplier")
    text = conn.catalog.yaml("supplier").read_text()
    schema = Schema.load(text)
    bad = ["{", "[]", "version: 2", "version: 1\ntable: t", text.replace("type: real", "type: blob"), text.replace("type: real", "x: 1\n  type: real")]
    rows = [(f"column {c.name}", f"{c.kind} {c.nullable} {c.key} {c.default}") for c in schema.columns]
    return seen(spark, *rows, ("same", Schema.load(schema.dump()) == schema), ("refused", [error(lambda t=t: Schema.load(t)) for t in bad] == ["OperationalError"] * len(bad)))


def shell(conn: Connection, spark: SparkSession, *args: str, text: str = "") -> tuple[int, str, str]:
    from ..cli import main

    out, err = io.StringIO(), io.StringIO()
    code = main([args[0], str(conn.catalog.root), *args[1:]], io.StringIO(text), out, err, spark)
    return code, out.getvalue(), err.getvalue()


def result_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the shell prints them: aligned, as CSV, as JSON lines and expanded."""
    conn = filled(spark, sf_dir, "region")
    ask = "SELECT r_name, r_regionkey, NULL AS x FROM region WHERE r_regionkey = 0"
    code, table, _ = shell(conn, spark, "shell", "-f", "table", "-c", ask)
    csv_ = shell(conn, spark, "shell", "-f", "csv", "-c", ask)[1]
    rows = [json.loads(x) for x in shell(conn, spark, "shell", "-f", "json", "-c", ask)[1].splitlines()]
    wide = shell(conn, spark, "repl", text=f"\\x\n{ask};\n\\q\n")[1]
    return seen(spark, ("code", code), ("table", table.splitlines()[2].split(" | ")[0].strip()), ("csv", csv_.splitlines()[1]), ("json", rows[0]["r_name"]), ("nulls", rows[0]["x"]), ("expanded", next(x for x in wide.splitlines() if x.startswith("r_name")).split("| ")[1]))


def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line: exit codes, statements from -c and from a pipe, a session that survives errors, init and check."""
    conn = filled(spark, sf_dir, "region", "nation")
    piped = shell(conn, spark, "shell", text="SELECT COUNT(*) AS n FROM nation;")[1].split()
    bad = shell(conn, spark, "shell", "-c", "SELECT nope FROM nation")
    code, out, err = shell(conn, spark, "repl", text="\\dt\n\\d region\n\\d nope\n\\zz\nSELECT nope;\nSELECT r_name\nFROM region WHERE r_regionkey = 1;\nDELETE FROM region WHERE r_regionkey = 1;\nhelp\n\\q\n")
    empty = connect(folder(spark) / "empty", spark=spark)
    return seen(
        spark, ("piped", piped), ("code of an error", bad[0]), ("told", bad[2].startswith("error: ")), ("session", code), ("tables", "  nation\n  region\n" in out), ("described", "table: region" in out), ("prompts", "db=# " in out and "db-# " in out),
        ("not found", '"nope"' in err), ("invalid", "invalid command \\zz" in err), ("rows", "(1 rows affected)" in err), ("help", "\\pset" in out), ("init", shell(empty, spark, "init")[0]), ("check", shell(conn, spark, "check")[:2]),
    )


def tool_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = filled(spark, sf_dir, "region", "nation")
    return seen(
        spark, ("tables", tools.list_tables(conn)), ("described", tools.describe_table(conn, "region").splitlines()[1]), ("query", tools.query(conn, "SELECT COUNT(*) AS n FROM nation")["rows"][0][0]), ("refused", error(lambda: tools.query(conn, "DELETE FROM nation"))),
        ("execute", tools.execute(conn, "DELETE FROM nation WHERE n_regionkey = 1")["rowcount"]), ("read only", "execute" in tools.available(read_only=True)),
    )


def checker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checker finds, by severity."""
    conn = filled(spark, sf_dir, "region", "nation", "supplier", "labels")
    clean, root = problems(conn.catalog.root), conn.catalog.root
    (root / "region.csv").write_text("r_regionkey,r_name\n1,a\n1,b\n2,\\N\n")
    (root / "nation.csv").write_bytes(b"n_nationkey,n_name,n_regionkey\r\n1,a,1\r\n")
    (root / "supplier.csv").write_text("s_suppkey,s_name,s_nationkey,s_acctbal\nx,a,1,1.0\n")
    (root / "labels.csv").unlink()
    (root / "lost.csv").write_text("a\n")
    conn.catalog.journal.write_text("{")
    found = problems(root)
    return seen(spark, ("clean", clean), ("errors", sum(how == "error" for how, _ in found)), ("warnings", sum(how == "warning" for how, _ in found)), *((f"told {x}", any(x in what for _, what in found)) for x in ("duplicate primary key", "NULL in NOT NULL", "canonical", "line 2", "missing file", "no schema", "journal")))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PEP 249: cursors, row counts, connections and the module's attributes."""
    import plainfold

    conn = filled(spark, sf_dir, "region")
    cur = conn.cursor().execute("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")
    rows = [cur.fetchone()[0], [r[0] for r in cur.fetchmany(2)], [r[0] for r in cur], cur.fetchone()]
    many = conn.executemany("INSERT INTO region VALUES (?, ?)", [(100, "a"), (101, "b")]).rowcount
    broken = error(lambda: conn.executemany("INSERT INTO region VALUES (?, ?)", [(102, "c"), (102, "d")]))
    counts = [conn.execute(x).rowcount for x in ("UPDATE region SET r_name = 'x' WHERE r_regionkey > 100", "DELETE FROM region WHERE r_regionkey = 100", "SELECT 1", "CREATE TABLE t (a INT)")]
    left = conn.execute("SELECT COUNT(*) FROM region").fetchone()[0]
    cur.close()
    with connect(conn.catalog.root, spark=spark) as other:
        other.execute("BEGIN")
        other.execute("DELETE FROM region")
        inside = other.in_transaction
    return seen(
        spark, ("rows", rows), ("description", [d[0] for d in cur.description]), ("executemany", many), ("not atomic", broken), ("row counts", counts), ("left", left), ("closed cursor", error(cur.fetchone)), ("in transaction", inside),
        ("closed connection", error(lambda: other.execute("SELECT 1"))), ("close discards", conn.execute("SELECT COUNT(*) FROM region").fetchone()[0]), ("no transaction", conn.commit() or conn.rollback()),
        ("module", (plainfold.apilevel, plainfold.threadsafety, plainfold.paramstyle)), ("errors", [issubclass(getattr(plainfold, x), plainfold.DatabaseError) for x in ("DataError", "OperationalError", "IntegrityError", "InternalError", "ProgrammingError", "NotSupportedError")]), ("interface", issubclass(plainfold.InterfaceError, plainfold.Error)),
    )


def locking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second writer waits and gives up; readers see the last commit meanwhile, and the writer its own changes."""
    one = filled(spark, sf_dir, "region")
    two = connect(one.catalog.root, timeout=0.1, spark=spark)
    count = lambda c: c.execute("SELECT COUNT(*) FROM region").fetchone()[0]
    one.execute("BEGIN")
    one.execute("DELETE FROM region WHERE r_regionkey > 1")
    rows = [("own changes", count(one)), ("others", count(two)), ("second writer", error(lambda: two.execute("DELETE FROM region"))), ("second transaction", error(lambda: two.execute("BEGIN")))]
    one.commit()
    rows += [("committed", count(two)), ("free again", two.execute("DELETE FROM region WHERE r_regionkey = 0").rowcount)]
    one.locks.begin()  # as a statement that takes long
    rows += [("during a long write", count(two)), ("lazy", two.sql("SELECT * FROM region").count())]
    one.locks.end()
    return seen(spark, *rows)


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit of two tables that breaks off between them is made good before the next statement, of whatever kind; a
    journal that can't be read is an error."""
    from .. import database

    conn, was = filled(spark, sf_dir, "region", "nation"), database.replace_file
    other = connect(conn.catalog.root, spark=spark)

    def breaking(path, parts, held=None):
        if path.name == "region.csv":
            raise OSError("crash")
        was(path, parts)

    conn.execute("BEGIN")
    for table in ("nation", "region"):
        conn.execute(f"DELETE FROM {table}")
    database.replace_file = breaking
    try:
        conn.commit()
        crashed = "no"
    except OSError:
        crashed = "yes"
    finally:
        database.replace_file = was
    rows = [("crashed", crashed), ("pending", conn.catalog.journal.exists()), ("lazy query", other.sql("SELECT * FROM region").count()), ("replayed", conn.catalog.journal.exists()), ("other table", other.execute("SELECT COUNT(*) FROM nation").fetchone()[0])]
    for text in ("{", '{"version": 2, "files": {}}'):
        conn.catalog.journal.write_text(text)
        rows.append((f"journal {len(text)}", error(lambda: other.execute("SELECT 1"))))
    return seen(spark, *rows)


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema appears after its rows, so that a table that is there can be read; it goes before them."""
    from .. import database

    conn, order, was = filled(spark, sf_dir, "region"), [], (database.place, database.replace_file)

    def noted(f):
        def call(first, *rest):
            path = rest[0] if isinstance(rest[0], Path) else first
            order.append(path.name.removeprefix("t."))
            return f(first, *rest)

        return call

    database.place, database.replace_file = map(noted, was)
    try:
        conn.execute("CREATE TABLE t (a INT)")
    finally:
        database.place, database.replace_file = was
    return seen(spark, ("created", order), ("tables", conn.catalog.names()))


def read_checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's own reader, which the checker uses, over a file that the engine wrote."""
    conn = filled(spark, sf_dir, "customer")
    rows = [tuple(r) for _, r in read_checked(conn.catalog.csv("customer"), conn.catalog.schema("customer"))]
    return spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")


SESSIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "csv_roundtrip": (csv_roundtrip, "SELECT p_partkey, p_name || chr(13) || chr(10) || '\"x\",' || chr(10) AS p_name, p_brand, p_type, p_size::bigint AS p_size, p_retailprice FROM part"),
    "csv_errors": (csv_errors, values(*((x, "'OperationalError true false false'".replace("true", "True").replace("false", "False")) for x in ("short", "long", "blank", "quote")), ("value", "'OperationalError True True False'"), ("header", "'OperationalError False True True'"), ("empty", "'OperationalError False False True'"), ("crlf", r"'[(1, ''a\r\nb''), (2, ''c'')]'"))),
    "canonical_encode": (canonical_encode, r"SELECT p_partkey || ',' || coalesce(nullif(p_brand, 'Brand#11'), '\N') || ',' || chr(34) || p_name || ',' || chr(34) || chr(34) || chr(34) || ',' || p_size AS line FROM part"),
    "atomic_write": (atomic_write, values(("failed", "'yes'"), ("unchanged", "'True'"), ("lazy", "(SELECT count(*)::varchar FROM region)"), ("now", "'0'"))),
    "schema_files": (schema_files, values(("column s_suppkey", "'integer False True None'"), ("column s_name", "'text False False None'"), ("column s_nationkey", "'integer True False None'"), ("column s_acctbal", "'real True False 1.5'"), ("same", "'True'"), ("refused", "'True'"))),
    "result_sinks": (result_sinks, values(("code", "'0'"), *((x, "(SELECT r_name FROM region WHERE r_regionkey = 0)") for x in ("table", "json", "expanded")), ("csv", r"(SELECT r_name || ',0,\N' FROM region WHERE r_regionkey = 0)"), ("nulls", "'None'"))),
    "shell_commands": (shell_commands, values(("piped", "(SELECT '[''n'', ''' || count(*) || ''']' FROM nation)"), ("code of an error", "'1'"), ("session", "'0'"), ("init", "'0'"), ("check", r"'(0, ''ok\n'')'"), *((x, "'True'") for x in ("told", "tables", "described", "prompts", "not found", "invalid", "rows", "help")))),
    "tool_functions": (tool_functions, values(("tables", "'[''nation'', ''region'']'"), ("described", "'table: region'"), ("query", "(SELECT count(*)::varchar FROM nation)"), ("refused", "'ProgrammingError'"), ("execute", "(SELECT count(*)::varchar FROM nation WHERE n_regionkey = 1)"), ("read only", "'False'"))),
    "checker": (checker, values(("clean", "'[]'"), ("errors", "'4'"), ("warnings", "'3'"), *((f"told {x}", "'True'") for x in ("duplicate primary key", "NULL in NOT NULL", "canonical", "line 2", "missing file", "no schema", "journal")))),
    "cursors": (cursors, values(("rows", "(SELECT '[' || k[1] || ', ' || list_transform(k[2:3], lambda x: x::varchar)::varchar || ', ' || k[4:]::varchar || ', None]' FROM (SELECT list(r_regionkey ORDER BY r_regionkey) AS k FROM region))"), ("description", "'[''r_regionkey'', ''r_name'']'"), ("executemany", "'2'"), ("not atomic", "'IntegrityError'"), ("row counts", "'[2, 1, -1, -1]'"),
        ("left", "(SELECT (count(*) + 2)::varchar FROM region)"), ("closed cursor", "'InterfaceError'"), ("in transaction", "'True'"), ("closed connection", "'InterfaceError'"), ("close discards", "(SELECT (count(*) + 2)::varchar FROM region)"), ("no transaction", "'None'"), ("module", "'(''2.0'', 1, ''qmark'')'"), ("errors", "'[True, True, True, True, True, True]'"), ("interface", "'True'"))),
    "locking": (locking, values(("own changes", "'2'"), ("others", "(SELECT count(*)::varchar FROM region)"), ("second writer", "'OperationalError'"), ("second transaction", "'OperationalError'"), ("committed", "'2'"), ("free again", "'1'"), ("during a long write", "'1'"), ("lazy", "'1'"))),
    "journal": (journal, values(("crashed", "'yes'"), ("pending", "'True'"), ("lazy query", "'0'"), ("replayed", "'False'"), ("other table", "'0'"), ("journal 1", "'OperationalError'"), ("journal 27", "'OperationalError'"))),
    "file_order": (file_order, values(("created", "'[''csv'', ''schema.yaml'']'"), ("tables", "'[''region'', ''t'']'"))),
    "read_checked_rows": (read_checked_rows, "SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: (lambda spark, sf_dir, x=x: case(spark, sf_dir, *x[:3])) for name, x in CASES.items()}
    return made | {name: f for name, (f, _) in SESSIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: x[3] for name, x in CASES.items()} | {name: text for name, (_, text) in SESSIONS.items()}
