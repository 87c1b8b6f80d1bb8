"""The dialect against the standard library's sqlite3, over parcels and the depots that they lie in; and what it refuses."""

import sqlite3

import pytest

import plainfold
from plainfold import NotSupportedError, OperationalError, ProgrammingError, connect

TABLES = {
    "parcels": ("no INTEGER PRIMARY KEY, label TEXT NOT NULL, grams BIGINT, depot INT, sent DATE, fragile BOOLEAN NOT NULL DEFAULT FALSE", [
        (11, "lamp", 1200, 7, "2023-05-02", True), (12, "Rope", 450, 8, None, False), (13, "tin%box", None, 7, "2023-11-30", False), (14, "lens_a", 80, None, "2024-02-29", True),
        (15, "rope", 450, 9, "2024-03-01", False), (16, "o'clock", 0, 8, "2023-05-02", True), (17, "", -5, 99, None, False),
    ]),
    "depots": ("code INTEGER PRIMARY KEY, town VARCHAR(30), cost REAL", [(7, "Brno", 2.5), (8, "Pécs", None), (9, "Graz", 0.25), (10, None, 4.0)]),
}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    conn, lite = connect(tmp_path_factory.mktemp("db"), spark=spark), sqlite3.connect(":memory:")
    for name, (columns, rows) in TABLES.items():
        row = f"({', '.join('?' for _ in rows[0])})"
        for db in (conn, lite):
            db.execute(f"CREATE TABLE {name} ({columns})")
            assert db.execute(f"INSERT INTO {name} VALUES {', '.join([row] * len(rows))}", [v for r in rows for v in r]).rowcount == len(rows)
    yield conn, lite
    conn.close()


def plain(rows):
    """Rows as both databases can show them: booleans are numbers in one of them."""
    return [tuple(int(v) if isinstance(v, bool) else round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


#: By what is tried; those with ORDER BY are compared in order.
SAME = {
    "projection": ["SELECT label, grams * 2 + no FROM parcels", "SELECT 3 * (4 - 6), 'a' || 'b'", "SELECT * FROM depots", "SELECT p.*, d.town FROM parcels p JOIN depots d ON d.code = p.depot", "SELECT ALL label FROM parcels"],
    "conditions": [
        "SELECT no FROM parcels WHERE grams >= 450 AND depot <> 9 OR label = 'rope'", "SELECT no FROM parcels WHERE NOT (grams < 100)", "SELECT no FROM parcels WHERE sent IS NULL AND grams IS NOT NULL",
        "SELECT no FROM parcels WHERE grams BETWEEN -5 AND 450 AND no NOT BETWEEN 12 AND 14", "SELECT no FROM parcels WHERE depot IN (8, 9, NULL)", "SELECT no FROM parcels WHERE depot NOT IN (8, NULL)",
    ],
    "patterns": ["SELECT label FROM parcels WHERE label LIKE 'ROPE'", "SELECT label FROM parcels WHERE label LIKE '%_a' OR label LIKE '%c%ck'", "SELECT label FROM parcels WHERE label LIKE '%\\%%' ESCAPE '\\'", "SELECT label FROM parcels WHERE label NOT LIKE '%e%'"],
    "booleans": [
        "SELECT no FROM parcels WHERE fragile", "SELECT no FROM parcels WHERE NOT fragile AND fragile = 0", "SELECT no FROM parcels WHERE fragile = TRUE OR grams", "SELECT fragile + 1, -fragile, fragile * grams FROM parcels", "SELECT SUM(fragile), AVG(fragile), MAX(fragile) FROM parcels",
        "SELECT no FROM parcels WHERE fragile BETWEEN 1 AND 5 AND fragile IN (1, 2)", "SELECT no, CASE fragile WHEN 1 THEN 'glass' WHEN 0 THEN 'solid' END FROM parcels", "SELECT no FROM parcels WHERE fragile <> (grams > 100)",
    ],
    "dates": ["SELECT no FROM parcels WHERE sent > '2023-05-02' AND sent <= '2024-02-29'", "SELECT MIN(sent), MAX(sent) FROM parcels", "SELECT STRFTIME('%Y/%m', sent), STRFTIME('day %j, %w', sent) FROM parcels", "SELECT STRFTIME('%d.%m. it''s %H:%M:%S %%', '2024-12-31 23:59:01')"],
    "order": [
        "SELECT no, grams FROM parcels ORDER BY grams, label, no", "SELECT no, sent FROM parcels ORDER BY sent DESC, no DESC", "SELECT grams FROM parcels ORDER BY grams NULLS LAST, no", "SELECT grams FROM parcels ORDER BY grams DESC NULLS FIRST, no", "SELECT label AS x FROM parcels ORDER BY LENGTH(label) DESC, no",
        "SELECT depot, no FROM parcels ORDER BY 1 DESC, 2 LIMIT 4 OFFSET 2", "SELECT * FROM depots ORDER BY cost DESC LIMIT 2", "SELECT label AS no, no AS k FROM parcels ORDER BY k DESC", "SELECT DISTINCT depot FROM parcels ORDER BY depot", "SELECT depot FROM parcels UNION SELECT code FROM depots ORDER BY depot DESC LIMIT 3",
    ],
    "joins": [
        "SELECT label, town FROM parcels JOIN depots ON depot = code", "SELECT label, town FROM parcels p LEFT JOIN depots d ON p.depot = d.code AND d.cost > 1", "SELECT town FROM depots LEFT JOIN parcels ON depot = code WHERE no IS NULL", "SELECT a.no, b.no FROM parcels a JOIN parcels b ON a.grams = b.grams AND a.no < b.no",
        "SELECT COUNT(*) FROM parcels CROSS JOIN depots", "SELECT town, no FROM depots d LEFT JOIN (SELECT * FROM parcels WHERE fragile) f ON f.depot = d.code",
    ],
    "groups": [
        "SELECT depot, COUNT(*), COUNT(grams), SUM(grams), MIN(label) FROM parcels GROUP BY depot", "SELECT fragile, AVG(grams) FROM parcels GROUP BY fragile HAVING MAX(grams) > 500", "SELECT MAX(grams) - MIN(grams), SUM(grams) * 1.5, COUNT(DISTINCT grams) FROM parcels", "SELECT SUM(grams), COUNT(*) FROM parcels WHERE no < 0",
        "SELECT town, SUM(grams) FROM parcels JOIN depots ON depot = code GROUP BY town", "SELECT COUNT(*) FROM (SELECT DISTINCT grams, fragile FROM parcels) x", "SELECT LENGTH(label), COUNT(*) FROM parcels GROUP BY LENGTH(label)",
    ],
    "subqueries": [
        "SELECT town FROM depots WHERE code IN (SELECT depot FROM parcels WHERE grams > 100)", "SELECT town FROM depots WHERE code NOT IN (SELECT depot FROM parcels)", "SELECT town FROM depots WHERE code NOT IN (SELECT depot FROM parcels WHERE depot > 0)", "SELECT no FROM parcels WHERE grams > (SELECT AVG(grams) FROM parcels)",
        "SELECT town FROM depots d WHERE EXISTS (SELECT 1 FROM parcels p WHERE p.depot = d.code AND p.fragile)", "SELECT town, (SELECT COUNT(*) FROM parcels p WHERE p.depot = d.code) FROM depots d",
        "WITH heavy AS (SELECT * FROM parcels WHERE grams > 400), per (d, n) AS (SELECT depot, COUNT(*) FROM heavy GROUP BY depot) SELECT town, n FROM per JOIN depots ON d = code",
    ],
    "sets": ["SELECT depot FROM parcels UNION ALL SELECT code FROM depots", "SELECT depot FROM parcels UNION SELECT code FROM depots", "SELECT code FROM depots INTERSECT SELECT depot FROM parcels", "SELECT code FROM depots EXCEPT SELECT depot FROM parcels"],
    "functions": [
        "SELECT UPPER(label), LOWER(label), LENGTH(label), REPLACE(label, 'o', '00'), SUBSTR(label, 2, 3), SUBSTR(label, 3) FROM parcels", "SELECT label || ':' || no || sent FROM parcels", "SELECT ABS(grams - 100), ROUND(grams / 7.0, 2) FROM parcels", "SELECT COALESCE(grams, depot, 0), IFNULL(sent, 'never'), NULLIF(depot, 8) FROM parcels",
        "SELECT CASE WHEN grams > 1000 THEN 'L' WHEN grams > 0 THEN 'S' ELSE '?' END FROM parcels", "SELECT CAST(grams AS TEXT) || 'g', CAST('0042' AS INTEGER), CAST(2.9 AS INTEGER) FROM parcels", "SELECT grams / 7, grams % 7, -grams / 7, grams / 4.0, 9 / 2 * 2 FROM parcels",
    ],
}


@pytest.mark.parametrize("sql", [x for kind in SAME.values() for x in kind])
def test_same_as_sqlite(both, sql):
    got, want = (plain(db.execute(sql).fetchall()) for db in both)
    if "ORDER BY" not in sql:
        got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert got == want


def test_columns_and_rows_come_as_pep_249_says(both):
    cur = both[0].execute("SELECT no, grams + 1, COUNT(*) AS n FROM parcels WHERE no = :who GROUP BY no, grams", {"who": 11, "unused": None})
    assert ([d[0] for d in cur.description], cur.rowcount, cur.fetchone(), cur.fetchone()) == (["no", "_col_1", "n"], -1, (11, 1201, 1), None)
    cur = both[0].execute("SELECT no FROM parcels WHERE label <> ? AND ? IS NULL ORDER BY no LIMIT ?", ["\\'o", None, 4])
    assert cur.fetchmany() == [(11,)] and cur.fetchmany(2) == [(12,), (13,)] and list(cur) == [(14,)]
    cur.close()
    with pytest.raises(plainfold.InterfaceError):
        cur.fetchone()


@pytest.mark.parametrize("sql, params", [("SELECT ?", []), ("SELECT ?, ?", [1]), ("SELECT :x", {}), ("SELECT ?", {"x": 1}), ("SELECT :x", [1]), ("SELECT ?", [b"raw"])])
def test_parameters_must_fit(both, sql, params):
    with pytest.raises(ProgrammingError):
        both[0].execute(sql, params)


@pytest.mark.parametrize("error, statements", [
    (ProgrammingError, ["", ";", "SELECT no FROM", "SELECT 1; SELECT 2", "SELECT * FROM boats", "SELECT weight FROM parcels", "SELECT no FROM parcels ORDER BY 2", "SELECT no FROM parcels UNION SELECT 1 ORDER BY grams"]),
    (NotSupportedError, ["SHOW parcels", "SELECT no FROM parcels LIMIT 2 * 2", "CREATE INDEX heavy ON parcels (grams)", "UPDATE parcels SET grams = cost FROM depots", "INSERT OR REPLACE INTO depots VALUES (7, 'x', 1)", "DELETE FROM parcels RETURNING no", "SELECT DISTINCT label FROM parcels ORDER BY grams"]),
    (OperationalError, ["SELECT 1 / 0", "SELECT grams % 0 FROM parcels", "SELECT CAST('heavy' AS INTEGER)"]),
])
def test_what_is_refused(both, error, statements):
    for sql in statements:
        with pytest.raises(error):
            both[0].execute(sql)


def test_strict_mode_refuses_what_else_is_open(both, spark):
    with connect(both[0].catalog.root, spark=spark, strict=True) as strict:
        for sql in ("SELECT SUM(DISTINCT grams) FROM parcels", "SELECT no, ROW_NUMBER() OVER (ORDER BY grams, no) FROM parcels", "SELECT town, (SELECT MIN(no) FROM parcels) FROM depots"):
            with pytest.raises(NotSupportedError):
                strict.execute(sql)
            assert both[0].execute(sql).fetchall()


def test_a_query_is_lazy(both):
    df = both[0].sql("SELECT label FROM parcels WHERE grams > ?", [100])
    assert df.columns == ["label"] and df.count() == 3


DIRECTIVES = "aAwdbBmyYHIpMSfjUWcxXGuVCDeFhklnPrRTgz%qE"


@pytest.mark.parametrize("at", ["2024-12-30 00:05:09", "2023-01-01 13:00:00.25", "2021-01-03", "2000-02-29T23:59:59", "2024-06-15 12:00:00"])
def test_all_directives_of_strftime(both, at):
    from datetime import datetime

    got = both[0].execute("SELECT " + ", ".join(f"STRFTIME('<%{d}>', '{at}')" for d in DIRECTIVES)).fetchone()
    want = [datetime.fromisoformat(at).strftime(f"<%{d}>") for d in DIRECTIVES]
    assert dict(zip(DIRECTIVES, got, strict=True)) == dict(zip(DIRECTIVES, want, strict=True))
