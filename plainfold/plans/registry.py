"""Queries over the driver's tables, one or more for each operator, with the DuckDB text that must give the same rows.

Statements in the dialect go through the parser and the lowering. Where DuckDB reads the same text alike, it is given once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..sql.lower import lower, tables
from ..sql.parser import parse
from ..streaming.events import hourly
from . import engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement of the dialect over the Parquet tables of a folder; only those it names are opened."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    tree = parse(text)
    for name in tables(tree):
        session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return lower(session, tree)


FLAGSHIP = """
SELECT c.c_mktsegment AS segment, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, COUNT(*) AS n
FROM lineitem l INNER JOIN orders o ON l.l_orderkey = o.o_orderkey INNER JOIN customer c ON o.o_custkey = c.c_custkey
WHERE l.l_quantity > 10 GROUP BY c.c_mktsegment ORDER BY revenue DESC, segment LIMIT 3"""

#: strftime directives that DuckDB has, too.
STRFTIME = "aAwdbBmyYHIMSfjpUWuVG"

#: name: the dialect's text, DuckDB's text or None for the same.
SQL: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    "filter_project": ("SELECT p_partkey, p_name, p_size * 2 AS twice FROM part WHERE p_size > 25 AND NOT p_brand = 'Brand#11' OR p_retailprice < 905", "SELECT p_partkey, p_name, (p_size * 2)::bigint AS twice FROM part WHERE p_size > 25 AND NOT p_brand = 'Brand#11' OR p_retailprice < 905"),
    "comparisons": ("SELECT p_partkey AS k FROM part WHERE p_size <> 7 AND p_size >= 5 AND p_size <= 40 AND p_retailprice < 1500", None),
    "between_in_list": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('1-URGENT')", None),
    "like_prefix": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'st%' OR p_name LIKE '%A%'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'st%' OR p_name ILIKE '%A%'"),
    "not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%e%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%e%'"),
    "is_null_after_left_join": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality = 0", None),
    "three_valued_logic": ("SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1) OR l.toxic IS NOT NULL", None),
    "boolean_as_number": ("SELECT k, big FROM (SELECT p_partkey AS k, p_size > 25 AS big FROM part) x WHERE big = 1", "SELECT p_partkey AS k, p_size > 25 AS big FROM part WHERE p_size > 25"),
    "boolean_literal": ("SELECT k FROM (SELECT p_partkey AS k, p_size > 25 AS big FROM part) x WHERE big = FALSE OR NOT big", "SELECT p_partkey AS k FROM part WHERE p_size <= 25"),
    "date_predicate": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-06-01' AND o_orderdate < '1996-01-01'", None),
    "unnamed_columns": ("SELECT COUNT(*), MAX(p_size) + 1 FROM part", "SELECT COUNT(*) AS _col_0, (MAX(p_size) + 1)::bigint AS _col_1 FROM part"),
    "star": ("SELECT r.* FROM region r", None),
    "tableless": ("SELECT 1 + 1 AS two, 'x' || 'y' AS xy", "SELECT 2::bigint AS two, 'xy' AS xy"),
    "distinct_rows": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", None),
    "order_nulls_first_last": (
        "SELECT k, q FROM (SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x ORDER BY q DESC NULLS FIRST, k LIMIT 50", None),
    "order_nulls_default": (
        "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q, k DESC LIMIT 700",
        "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q NULLS FIRST, k DESC LIMIT 700"),
    "order_all_rows": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", None),
    "order_nulls_all_rows": (
        "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q, k DESC",
        "SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q NULLS FIRST, k DESC"),
    "order_nulls_last": ("SELECT d.doc_id AS k, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q NULLS LAST, k", None),
    "order_star": ("SELECT * FROM nation ORDER BY n_regionkey DESC, n_name", None),
    "order_hidden_column": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "order_ordinal": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 15", None),
    "order_alias": ("SELECT c_custkey AS k, c_acctbal * -1 AS neg FROM customer ORDER BY neg, k LIMIT 15", None),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", None),
    "top_k": ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_suppkey LIMIT 100", None),
    "inner_join": ("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000", None),
    "left_join": ("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", None),
    "right_join": ("SELECT n.n_name, r.r_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "full_join": ("SELECT s.s_suppkey, n.n_name FROM supplier s FULL OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", None),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "using_join": ("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)", None),
    "theta_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "anti_left_join_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL", None),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "not_in_subquery": ("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", None),
    "not_in_with_null": ("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT NULLIF(doc_id, 1) FROM labels)", None),
    "exists_correlated": ("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)", None),
    "scalar_subquery_where": ("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)", None),
    "scalar_subquery_select": ("SELECT n_name, (SELECT MAX(r_name) FROM region) AS top FROM nation", None),
    "group_count": ("SELECT o_orderstatus, COUNT(*) AS n, COUNT(o_custkey) AS c FROM orders GROUP BY o_orderstatus", None),
    "group_null_key": ("SELECT l.quality AS q, COUNT(*) AS n, MAX(l.toxic) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", None),
    "group_aggregates": (
        "SELECT l_returnflag, l_linestatus, SUM(l_linenumber) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, SUM(l_linenumber)::bigint AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "global_agg": ("SELECT ROUND(AVG(p_size) * 1.5, 6) AS a, SUM(p_size) AS s, MIN(p_name) AS m FROM part", "SELECT ROUND(AVG(p_size) * 1.5, 6) AS a, SUM(p_size)::bigint AS s, MIN(p_name) AS m FROM part"),
    "agg_over_join": ("SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(c.c_acctbal), 2) AS total FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    "count_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", None),
    "distinct_count_subquery": ("SELECT COUNT(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL) x", None),
    "window_superset": ("SELECT s_suppkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r FROM supplier", "SELECT s_suppkey, (RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC))::integer AS r FROM supplier"),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0", None),
    "set_op_order": ("SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x LIMIT 12", None),
    "cte": ("WITH big AS (SELECT o_custkey AS k, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE t > 1000000) SELECT c_name FROM customer JOIN top ON c_custkey = k", None),
    "derived_table": ("SELECT x.m, COUNT(*) AS n FROM (SELECT o_custkey % 7 AS m FROM orders) x GROUP BY x.m", None),
    "case_when": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c, CASE p_size WHEN 1 THEN 'one' END AS one FROM part", None),
    "coalesce_nullif": ("SELECT p_partkey, COALESCE(NULLIF(p_size, 7), -1) AS a, IFNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS b FROM part",
        "SELECT p_partkey, COALESCE(NULLIF(p_size, 7), -1)::bigint AS a, IFNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS b FROM part"),
    "concat": ("SELECT p_partkey || ':' || p_name || NULLIF(p_brand, 'Brand#11') AS x FROM part", None),
    "string_funcs": ("SELECT UPPER(p_name) AS u, LOWER(p_brand) AS l, LENGTH(p_type) AS n, REPLACE(p_type, 'E', '3') AS r, SUBSTR(p_name, 2, 3) AS s FROM part", None),
    "int_div_mod": ("SELECT p_partkey, p_size / 4 AS d, p_size % 4 AS m, (0 - p_size) / 4 AS e FROM part", "SELECT p_partkey, (p_size // 4)::bigint AS d, (p_size % 4)::bigint AS m, (-(p_size // 4))::bigint AS e FROM part"),
    "real_div": ("SELECT p_partkey, ROUND(p_retailprice / 7, 6) AS d FROM part", None),
    "abs_arith": ("SELECT s_suppkey, ABS(s_acctbal * -2 + 1) AS a, -s_nationkey AS m FROM supplier", None),
    "cast": ("SELECT CAST(p_size AS TEXT) AS t, CAST(p_retailprice AS INTEGER) AS i, CAST('42' AS INTEGER) AS n FROM part",
             "SELECT CAST(p_size AS VARCHAR) AS t, CAST(trunc(p_retailprice) AS BIGINT) AS i, 42::bigint AS n FROM part"),
    "strftime_parts": ("SELECT STRFTIME('%Y', o_orderdate) AS y, STRFTIME('%m/%d %H:%M:%S', o_orderdate) AS x, COUNT(*) AS n FROM orders GROUP BY STRFTIME('%Y', o_orderdate), STRFTIME('%m/%d %H:%M:%S', o_orderdate)",
                       "SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m/%d %H:%M:%S') AS x, COUNT(*) AS n FROM orders GROUP BY 1, 2"),
    "strftime_all": ("SELECT o_orderkey, " + ", ".join(f"STRFTIME('%{c}', o_orderdate) AS f_{i}" for i, c in enumerate(STRFTIME)) + ", STRFTIME('%% it''s [%F] %T %e', o_orderdate) AS mixed FROM orders",
                     "SELECT o_orderkey, " + ", ".join(f"strftime(o_orderdate, '%{c}') AS f_{i}" for i, c in enumerate(STRFTIME)) + ", '% it''s [' || strftime(o_orderdate, '%Y-%m-%d] %H:%M:%S ') || lpad(day(o_orderdate)::varchar, 2, ' ') AS mixed FROM orders"),
    "clock_now": ("SELECT CASE WHEN NOW() >= '2026-01-01' AND NOW() < '2100-01-01' THEN 'now' END AS n, CURRENT_DATE || '' = STRFTIME('%Y-%m-%d', NOW()) AS same, LENGTH(CURRENT_DATE) AS size FROM region", "SELECT 'now' AS n, TRUE AS same, 10::bigint AS size FROM region"),
    "boolean_in_arithmetic": ("SELECT k, big + 1 AS a, -big AS m, big * k AS p, CASE big WHEN 1 THEN 'y' ELSE 'n' END AS c FROM (SELECT p_partkey AS k, p_size > 25 AS big FROM part) x WHERE big BETWEEN 0 AND 1 AND big IN (0, 1)",
                              "SELECT p_partkey AS k, 1 + (p_size > 25)::bigint AS a, -(p_size > 25)::bigint AS m, (p_size > 25)::bigint * p_partkey AS p, CASE WHEN p_size > 25 THEN 'y' ELSE 'n' END AS c FROM part"),
    "boolean_sums": ("SELECT s, SUM(big) AS n, AVG(big) AS a FROM (SELECT p_size AS s, p_retailprice > 1000 AS big FROM part) x GROUP BY s", "SELECT p_size AS s, SUM((p_retailprice > 1000)::bigint)::bigint AS n, AVG((p_retailprice > 1000)::bigint) AS a FROM part GROUP BY p_size"),
    "current_date_now": ("SELECT COUNT(*) AS n FROM region WHERE CURRENT_DATE >= '2020-01-01' AND NOW() > '2020-01-01'", "SELECT COUNT(*) AS n FROM region"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_violations(spark, sf_dir):
    return changes.violations(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def hourly_events(spark, sf_dir):
    return hourly(_table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


FRAMES: dict[str, tuple[Callable, str]] = {
    "key_violations": (key_violations, "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"),
    "hourly_events": (hourly_events, "SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, text=text: run(spark, sf_dir, text)) for name, (text, _) in SQL.items()}
    return out | {name: f for name, (f, _) in FRAMES.items()} | engine.queries()


def oracle_sql() -> dict[str, str]:
    return {name: other or text for name, (text, other) in SQL.items()} | {name: text for name, (_, text) in FRAMES.items()} | engine.oracle_sql()
