"""Statements that change state, each on whole driver tables and ended by a query, with the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.session import Database, SerializationError, Session, SqlError
from tessera.sources.tables import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CUST = ("CREATE TABLE cust(id INTEGER PRIMARY KEY, name TEXT, seg TEXT, bal REAL)", "INSERT INTO cust SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
_ALL = "SELECT id, name, seg, bal FROM cust"
_BASE = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer"


def opened(spark: SparkSession, sf_dir: str, database: Database | None = None, tables: tuple[str, ...] = ("customer", "orders")) -> Session:
    register(spark, sf_dir, tables)
    return Session(spark, database)


def add(name: str, statements: tuple[str, ...], query: str, oracle: str, refused: tuple[str, ...] = ()) -> None:
    """statements in order, then those that must be refused, then the query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = opened(spark, sf_dir)
        for t in (*_CUST, *statements):
            s.sql(t)
        for t in refused:
            try:
                s.sql(t)
            except SqlError:
                continue
            raise AssertionError(f"not refused: {t}")
        return s.sql(query)

    QUERIES[name], ORACLES[name] = run, oracle


add("ddl_create_table", (), _ALL, _BASE)
add("ddl_create_temp_table", ("CREATE TEMP TABLE t(a INTEGER, b TEXT DEFAULT 'none')", "INSERT INTO t(a) SELECT o_orderkey FROM orders"), "SELECT a, b FROM t", "SELECT o_orderkey AS a, 'none' AS b FROM orders")
add("ddl_drop_table", ("DROP TABLE cust", "DROP TABLE IF EXISTS cust", "CREATE TABLE cust(id INTEGER PRIMARY KEY)", "INSERT INTO cust SELECT c_custkey FROM customer WHERE c_acctbal < 0"), "SELECT * FROM cust", "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0", ("DROP TABLE nothing",))
add("ddl_add_column", ("ALTER TABLE cust ADD COLUMN city TEXT NOT NULL DEFAULT 'x'", "ALTER TABLE cust ADD COLUMN n INTEGER"), "SELECT id, city, n FROM cust", "SELECT c_custkey AS id, 'x' AS city, CAST(NULL AS BIGINT) AS n FROM customer", ("ALTER TABLE cust ADD COLUMN z TEXT NOT NULL",))
add("ddl_drop_column", ("ALTER TABLE cust DROP COLUMN seg",), "SELECT * FROM cust", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer", ("ALTER TABLE cust DROP COLUMN id",))
add("ddl_rename_column", ("ALTER TABLE cust RENAME COLUMN bal TO balance",), "SELECT id, balance FROM cust WHERE balance > 0", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 0")
add("ddl_rename_table", ("ALTER TABLE cust RENAME TO people",), "SELECT id FROM people", "SELECT c_custkey AS id FROM customer", ("INSERT INTO cust VALUES (1, 'a', 'b', 2)",))
add("ddl_create_index", ("CREATE INDEX by_seg ON cust(seg, bal)",), "SELECT id FROM cust WHERE seg = 'BUILDING' AND bal > 100", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100")
add("ddl_unique_index", ("CREATE UNIQUE INDEX u ON cust(name)",), _ALL, _BASE, ("INSERT INTO cust SELECT -1 - c_custkey, c_name, 'S', 0 FROM customer", "CREATE UNIQUE INDEX w ON cust(seg)"))
add("ddl_drop_index", ("CREATE UNIQUE INDEX u ON cust(name)", "DROP INDEX u", "INSERT INTO cust SELECT -1 - c_custkey, c_name, 'S', 0 FROM customer"), "SELECT name, count(*) AS n FROM cust GROUP BY name", "SELECT c_name AS name, 2 * count(*) AS n FROM customer GROUP BY c_name")
add("ddl_create_view", ("CREATE VIEW rich(k, b) AS SELECT id, bal * 2 FROM cust WHERE bal > 5000", "UPDATE cust SET bal = bal + 1000 WHERE seg = 'BUILDING'"), "SELECT k, round(b, 2) AS b FROM rich",
    "SELECT c_custkey AS k, round((c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1000 ELSE 0 END) * 2, 2) AS b FROM customer WHERE c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1000 ELSE 0 END > 5000")
add("ddl_drop_view", ("CREATE VIEW v AS SELECT id FROM cust", "DROP VIEW v", "CREATE VIEW v AS SELECT seg, count(*) AS n FROM cust GROUP BY seg"), "SELECT seg, n FROM v", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1", ("DROP VIEW w",))
add("dml_insert_merge", ("INSERT INTO cust SELECT c_custkey, 'new', c_mktsegment, 1.5 FROM customer WHERE c_acctbal < 0",), _ALL, "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'new' ELSE c_name END AS name, c_mktsegment AS seg, CASE WHEN c_acctbal < 0 THEN 1.5 ELSE c_acctbal END AS bal FROM customer")
add("dml_insert_nulls", (), _ALL, _BASE, ("INSERT INTO cust VALUES (NULL, 'a', 'b', 1)", "INSERT INTO cust(nothing) VALUES (1)"))
add("dml_update", ("UPDATE cust SET bal = 0, name = seg WHERE seg = 'FURNITURE'",), _ALL, "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_mktsegment ELSE c_name END AS name, c_mktsegment AS seg, CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE c_acctbal END AS bal FROM customer")
add("dml_update_key", ("UPDATE cust SET id = -1 - id WHERE bal < 0",), "SELECT id, name FROM cust", "SELECT CASE WHEN c_acctbal < 0 THEN -1 - c_custkey ELSE c_custkey END AS id, c_name AS name FROM customer")
add("dml_delete", ("DELETE FROM cust WHERE bal < 0 OR seg IN ('BUILDING', 'MACHINERY')",), _ALL, _BASE + " WHERE NOT (c_acctbal < 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY'))")
add("dml_on_conflict_nothing", ("INSERT INTO cust SELECT c_custkey * 2, 'n', 's', 0 FROM customer ON CONFLICT DO NOTHING",), "SELECT id, name FROM cust", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT c_custkey * 2, 'n' FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
add("dml_on_conflict_update", ("INSERT INTO cust SELECT c_custkey * 2, 'n', 's', 1 FROM customer ON CONFLICT (id) DO UPDATE SET name = name || excluded.name, bal = excluded.bal WHERE seg <> 'BUILDING'",), "SELECT id, name, bal FROM cust",
    "SELECT c_custkey AS id, CASE WHEN hit THEN c_name || 'n' ELSE c_name END AS name, CASE WHEN hit THEN 1 ELSE c_acctbal END AS bal FROM (SELECT *, c_mktsegment <> 'BUILDING' AND c_custkey IN (SELECT c_custkey * 2 FROM customer) AS hit FROM customer) UNION ALL SELECT c_custkey * 2, 'n', 1 FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
add("dml_row_ids", ("CREATE TABLE nopk(a TEXT)", "INSERT INTO nopk SELECT seg FROM cust", "INSERT INTO nopk SELECT seg FROM cust"), "SELECT a, count(*) AS n FROM nopk GROUP BY a", "SELECT c_mktsegment AS a, 2 * count(*) AS n FROM customer GROUP BY 1")
add("tx_commit", ("BEGIN", "DELETE FROM cust WHERE bal < 0", "UPDATE cust SET bal = 1 WHERE seg = 'BUILDING'", "COMMIT", "ROLLBACK"), "SELECT id, bal FROM cust", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE c_acctbal END AS bal FROM customer WHERE c_acctbal >= 0")
add("tx_rollback", ("BEGIN", "DELETE FROM cust", "CREATE TABLE x(a INTEGER)", "ROLLBACK"), _ALL, _BASE, ("DROP TABLE x",))
add("tx_savepoint", ("BEGIN", "DELETE FROM cust WHERE bal < 0", "SAVEPOINT a", "DELETE FROM cust", "ROLLBACK TO a", "SAVEPOINT b", "UPDATE cust SET seg = 'S' WHERE seg = 'BUILDING'", "RELEASE b", "COMMIT"), "SELECT id, seg FROM cust", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'S' ELSE c_mktsegment END AS seg FROM customer WHERE c_acctbal >= 0", ("ROLLBACK TO a",))
add("show_set", ("SET search_path = 'x'",), "SHOW transaction_isolation", "SELECT 'serializable' AS setting")


def _two(first: tuple[str, ...], second: tuple[str, ...], fails: bool, query: str) -> Callable[[SparkSession, str], DataFrame]:
    """Two open transactions; the first commits, then the second."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database()
        a, b = opened(spark, sf_dir, db), Session(spark, db)
        for t in _CUST:
            a.sql(t)
        for s, statements in ((a, first), (b, second)):
            s.sql("BEGIN")
            for t in statements:
                s.sql(t)
        a.sql("COMMIT")
        try:
            b.sql("COMMIT")
            refused = False
        except SerializationError:
            refused = True
        if refused != fails:
            raise AssertionError("the second commit " + ("was refused" if refused else "went through"))
        return b.sql(query)

    return run


QUERIES["tx_write_skew"] = _two(("SELECT * FROM cust WHERE seg = 'BUILDING'", "UPDATE cust SET bal = 0 WHERE seg = 'BUILDING' AND bal < 0"), ("SELECT * FROM cust WHERE seg = 'BUILDING'", "UPDATE cust SET bal = 9 WHERE seg = 'BUILDING' AND bal > 0"), True, "SELECT id, bal FROM cust")
ORACLES["tx_write_skew"] = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0 ELSE c_acctbal END AS bal FROM customer"
QUERIES["tx_phantom"] = _two(("INSERT INTO cust VALUES (-5, 'p', 'BUILDING', 1)",), ("SELECT * FROM cust WHERE seg = 'BUILDING'", "DELETE FROM cust WHERE seg = 'FURNITURE'"), True, "SELECT id FROM cust")
ORACLES["tx_phantom"] = "SELECT c_custkey AS id FROM customer UNION ALL SELECT -5"
QUERIES["tx_unrelated"] = _two(("UPDATE cust SET bal = 0 WHERE seg = 'BUILDING'",), ("DELETE FROM cust WHERE seg = 'FURNITURE'",), False, "SELECT id, bal FROM cust")
ORACLES["tx_unrelated"] = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS bal FROM customer WHERE c_mktsegment <> 'FURNITURE'"
