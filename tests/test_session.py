"""The SQL session end to end, and predicates on rows with nulls."""

import pytest

from tessera.plans import predicates as P
from tessera.plans.session import Database, SerializationError, Session, SqlError


def rows(s, q):
    return sorted(tuple(r) for r in s.sql(q).collect())


@pytest.fixture()
def s(spark):
    s = Session(spark)
    s.sql("CREATE TABLE users(id INTEGER PRIMARY KEY, name TEXT, age INTEGER)")
    s.sql("INSERT INTO users VALUES (1, 'ann', 30), (2, 'bob', NULL)")
    return s


def test_dml_and_ddl(s):
    s.sql("INSERT INTO users(id, name) VALUES (1, 'anna')")  # the same key merges, the last write stays
    assert rows(s, "SELECT id, name, age FROM users WHERE id = 1") == [(1, "anna", None)]
    s.sql("UPDATE users SET age = 40 WHERE name = 'bob'")
    s.sql("UPDATE users SET id = 9 WHERE id = 1")
    assert rows(s, "SELECT id, coalesce(age, 0) FROM users") == [(2, 40), (9, 0)]
    s.sql("ALTER TABLE users ADD COLUMN city TEXT NOT NULL DEFAULT 'x'")
    s.sql("ALTER TABLE users RENAME COLUMN name TO label")
    assert rows(s, "SELECT label, city FROM users") == [("anna", "x"), ("bob", "x")]
    s.sql("ALTER TABLE users DROP COLUMN age")
    s.sql("DELETE FROM users WHERE id = 9")
    s.sql("CREATE VIEW v(n) AS SELECT count(*) FROM users")
    assert rows(s, "SELECT n FROM v") == [(1,)]
    s.sql("ALTER TABLE users RENAME TO people")
    with pytest.raises(SqlError):
        s.sql("ALTER TABLE people DROP COLUMN id")
    s.sql("DROP VIEW v")
    s.sql("DROP TABLE people")
    s.sql("DROP TABLE IF EXISTS people")
    with pytest.raises(SqlError):
        s.sql("DROP TABLE people")


def test_unique_and_row_ids(s):
    s.sql("CREATE UNIQUE INDEX u ON users(name)")
    with pytest.raises(SqlError):
        s.sql("INSERT INTO users VALUES (3, 'ann', 1)")
    s.sql("DROP INDEX u")
    s.sql("INSERT INTO users VALUES (3, 'ann', 1)")
    s.sql("CREATE TABLE nopk(a TEXT, b INTEGER)")
    s.sql("INSERT INTO nopk VALUES ('x', 1), ('x', 1)")
    s.sql("INSERT INTO nopk VALUES (NULL, NULL)")
    assert s.sql("SELECT * FROM nopk").count() == 3 and s.sql("SELECT * FROM nopk").columns == ["a", "b"]


def test_transactions(s):
    s.sql("BEGIN")
    with pytest.raises(SqlError):
        s.sql("BEGIN")
    s.sql("DELETE FROM users WHERE id = 1")
    s.sql("SAVEPOINT a")
    s.sql("DELETE FROM users")
    s.sql("ROLLBACK TO a")
    assert rows(s, "SELECT id FROM users") == [(2,)]
    s.sql("ROLLBACK")
    assert rows(s, "SELECT id FROM users") == [(1,), (2,)]
    s.sql("COMMIT")
    assert rows(s, "SHOW transaction_isolation") == [("serializable",)]


def test_last_write_stays_and_constraints_hold(s):
    s.sql("CREATE TABLE d(k INTEGER PRIMARY KEY, v TEXT DEFAULT 'd, e', q INTEGER UNIQUE, n INTEGER NOT NULL DEFAULT 7, UNIQUE (v, n))")
    s.sql("INSERT INTO d(k, q) VALUES (1, 5)")
    assert rows(s, "SELECT * FROM d") == [(1, "d, e", 5, 7)]
    s.sql("INSERT INTO d VALUES (2, 'a', 1, 1), (2, 'b', 2, 2)")
    assert rows(s, "SELECT v, q FROM d WHERE k = 2") == [("b", 2)]
    for bad in ("INSERT INTO d VALUES (3, 'c', 5, 3)", "INSERT INTO d VALUES (3, 'b', 9, 2)", "INSERT INTO d VALUES (3, 'c', 9, NULL)", "INSERT INTO d(k, zz) VALUES (1, 2)", "INSERT INTO d(k) VALUES (1, 2)"):
        with pytest.raises(SqlError):
            s.sql(bad)
    for bad in ("CREATE TABLE c(a INTEGER CHECK (a > 0))", "CREATE TABLE c(a INTEGER, CHECK (a > 0))", "CREATE TABLE c(a INTEGER REFERENCES d(k))", "CREATE TABLE c(a INTEGER, FOREIGN KEY (a) REFERENCES d(k))", "CREATE TABLE c(a INTEGER, UNIQUE (b))"):
        with pytest.raises(SqlError):
            s.sql(bad)
    for bad in ("INSERT INTO", "UPDATE users", "DELETE users", "DROP users", "ALTER users", "CREATE VIEW v", "CREATE TABLE"):
        with pytest.raises(SqlError):
            s.sql(bad)
    assert rows(s, "SELECT count(*) FROM d") == [(2,)]


def test_on_conflict(s):
    s.sql("INSERT INTO users VALUES (1, 'x', 9), (3, 'cyn', 50) ON CONFLICT DO NOTHING")
    assert rows(s, "SELECT id, name FROM users") == [(1, "ann"), (2, "bob"), (3, "cyn")]
    s.sql("INSERT INTO users VALUES (1, 'y', 5), (4, 'dan', 1) ON CONFLICT (id) DO UPDATE SET age = age + excluded.age, name = excluded.name")
    s.sql("INSERT INTO users VALUES (3, 'z', 5), (4, 'z', 5) ON CONFLICT (id) DO UPDATE SET name = excluded.name WHERE age > 10")
    assert rows(s, "SELECT id, name, age FROM users WHERE id <> 2") == [(1, "y", 35), (3, "z", 50), (4, "dan", 1)]
    with pytest.raises(SqlError):
        s.sql("INSERT INTO users VALUES (3, 'z', 5) ON CONFLICT (name) DO UPDATE SET age = 1")


@pytest.fixture()
def two(spark):
    db = Database()
    a, b = Session(spark, db), Session(spark, db)
    a.sql("CREATE TABLE oncall(id INTEGER PRIMARY KEY, role TEXT, n INTEGER)")
    a.sql("INSERT INTO oncall VALUES (1, 'admin', 1), (2, 'admin', 1), (3, 'user', 1)")
    return a, b


def test_write_skew_is_refused(two):
    a, b = two
    for x, i in ((a, 1), (b, 2)):
        x.sql("BEGIN")
        assert rows(x, "SELECT count(*) FROM oncall WHERE role = 'admin'") == [(2,)]
        x.sql(f"UPDATE oncall SET role = 'admin', n = 0 WHERE id = {i}")
    a.sql("COMMIT")
    with pytest.raises(SerializationError, match="serialization failure"):
        b.sql("COMMIT")
    assert rows(b, "SELECT id, n FROM oncall") == [(1, 0), (2, 1), (3, 1)]


def test_phantoms_and_repeatable_reads(two):
    a, b = two
    a.sql("BEGIN")
    assert rows(a, "SELECT id FROM oncall WHERE role = 'admin'") == [(1,), (2,)]
    b.sql("INSERT INTO oncall VALUES (9, 'admin', 1)")
    assert rows(a, "SELECT id FROM oncall WHERE role = 'admin'") == [(1,), (2,)]  # the state it began with
    a.sql("INSERT INTO oncall VALUES (10, 'user', 1)")
    with pytest.raises(SerializationError):
        a.sql("COMMIT")
    assert rows(a, "SELECT id FROM oncall") == [(1,), (2,), (3,), (9,)]


def test_unrelated_transactions_both_commit(two):
    a, b = two
    a.sql("BEGIN")
    b.sql("BEGIN")
    assert rows(a, "SELECT n FROM oncall WHERE id = 1") == [(1,)]
    a.sql("UPDATE oncall SET n = 5 WHERE id = 1")
    b.sql("UPDATE oncall SET n = 6 WHERE id = 3")
    b.sql("DELETE FROM oncall WHERE id = 2")
    a.sql("COMMIT")
    b.sql("COMMIT")
    assert rows(a, "SELECT id, n FROM oncall") == [(1, 5), (3, 6)]


def test_readers_never_fail_and_retry_runs_again(two):
    a, b = two
    a.sql("BEGIN")
    rows(a, "SELECT * FROM oncall")
    b.sql("UPDATE oncall SET n = 2")
    a.sql("COMMIT")
    a.retry("UPDATE oncall SET n = n + 1 WHERE id = 1", "DELETE FROM oncall WHERE id = 2")
    assert rows(b, "SELECT id, n FROM oncall") == [(1, 3), (3, 2)]
    a.sql("BEGIN")
    a.sql("ALTER TABLE oncall ADD COLUMN z INTEGER")
    b.sql("INSERT INTO oncall VALUES (7, 'user', 1)")
    with pytest.raises(SerializationError):
        a.sql("COMMIT")


def test_predicates_are_three_valued(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None)], "a long, b long, t string")
    types = {"a": "integer", "b": "integer", "t": "text"}
    hit = lambda p: [r.a for r in df.filter(p.column(types)).collect()]
    assert hit(P.cmp("b", ">", 1)) == [2] and hit(P.negate(P.cmp("b", ">", 1))) == [] and hit(P.is_null("b")) == [1]
    assert hit(P.cmp("t", "=", 5)) == [] and hit(P.either(P.cmp("t", "=", 5), P.cmp("a", "=", 1.0))) == [1] and hit(P.colcmp("a", "<", "b")) == [2]
