import pytest

from tessera.operators.hashes import hsetex

AT, LATER = "2024-01-01 00:00:00", "2024-06-01 00:00:00"


@pytest.mark.parametrize(
    ("condition", "keep_ttl", "want"),
    [
        (None, False, {"a x": ("3", None), "a y": ("9", None), "b x": ("1", LATER), "b z": ("9", None), "c q": ("9", LATER), "d x": ("1", AT)}),
        (None, True, {"a x": ("3", AT), "a y": ("9", None), "b x": ("1", LATER), "b z": ("9", None), "c q": ("9", LATER), "d x": ("1", AT)}),
        ("FXX", False, {"a x": ("3", None), "a y": ("9", None), "b x": ("1", AT), "d x": ("1", AT)}),
        ("FNX", False, {"a x": ("1", AT), "a y": ("2", None), "b x": ("1", AT), "c q": ("9", LATER), "d x": ("1", AT)}),
    ],
)
def test_hsetex(spark, condition, keep_ttl, want):
    h = spark.sql(f"SELECT key, field, value, CAST(at AS timestamp) AS field_expires_at FROM VALUES ('a', 'x', '1', '{AT}'), ('a', 'y', '2', null), ('b', 'x', '1', '{AT}'), ('d', 'x', '1', '{AT}') AS v(key, field, value, at)")
    w = spark.sql(f"SELECT pos, key, field, value, CAST(at AS timestamp) AS field_expires_at FROM VALUES (2, 'a', 'x', '3', null), (1, 'a', 'x', '2', '{LATER}'), (1, 'a', 'y', '9', null), (1, 'b', 'x', '1', '{LATER}'), (1, 'b', 'z', '9', null), (1, 'c', 'q', '9', '{LATER}') AS v(pos, key, field, value, at)")
    got = {f"{r.key} {r.field}": (r.value, r.at) for r in hsetex(h, w, condition, keep_ttl).selectExpr("key", "field", "value", "CAST(field_expires_at AS string) AS at").collect()}
    assert got == want


def test_hsetex_broadcasts_nothing(spark):
    from tessera.plans.queries import QUERIES

    df = QUERIES["hsetex_fxx"](spark, "/root/testdata/sf0.001")
    first = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == df.select("key", "field").distinct().count()
    df.collect()
    assert "Broadcast" not in first and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
