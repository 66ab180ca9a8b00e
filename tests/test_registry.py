import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.registry import Registry, ScriptError, register_sql


def total(keys, args):
    return keys["n"].agg((F.sum("v") + args[0]).alias("s"))


def grow(keys, args):
    return {"n": keys["n"].withColumn("v", F.col("v") + 1)}


def test_scripts_and_libraries(spark):
    r, n = Registry(), spark.createDataFrame([(1,), (2,)], "v long")
    sha = r.load(total)
    assert r.exists(sha, "x") == [1, 0] and r.evalsha(sha, {"n": n}, [10]).first().s == 13
    with pytest.raises(ScriptError):
        r.eval(grow, {"n": n}, [], read_only=True)
    r.load_library("lib", {"total": total, "grow": grow}, frozenset({"total"}))
    with pytest.raises(ScriptError):
        r.load_library("lib", {})
    assert r.fcall("total", {"n": n}, [0], read_only=True).first().s == 3
    with pytest.raises(ScriptError):
        r.fcall("grow", {"n": n}, [], read_only=True)
    r.flush()
    with pytest.raises(ScriptError):
        r.evalsha(sha, {}, [])


def test_sql_function(spark):
    def double(s: pd.Series) -> pd.Series:
        return s * 2

    register_sql(spark, "twice_it", double, "long")
    assert [x.d for x in spark.sql("SELECT twice_it(id) AS d FROM range(3)").collect()] == [0, 2, 4]
