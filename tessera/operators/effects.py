"""State as a reduction of an append-only effect log, and the set-at-a-time forms of writes.

effects(key, elem, op, merge, value, hlc, node): op is 'insert' or 'remove'; merge is 'lww', 'add_int', 'add_float' or
'max'. The order of writes is (hlc, node). One partial aggregation reduces a log of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """delta's rows in place of base's with the same keys. delta has one row a key."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def anti_delete(base: DataFrame, victims: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(victims.select(*keys).distinct(), keys, "left_anti")


def last_write(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last of several writes to a key."""
    rest = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def reduce_effects(log: DataFrame) -> DataFrame:
    """(key, elem, merge, value): the live elements. A removed element is gone until a later insert; counters add
    only what came after the last remove; sketches keep the greatest bytes."""
    at = F.struct("hlc", "node")
    gone = log.filter("op = 'remove'").groupBy("key", "elem").agg(F.max(at).alias("gone"))
    live = log.filter("op = 'insert'").join(gone, ["key", "elem"], "left").filter(F.col("gone").isNull() | (at > F.col("gone")))
    got = live.groupBy("key", "elem").agg(
        F.max_by("merge", at).alias("merge"), F.max_by("value", at).alias("lww"),
        F.sum(F.when(F.col("merge") == "add_int", F.expr("try_cast(value AS bigint)"))).alias("i"),
        F.sum(F.when(F.col("merge") == "add_float", F.expr("try_cast(value AS double)"))).alias("f"), F.max("value").alias("m"),
    )
    value = F.when(F.col("merge") == "add_int", F.col("i").cast("string")).when(F.col("merge") == "add_float", F.col("f").cast("string")).when(F.col("merge") == "max", F.col("m")).otherwise(F.col("lww"))
    return got.select("key", "elem", "merge", value.alias("value"))


def materialise(log: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Rows of a table whose columns are elements: each cast to its type, defaults where an element is absent."""
    state = reduce_effects(log)
    wide = state.groupBy("key").agg(*[F.max(F.when(F.col("elem") == c, F.col("value"))).alias(c) for c in columns])
    return wide.select("key", *[F.coalesce(F.expr(f"try_cast(`{c}` AS {t})"), F.lit(d).cast(t)).alias(c) for c, (t, d) in columns.items()])


def live(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows without an expiry or with one after now. now is bound once for a query."""
    return df.filter(F.col(expires).isNull() | (F.col(expires) > now))
