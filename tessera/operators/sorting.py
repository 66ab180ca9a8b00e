"""SORT: elements of a list, set or sorted set ordered by themselves or by a looked-up weight, with looked-up columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lookup(rows: DataFrame, pattern: str, kv: DataFrame | None, h: DataFrame | None, name: str) -> DataFrame:
    """Adds the value under the key that pattern gives with * as the element; pattern->field reads a hash, # the element."""
    if pattern == "#":
        return rows.withColumn(name, F.col("value"))
    key, _, field = pattern.partition("->")
    left, _, right = key.partition("*")
    target = F.concat(F.lit(left), F.col("value"), F.lit(right)) if "*" in key else F.lit(key)
    side = (h.filter(F.col("field") == field) if field else kv).select(F.col("key").alias("__key"), F.col("value").alias(name))
    return rows.withColumn("__target", target).join(side, F.col("__target") == F.col("__key"), "left").drop("__target", "__key")


def sort(items: DataFrame, by: str | None = None, get: tuple[str, ...] = (), alpha: bool = False, desc: bool = False, limit: tuple[int, int] | None = None, kv: DataFrame | None = None, h: DataFrame | None = None) -> DataFrame:
    """items(key, value) with pos in each key's order and got_0, got_1, ... for the asked patterns. Equal weights are
    ordered by element. A weight that is no number counts as 0. A `by` without * doesn't order: elements keep theirs."""
    rows = items
    if by is None:
        weight = F.col("value")
    elif "*" in by:
        rows = _lookup(rows, by, kv, h, "weight")
        weight = F.col("weight")
    else:
        weight = F.lit("")
    order = weight if alpha else F.coalesce(weight.try_cast("double"), F.lit(0.0))
    keys = [order.desc(), F.col("value").desc()] if desc else [order, F.col("value")]
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*keys)) - 1)
    if limit:
        rows = rows.filter((F.col("pos") >= limit[0]) & ((F.col("pos") < limit[0] + limit[1]) if limit[1] >= 0 else F.lit(True)))
    for i, g in enumerate(get):
        rows = _lookup(rows, g, kv, h, f"got_{i}")
    return rows.select("key", "pos", "value", *[f"got_{i}" for i in range(len(get))])


def store(sorted_rows: DataFrame, key: str) -> DataFrame:
    """The result as a list."""
    value = "got_0" if "got_0" in sorted_rows.columns else "value"
    return sorted_rows.select(F.lit(key).alias("key"), F.col("pos").cast("long").alias("seq"), F.coalesce(value, F.lit("")).alias("value"))
