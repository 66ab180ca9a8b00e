"""Cardinality sketches: registers reg(key, reg, rho) of 16,384 registers, and Spark's own sketches where only the estimate matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS = 16_384
INDEX_BITS = 14


def pfadd(elements: DataFrame) -> DataFrame:
    """Registers of elements(key, element). Partial aggregation keeps at most 16,384 rows a key and task."""
    h = F.xxhash64("element")
    rest = F.shiftrightunsigned(h, INDEX_BITS)
    # The place of the lowest set bit of the other 50, from 1; 51 if there is none.
    low = rest.bitwiseAND(-rest)
    rho = F.when(rest == 0, 51).otherwise(F.length(F.bin(low))).cast("int")
    return elements.select("key", h.bitwiseAND(F.lit(REGISTERS - 1)).cast("int").alias("reg"), rho.alias("rho")).groupBy("key", "reg").agg(F.max("rho").alias("rho"))


def pfmerge(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key", "reg").agg(F.max("rho").alias("rho"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """1 for each key with a raised register."""
    j = after.join(before.withColumnRenamed("rho", "old"), ["key", "reg"], "left")
    return j.groupBy("key").agg(F.max((F.col("old").isNull() | (F.col("rho") > F.col("old"))).cast("int")).alias("changed"))


def pfcount(reg: DataFrame) -> DataFrame:
    """The estimate of each key: linear counting while registers are empty and the raw estimate is small."""
    m = float(REGISTERS)
    s = reg.groupBy("key").agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s"), F.count("*").alias("filled"))
    empty = F.lit(m) - F.col("filled")
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (F.col("s") + empty)
    small = F.lit(m) * F.log(F.lit(m) / empty)
    return s.select("key", F.round(F.when((raw <= 2.5 * m) & (empty > 0), small).otherwise(raw)).cast("long").alias("n"))


def pfcount_union(reg: DataFrame, keys: list[str]) -> DataFrame:
    return pfcount(reg.filter(F.col("key").isin(keys)).groupBy("reg").agg(F.max("rho").alias("rho")).withColumn("key", F.lit("union"))).select("n")


def decode(reg: DataFrame) -> DataFrame:
    """All registers of each key in order, empty ones as 0."""
    every = reg.sparkSession.range(REGISTERS).select(F.col("id").cast("int").alias("reg"))
    return reg.select("key").distinct().crossJoin(F.broadcast(every)).join(reg, ["key", "reg"], "left").select("key", "reg", F.coalesce("rho", F.lit(0)).alias("rho"))


def sketch(elements: DataFrame) -> DataFrame:
    return elements.groupBy("key").agg(F.hll_sketch_agg("element", F.lit(INDEX_BITS)).alias("sketch"))


def sketch_count(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
