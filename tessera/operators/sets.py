"""Sets in long form: s(key, member), without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.effects import anti_delete


def sadd(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.union(new.select("key", "member")).distinct()


def added(s: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("key", "member").distinct().join(s, ["key", "member"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def srem(s: DataFrame, victims: DataFrame) -> DataFrame:
    return anti_delete(s, victims, ["key", "member"])


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("n"))


def smismember(s: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(key, member) with 1 or 0."""
    j = asked.join(s.withColumn("hit", F.lit(1)), ["key", "member"], "left")
    return j.select("key", "member", F.coalesce("hit", F.lit(0)).alias("hit"))


def smembers(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("members"))


def smove(s: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(src, dst, member); members that src lacks don't move."""
    real = moves.join(s.select(F.col("key").alias("src"), "member"), ["src", "member"], "left_semi")
    left = srem(s, real.select(F.col("src").alias("key"), "member"))
    return sadd(left, real.select(F.col("dst").alias("key"), "member"))


def srandmember(s: DataFrame, count: int, seed: int) -> DataFrame:
    """count distinct members a key; -count with repetition."""
    if count >= 0:
        return s.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.rand(seed)))).filter(F.col("r") <= count).drop("r")
    numbered = s.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("member")))
    draws = scard(s).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(-count)))).withColumn("r", (F.floor(F.rand(seed) * F.col("n")) + 1).cast("int"))
    return draws.join(numbered, ["key", "r"]).select("key", "member")


def spop(s: DataFrame, count: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): ranks by a hash, so that both halves agree however often they are computed."""
    ranked = s.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "member"), "member")))
    return ranked.filter(F.col("r") <= count).drop("r"), ranked.filter(F.col("r") > count).drop("r")


def sinter(s: DataFrame, keys: list[str]) -> DataFrame:
    """Members of every key: one aggregation, whatever the number of keys."""
    asked = sorted(set(keys))
    return s.filter(F.col("key").isin(asked)).groupBy("member").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked)).select("member")


def sintercard(s: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    rows = sinter(s, keys)
    return (rows.limit(limit) if limit else rows).agg(F.count("*").alias("n"))


def sunion(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.filter(F.col("key").isin(keys)).select("member").distinct()


def sdiff(s: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first key that no other has."""
    first, rest = keys[0], keys[1:]
    return s.filter(F.col("key").isin(keys)).groupBy("member").agg(F.max(F.when(F.col("key") == first, 1)).alias("a"), F.max(F.when(F.col("key").isin(rest), 1)).alias("b")).filter("a = 1 AND b IS NULL").select("member")


def store(s: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """s with key holding just those members (SINTERSTORE, SUNIONSTORE, SDIFFSTORE)."""
    return s.filter(F.col("key") != key).unionByName(members.select(F.lit(key).alias("key"), "member"))
