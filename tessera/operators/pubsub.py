"""Messages m(channel, payload) against subscriptions s(client, pattern, is_glob): at most once, no history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex


def deliveries(m: DataFrame, s: DataFrame) -> DataFrame:
    """One row for each receiver: an equi-join for channels; patterns are matched against distinct channels only."""
    exact = m.join(s.filter("NOT is_glob"), F.col("channel") == F.col("pattern")).select("client", "channel", "pattern", "payload")
    regex = F.pandas_udf(lambda patterns: patterns.map(glob_regex), "string")
    patterns = s.filter("is_glob").withColumn("regex", regex("pattern"))
    matched = m.select("channel").distinct().join(patterns, F.expr("channel rlike regex")).select(F.col("channel").alias("c"), "client", "pattern")
    return exact.unionByName(m.join(matched, F.col("channel") == F.col("c")).select("client", "channel", "pattern", "payload"))


def publish(m: DataFrame, s: DataFrame) -> DataFrame:
    """How many receivers each channel's messages reached."""
    n = deliveries(m, s).groupBy("channel").agg(F.count("*").alias("n"))
    return m.select("channel").distinct().join(n, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("receivers"))


def channels(s: DataFrame, pattern: str = "*") -> DataFrame:
    return s.filter("NOT is_glob").select(F.col("pattern").alias("channel")).distinct().filter(F.col("channel").rlike(glob_regex(pattern)))


def numsub(s: DataFrame) -> DataFrame:
    return s.filter("NOT is_glob").groupBy(F.col("pattern").alias("channel")).agg(F.countDistinct("client").alias("n"))


def numpat(s: DataFrame) -> DataFrame:
    return s.filter("is_glob").agg(F.countDistinct("pattern").alias("n"))
