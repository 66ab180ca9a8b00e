"""The families' frames derived from the driver tables, and the same as SQL common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

NOW = "2024-01-01 12:00:00"

CTE = {
    "z": "z AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)",
    "zo": "zo AS (SELECT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score FROM orders GROUP BY 1, 2)",
    "s": "s AS (SELECT DISTINCT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders)",
    "h": "h AS (SELECT 'part:' || p_partkey AS key, 'name' AS field, p_name AS value FROM part UNION ALL SELECT 'part:' || p_partkey, 'brand', p_brand FROM part UNION ALL SELECT 'part:' || p_partkey, 'type', p_type FROM part UNION ALL SELECT 'part:' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part)",
    "l": "l AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn AS seq, role || (turn % 3) AS value FROM conversations)",
    "kv": "kv AS (SELECT 'user:' || c_custkey AS key, c_name || '/' || c_mktsegment AS value, CASE WHEN c_custkey % 3 > 0 THEN epoch(TIMESTAMP '2024-01-01') + c_custkey * 60 END AS due FROM customer)",
    "b": "b AS (SELECT DISTINCT event_type AS key, user_id AS \"offset\" FROM events)",
    "g": "g AS (SELECT CAST(c_nationkey AS VARCHAR) AS key, c_name AS member, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 10007 % 17000) / 100.0 - 85 AS lat FROM customer)",
    "d": "d AS (SELECT CAST(event_id AS VARCHAR) AS key, props AS doc, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
    "e": "e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, user_id, value FROM events)",
    "m": "m AS (SELECT event_type AS channel, CAST(event_id AS VARCHAR) AS payload FROM events)",
}


def sql(uses: str, body: str) -> str:
    """body with the named fixtures before it."""
    text = body.strip()
    head = "WITH " + ", ".join(CTE[u] for u in uses.split())
    return f"{head}, {text.removeprefix('WITH ')}" if text.startswith("WITH ") else f"{head} {text}"


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.now = F.lit(NOW).cast("timestamp")

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def z(self) -> DataFrame:
        return self.t("customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))

    @cached_property
    def zo(self) -> DataFrame:
        return self.t("orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member")).agg(F.count("*").cast("double").alias("score"))

    @cached_property
    def s(self) -> DataFrame:
        return self.t("orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()

    @cached_property
    def h(self) -> DataFrame:
        key = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
        fields = [F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value")) for n, c in (("name", "p_name"), ("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))]
        return self.t("part").select(key.alias("key"), F.explode(F.array(*fields)).alias("x")).select("key", "x.*")

    @cached_property
    def l(self) -> DataFrame:  # noqa: E743
        return self.t("conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("value"))

    @cached_property
    def kv(self) -> DataFrame:
        at = F.when(F.col("c_custkey") % 3 > 0, F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("c_custkey") * 60))
        return self.t("customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"), F.concat_ws("/", "c_name", "c_mktsegment").alias("value"), at.alias("expires_at"))

    @cached_property
    def b(self) -> DataFrame:
        return self.t("events").select(F.col("event_type").alias("key"), F.col("user_id").alias("offset")).distinct()

    @cached_property
    def points(self) -> DataFrame:
        lon, lat = (F.col("c_custkey") * 7919 % 36000) / 100.0 - 180, (F.col("c_custkey") * 10007 % 17000) / 100.0 - 85
        return self.t("customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_name").alias("member"), lon.alias("lon"), lat.alias("lat"))

    @cached_property
    def d(self) -> DataFrame:
        return self.t("events").select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("doc"))

    @cached_property
    def e(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("string"))
        return self.t("events").select(F.col("event_type").alias("key"), F.unix_millis(ts).alias("ms"), F.col("event_id").alias("seq"), fields.alias("fields"))

    @cached_property
    def m(self) -> DataFrame:
        return self.t("events").select(F.col("event_type").alias("channel"), F.col("event_id").cast("string").alias("payload"))

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)
