"""Reading and writing tables: driver fixtures, any file format Spark has, the effect log, and a certificate-style store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.effects import anti_delete, upsert

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    r = spark.read.format(form).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    """sort_by clusters files by ranges of those columns, so that later ranges of them skip row groups: an index's place."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    w = out.write.mode("overwrite").format(form)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def commands(lines: DataFrame) -> DataFrame:
    """lines(value) of inline commands as (name, args): words between blanks, quotes kept together."""
    words = F.regexp_extract_all("value", F.lit(r"(\"(?:[^\"\\]|\\.)*\"|'[^']*'|\S+)"), 1)
    clean = F.transform(words, lambda w: F.when(w.rlike("^['\"].*['\"]$"), F.regexp_replace(w, "^['\"]|['\"]$", "")).otherwise(w))
    return lines.select(F.upper(F.get(clean, F.lit(0))).alias("name"), F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))).alias("args")).filter("name IS NOT NULL AND name <> ''")


# --- files by path: c(path, value, modified) ------------------------------------------------------


def store(c: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(c, new, ["path"])


def load(c: DataFrame, path: str) -> DataFrame:
    return c.filter(F.col("path") == path).select("path", "value")


def exists(c: DataFrame, path: str) -> DataFrame:
    """A file, or a folder with files below it."""
    return c.agg(F.coalesce(F.bool_or((F.col("path") == path) | F.col("path").startswith(path + "/")), F.lit(False)).alias("there"))


def delete(c: DataFrame, path: str) -> DataFrame:
    return anti_delete(c, c.filter((F.col("path") == path) | F.col("path").startswith(path + "/")), ["path"])


def list_below(c: DataFrame, prefix: str, recursive: bool) -> DataFrame:
    """Paths below a folder; without recursive, its direct children only, folders once."""
    base = prefix.rstrip("/") + "/" if prefix else ""
    below = c.filter(F.col("path").startswith(base))
    if recursive:
        return below.select("path")
    return below.select(F.concat(F.lit(base), F.element_at(F.split(F.substr("path", F.lit(len(base) + 1)), "/"), 1)).alias("path")).distinct()


def stat(c: DataFrame, path: str) -> DataFrame:
    return c.filter(F.col("path") == path).select("path", F.octet_length("value").alias("size"), "modified")
