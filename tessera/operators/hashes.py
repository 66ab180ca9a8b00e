"""Hashes in long form: h(key, field, value[, field_expires_at])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import glob
from tessera.operators.effects import anti_delete, upsert


def hget(h: DataFrame, field: str) -> DataFrame:
    return h.filter(F.col("field") == field).select("key", "value")


def hmget(h: DataFrame, fields: list[str]) -> DataFrame:
    """One row a key with the asked fields' values in order, null where absent."""
    m = h.filter(F.col("field").isin(fields)).groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return m.select("key", F.array(*fields).alias("values"))


def hset(h: DataFrame, writes: DataFrame, only_new: bool = False) -> DataFrame:
    """h after writes(pos, key, field, value); only_new leaves fields that exist. A written field loses its expiry."""
    last = writes.groupBy("key", "field").agg(F.max_by("value", "pos").alias("value"))
    if only_new:
        last = last.join(h.select("key", "field"), ["key", "field"], "left_anti")
    return upsert(h, last, ["key", "field"])


def created(h: DataFrame, writes: DataFrame) -> DataFrame:
    """How many fields each key gains."""
    new = writes.select("key", "field").distinct().join(h.select("key", "field"), ["key", "field"], "left_anti")
    return writes.select("key").distinct().join(new.groupBy("key").agg(F.count("*").alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("created"))


def hdel(h: DataFrame, victims: DataFrame) -> DataFrame:
    return anti_delete(h, victims, ["key", "field"])


def hexists(h: DataFrame, asked: DataFrame) -> DataFrame:
    j = asked.join(h.select("key", "field", F.lit(1).alias("there")), ["key", "field"], "left")
    return j.select("key", "field", F.coalesce("there", F.lit(0)).alias("there"))


def hgetall(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hkeys(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def hvals(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "value"))), lambda x: x["value"]).alias("values"))


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("n"))


def hstrlen(h: DataFrame, field: str) -> DataFrame:
    return h.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("field") == field, F.octet_length("value"))), F.lit(0)).alias("len"))


def hincrby(h: DataFrame, deltas: DataFrame, kind: str = "long") -> DataFrame:
    """(key, field, value, error) after adding deltas(key, field, delta); kind long checks 64 bits, double NaN and infinity."""
    inner = "decimal(38,0)" if kind == "long" else "double"
    d = deltas.groupBy("key", "field").agg(F.sum(F.col("delta").cast(inner)).alias("delta"))
    j = d.join(h.select("key", "field", "value"), ["key", "field"], "left")
    old = F.when(F.col("value").isNull(), F.lit(0).cast(inner)).otherwise(F.expr(f"try_cast(value AS {inner})"))
    new = old + F.col("delta")
    ok = new.between(F.lit(-(1 << 63)).cast(inner), F.lit((1 << 63) - 1).cast(inner)) if kind == "long" else ~F.isnan(new) & (F.abs(new) < float("inf"))
    return j.select("key", "field", F.when(ok, new).cast(kind).alias("value"), F.when(old.isNull(), "not a number").when(~ok, "out of range").alias("error"))


def hrandfield(h: DataFrame, count: int, seed: int) -> DataFrame:
    """count distinct random fields a key; -count with repetition."""
    from pyspark.sql.window import Window

    if count >= 0:
        return h.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.rand(seed)))).filter(F.col("r") <= count).select("key", "field", "value")
    numbered = h.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("field")))
    draws = hlen(h).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(-count)))).withColumn("r", (F.floor(F.rand(seed) * F.col("n")) + 1).cast("int"))
    return draws.join(numbered, ["key", "r"]).select("key", "field", "value")


def hscan(h: DataFrame, cursor: str | None, pattern: str = "*", count: int = 10) -> DataFrame:
    from pyspark.sql.window import Window

    rows = h if cursor is None else h.filter(F.col("field") > cursor)
    page = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("field"))).filter(F.col("r") <= count)
    return page.filter(glob("field", pattern)).select("key", "field", "value")


def hgetdel(h: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    return h.join(fields.select("key", "field").distinct(), ["key", "field"], "left_semi").select("key", "field", "value"), hdel(h, fields)


def hexpire(h: DataFrame, asked: DataFrame, now: Column, condition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(codes, h after): asked(key, field, new_at). -2 no field, 0 condition failed, 2 already due and deleted, 1 set.
    GT and LT refuse only what lies before or after the present expiry; a field without one takes GT."""
    j = asked.join(h.select("key", "field", "field_expires_at", F.lit(True).alias("there")), ["key", "field"], "left")
    old, new = F.col("field_expires_at"), F.col("new_at")
    ok = {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNull() | (new >= old), "LT": old.isNull() | (new <= old)}[condition]
    codes = j.select("key", "field", "new_at", F.when(F.col("there").isNull(), -2).when(~ok, 0).when(new <= now, 2).otherwise(1).alias("code"))
    after = h.join(codes.filter("code > 0"), ["key", "field"], "left").filter("code IS NULL OR code <> 2")
    return codes.select("key", "field", "code"), after.withColumn("field_expires_at", F.when(F.col("code") == 1, F.col("new_at")).otherwise(F.col("field_expires_at"))).select(*h.columns)


def httl(h: DataFrame, asked: DataFrame, now: Column, unit: str = "s", absolute: bool = False) -> DataFrame:
    j = asked.join(h.select("key", "field", "field_expires_at", F.lit(True).alias("there")), ["key", "field"], "left")
    clock = F.unix_seconds if unit == "s" else F.unix_millis
    left = clock("field_expires_at") if absolute else clock("field_expires_at") - clock(now)
    return j.select("key", "field", F.when(F.col("there").isNull(), -2).when(F.col("field_expires_at").isNull(), -1).otherwise(left).cast("long").alias("ttl"))


def hpersist(h: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes -2 no field, -1 no expiry, 1 removed; and h after."""
    j = asked.join(h.select("key", "field", "field_expires_at", F.lit(True).alias("there")), ["key", "field"], "left")
    codes = j.select("key", "field", F.when(F.col("there").isNull(), -2).when(F.col("field_expires_at").isNull(), -1).otherwise(1).alias("code"))
    after = h.join(asked.select("key", "field", F.lit(True).alias("hit")).distinct(), ["key", "field"], "left")
    return codes, after.withColumn("field_expires_at", F.when(F.col("hit").isNull(), F.col("field_expires_at"))).select(*h.columns)


def hsetex(h: DataFrame, writes: DataFrame, condition: str | None = None, keep_ttl: bool = False) -> DataFrame:
    """writes(pos, key, field, value, field_expires_at), all of a key or none: FNX none of its fields may exist, FXX all must.
    Its joins are merges: Spark guesses exploded fields at their file's size and would broadcast any number of them."""
    h = h.hint("merge")
    last = writes.groupBy("key", "field").agg(F.max_by("value", "pos").alias("value"), F.max_by("field_expires_at", "pos").alias("field_expires_at"))
    old = h.select("key", "field", F.col("field_expires_at").alias("old_at"), F.lit(1).alias("there"))
    j = last.join(old, ["key", "field"], "left")
    state = j.groupBy("key").agg(F.count("*").alias("asked"), F.count("there").alias("have"))
    gate = {None: state, "FNX": state.filter("have = 0"), "FXX": state.filter("have = asked")}[condition].select("key")
    at = F.coalesce("field_expires_at", "old_at") if keep_ttl else F.col("field_expires_at")
    return upsert(h, j.join(gate.hint("merge"), "key", "left_semi").select("key", "field", "value", at.alias("field_expires_at")), ["key", "field"])


def hgetex(h: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of changes(key, field, new_at) and h with the new expiries; null persists."""
    read = h.join(changes.select("key", "field", "new_at"), ["key", "field"])
    return read.select("key", "field", "value"), upsert(h, read.select("key", "field", "value", F.col("new_at").alias("field_expires_at")), ["key", "field"])
