"""Bitmaps as offsets of set bits: b(key, offset); bit 0 is the most significant of the first byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.effects import anti_delete


def length(b: DataFrame) -> DataFrame:
    """Bytes of each key's string form."""
    return b.groupBy("key").agg((F.floor(F.max("offset") / 8) + 1).cast("long").alias("bytes"))


def getbit(b: DataFrame, offset: int) -> DataFrame:
    return b.groupBy("key").agg(F.max(F.when(F.col("offset") == offset, 1).otherwise(0)).alias("bit"))


def setbit(b: DataFrame, writes: DataFrame) -> DataFrame:
    """b after writes(pos, key, offset, bit); the last write to a bit counts."""
    last = writes.groupBy("key", "offset").agg(F.max_by("bit", "pos").alias("bit"))
    return anti_delete(b, last, ["key", "offset"]).unionByName(last.filter("bit = 1").select("key", "offset"))


def _bit_range(b: DataFrame, start: int, end: int, unit: str) -> DataFrame:
    size = 8 if unit == "BYTE" else 1
    j = b.join(length(b), "key")
    total = F.col("bytes") * (8 // size)
    lo = F.greatest(F.lit(start) if start >= 0 else total + start, F.lit(0)) * size
    hi = (F.least(F.lit(end) if end >= 0 else total + end, total - 1) + 1) * size
    return j.withColumns({"lo": lo, "hi": hi})


def bitcount(b: DataFrame, start: int = 0, end: int = -1, unit: str = "BYTE") -> DataFrame:
    r = _bit_range(b, start, end, unit)
    return r.groupBy("key").agg(F.count_if((F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi"))).alias("n"))


def bitcount_dense(b: DataFrame) -> DataFrame:
    """The same for whole keys through Spark's bitmap aggregates: fixed-size buckets, partial aggregation."""
    per = b.groupBy("key", F.bitmap_bucket_number("offset").alias("bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("offset"))).alias("n"))
    return per.groupBy("key").agg(F.sum("n").alias("n"))


def bitpos(b: DataFrame, bit: int, start: int = 0, end: int | None = None, unit: str = "BYTE") -> DataFrame:
    """The first set or clear bit of the range; -1 without one. A clear bit with no end given may lie behind the last byte."""
    r = _bit_range(b, start, -1 if end is None else end, unit)
    keys = r.groupBy("key").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    inside = r.filter((F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi")))
    if bit:
        hit = inside.groupBy("key").agg(F.min("offset").alias("pos"))
        return keys.join(hit, "key", "left").select("key", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"))
    # The first gap: where a set bit isn't at lo plus its rank.
    n = F.row_number().over(Window.partitionBy("key").orderBy("offset")) - 1
    run = inside.select("key", "offset", "lo").distinct().withColumn("n", n).filter(F.col("offset") == F.col("lo") + F.col("n")).groupBy("key").agg(F.count("*").alias("ones"))
    pos = F.col("lo") + F.coalesce("ones", F.lit(0))
    beyond = F.when(pos < F.col("hi"), pos) if end is not None else pos
    return keys.join(run, "key", "left").select("key", F.coalesce(beyond, F.lit(-1)).cast("long").alias("pos"))


def bitop(b: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """Offsets of AND, OR, XOR, ONE (in just one), DIFF (first and none of the rest), DIFF1 (the rest, not the first),
    ANDOR (first and any of the rest), or NOT of one key: one aggregation by offset."""
    mine = b.filter(F.col("key").isin(keys))
    if op == "NOT":
        span = length(mine).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") * 8 - 1)).alias("offset"))
        return span.join(mine.select("offset"), "offset", "left_anti")
    first = F.count_if(F.col("key") == keys[0])
    rest = F.count_if(F.col("key") != keys[0])
    g = mine.distinct().groupBy("offset").agg(first.alias("x"), rest.alias("y"))
    test = {"AND": f"x + y = {len(set(keys))}", "OR": "true", "XOR": "(x + y) % 2 = 1", "ONE": "x + y = 1", "DIFF": "x = 1 AND y = 0", "DIFF1": "x = 0 AND y > 0", "ANDOR": "x = 1 AND y > 0"}[op]
    return g.filter(test).select("offset")


# --- packed integers -----------------------------------------------------------------------------


def bitfield_get(b: DataFrame, bits: int, offset: int, signed: bool) -> DataFrame:
    """The integer of `bits` bits at offset of each key."""
    inside = (F.col("offset") >= offset) & (F.col("offset") < offset + bits)
    place = F.lit(offset + bits - 1) - F.col("offset")
    raw = b.groupBy("key").agg(F.coalesce(F.sum(F.when(inside, F.expr("CAST(1 AS BIGINT)") * F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))), F.lit(0)).alias("raw"))
    if signed and bits < 64:
        value = F.when(F.col("raw") >= (1 << (bits - 1)), F.col("raw") - F.lit(1 << bits) if bits < 63 else F.col("raw") - F.lit(1 << 62) - F.lit(1 << 62)).otherwise(F.col("raw"))
    else:
        value = F.col("raw")
    return raw.select("key", value.cast("long").alias("value"))


def overflow(value: Column, bits: int, signed: bool, mode: str) -> Column:
    """An integer beyond its type by WRAP, SAT or FAIL (null). value is a decimal(38,0)."""
    lo, hi = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    lit = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    v = value.cast("decimal(38,0)")
    if mode == "SAT":
        out = F.greatest(lit(lo), F.least(lit(hi), v))
    elif mode == "FAIL":
        out = F.when(v.between(lit(lo), lit(hi)), v)
    else:
        out = F.pmod(v - lit(lo), lit(1 << bits)) + lit(lo)
    return out.cast("long")


def bitfield_set(b: DataFrame, bits: int, offset: int, values: DataFrame) -> DataFrame:
    """b after writing values(key, value) at offset, two's complement."""
    at = values.select("key", F.col("value").cast("long").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("i"))
    on = at.filter(F.call_function("shiftright", F.col("value"), F.lit(bits - 1) - F.col("i")).bitwiseAND(F.lit(1)) == 1).select("key", (F.lit(offset) + F.col("i")).cast("long").alias("offset"))
    hit = b.join(values.select("key").distinct().withColumn("w", F.lit(1)), "key", "left")
    kept = hit.filter(F.col("w").isNull() | ~F.col("offset").between(offset, offset + bits - 1)).select("key", "offset")
    return kept.unionByName(on)


def bitfield_incrby(b: DataFrame, bits: int, offset: int, deltas: DataFrame, signed: bool, mode: str = "WRAP") -> tuple[DataFrame, DataFrame]:
    """(new values, b after) of deltas(key, delta); FAIL leaves a key whose sum doesn't fit, with a null value."""
    old = bitfield_get(b, bits, offset, signed)
    j = deltas.join(old, "key", "left").select("key", overflow(F.coalesce("value", F.lit(0)).cast("decimal(38,0)") + F.col("delta").cast("decimal(38,0)"), bits, signed, mode).alias("value"))
    return j, bitfield_set(b, bits, offset, j.filter("value IS NOT NULL"))
