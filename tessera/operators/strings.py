"""Strings, counters, keys of any family and their expiry, over kv(key, value, expires_at).

Each function does for all keys of its input what the command of that name does for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import byte_slice, glob, lcs, lcs_ranges, xxh3_hex
from tessera.operators.effects import anti_delete, live, upsert

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def get(kv: DataFrame, now: Column) -> DataFrame:
    return live(kv, now).select("key", "value")


def mget(kv: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """asked(pos, key) with values, null where there is none."""
    return asked.join(get(kv, now), "key", "left").select("pos", "key", "value")


def strlen(kv: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(kv, "key", "left").select("key", F.coalesce(F.octet_length("value"), F.lit(0)).alias("len"))


def getrange(kv: DataFrame, start: int, end: int) -> DataFrame:
    return kv.select("key", byte_slice(F.col("value"), start, end).alias("part"))


def longest_common(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with their longest common subsequence, its length and its runs."""
    out = pairs.withColumn("lcs", lcs("a", "b"))
    return out.withColumns({"lcs_len": F.length("lcs"), "runs": lcs_ranges("a", "b")})


def digest(kv: DataFrame) -> DataFrame:
    return kv.select("key", xxh3_hex("value").alias("digest"))


def set_values(kv: DataFrame, writes: DataFrame, condition: str | None = None, keep_ttl: bool = False) -> DataFrame:
    """kv after writes(key, value[, expires_at, match]). condition: NX, XX, or IFEQ/IFNE/IFDEQ/IFDNE against match
    (a value, or its digest). A write drops the old expiry unless keep_ttl."""
    old = kv.select("key", F.col("value").alias("old"), F.col("expires_at").alias("old_at"), F.lit(True).alias("there"))
    w = writes.join(old, "key", "left")
    there = F.col("there").isNotNull()
    test = {
        None: lambda: F.lit(True), "NX": lambda: ~there, "XX": lambda: there,
        "IFEQ": lambda: there & (F.col("old") == F.col("match")), "IFNE": lambda: ~there | (F.col("old") != F.col("match")),
        "IFDEQ": lambda: there & (xxh3_hex("old") == F.col("match")), "IFDNE": lambda: ~there | (xxh3_hex("old") != F.col("match")),
    }[condition]()
    at = F.col("expires_at") if "expires_at" in writes.columns else F.lit(None).cast("timestamp")
    done = w.filter(test).select("key", "value", (F.coalesce(at, F.col("old_at")) if keep_ttl else at).alias("expires_at"))
    return upsert(kv, done, ["key"])


def setnx(kv: DataFrame, writes: DataFrame) -> DataFrame:
    """writes with 1 where the key was free, else 0."""
    return writes.join(kv.select("key", F.lit(1).alias("there")), "key", "left").select("key", F.when(F.col("there").isNull(), 1).otherwise(0).alias("created"))


def getset(kv: DataFrame, writes: DataFrame) -> DataFrame:
    """The old value beside the new one; the expiry goes."""
    return writes.join(kv.select("key", F.col("value").alias("old")), "key", "left").select("key", "old", "value")


def getdel(kv: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return kv.join(keys.select("key").distinct(), "key", "left_semi").select("key", "value"), anti_delete(kv, keys, ["key"])


def getex(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(key, expires_at): values read, with the new expiry; null persists."""
    return kv.drop("expires_at").join(changes.select("key", "expires_at"), "key").select("key", "value", "expires_at")


def mset(kv: DataFrame, writes: DataFrame) -> DataFrame:
    """writes(pos, key, value): the last of a repeated key wins."""
    last = writes.groupBy("key").agg(F.max_by("value", "pos").alias("value")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    return upsert(kv, last, ["key"])


def msetnx(kv: DataFrame, writes: DataFrame, require: str = "NX") -> DataFrame:
    """All of writes or none: none may exist (NX), or all must (XX)."""
    last = writes.groupBy("key").agg(F.max_by("value", "pos").alias("value")).withColumn("expires_at", F.lit(None).cast("timestamp"))
    hit = last.join(kv.select("key"), "key", "left_semi").agg(F.count("*").alias("hit"))
    gate = hit.filter("hit = 0") if require == "NX" else hit.crossJoin(last.agg(F.count("*").alias("asked"))).filter("hit = asked").select("hit")
    return upsert(kv, last.crossJoin(F.broadcast(gate)).drop("hit"), ["key"])  # the gate is one row


def setrange(kv: DataFrame, offset: int, part: str) -> DataFrame:
    """part over the bytes from offset on; a shorter value is filled with zero bytes."""
    v = F.coalesce(F.col("value"), F.lit("")).cast("binary")
    n = len(part.encode())
    head = F.rpad(F.substring(v, 1, offset), offset, F.lit(b"\x00")) if offset else F.lit(b"")
    return kv.select("key", F.concat(head, F.lit(part.encode()), F.substring(v, F.lit(offset + n + 1), F.greatest(F.octet_length(v), F.lit(1)))).cast("string").alias("value"))


def append(kv: DataFrame, more: DataFrame) -> DataFrame:
    """more(key, part): new values and lengths; absent keys start empty."""
    new = more.join(kv.select("key", "value"), "key", "left").select("key", F.concat(F.coalesce("value", F.lit("")), "part").alias("value"))
    return new.withColumn("len", F.octet_length("value"))


def incrby(kv: DataFrame, deltas: DataFrame) -> DataFrame:
    """kv plus the sum of deltas(key, delta); a value that is no integer, or a sum beyond 64 bits, gives an error column."""
    d = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))
    joined = d.join(kv.select("key", "value"), "key", "left")
    old = F.when(F.col("value").isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(F.expr("try_cast(value AS decimal(38,0))"))
    new = old + F.col("delta")
    fits = new.between(F.lit(LONG_MIN).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)"))
    return joined.select("key", F.when(fits, new).cast("long").alias("value"), F.when(old.isNull(), "not an integer").when(~fits, "overflow").alias("error"))


def decrby(kv: DataFrame, deltas: DataFrame) -> DataFrame:
    return incrby(kv, deltas.select("key", (-F.col("delta").cast("decimal(38,0)")).alias("delta")))


def incrbyfloat(kv: DataFrame, deltas: DataFrame) -> DataFrame:
    """As incrby with doubles; NaN and infinite results are errors."""
    d = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("double")).alias("delta"))
    joined = d.join(kv.select("key", "value"), "key", "left")
    old = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.expr("try_cast(value AS double)"))
    new = old + F.col("delta")
    bad = F.isnan(new) | (F.abs(new) == float("inf"))
    return joined.select("key", F.when(~bad, new).alias("value"), F.when(old.isNull(), "not a float").when(bad, "NaN or infinity").alias("error"))


# --- keys of any family --------------------------------------------------------------------------


def exists(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """How many of asked(key) exist, repeats counted again."""
    return asked.join(keys.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


def delete(kv: DataFrame, victims: DataFrame) -> DataFrame:
    return anti_delete(kv, victims, ["key"])


def delex(kv: DataFrame, victims: DataFrame, condition: str | None = None) -> DataFrame:
    """Delete victims(key[, match]) whose value or digest meets the condition: IFEQ, IFNE, IFDEQ, IFDNE."""
    v = kv.join(victims, "key")
    seen = xxh3_hex("value") if condition in ("IFDEQ", "IFDNE") else F.col("value")
    test = F.lit(True) if condition is None else seen == F.col("match") if condition.endswith("EQ") else seen != F.col("match")
    return anti_delete(kv, v.filter(test), ["key"])


def rename(df: DataFrame, moves: DataFrame, only_free: bool = False) -> DataFrame:
    """Rows of moves(src, dst) under their new key, expiry and all; what dst held goes. only_free: leave a taken dst."""
    m = moves.join(df.select(F.col("key").alias("src")).distinct(), "src", "left_semi")
    if only_free:
        m = m.join(df.select(F.col("key").alias("dst")).distinct(), "dst", "left_anti")
    m = m.select("src", "dst")
    stays = df.join(m.select(F.col("dst").alias("key")), "key", "left_anti")
    moved = stays.join(m, F.col("key") == F.col("src"), "left")
    return moved.withColumn("key", F.coalesce("dst", "key")).select(*df.columns)


def copy(df: DataFrame, moves: DataFrame, replace: bool = False) -> DataFrame:
    m = moves if replace else moves.join(df.select(F.col("key").alias("dst")).distinct(), "dst", "left_anti")
    copies = df.join(m, F.col("key") == F.col("src")).withColumn("key", F.col("dst")).select(*df.columns)
    return df.join(copies.select("key").distinct(), "key", "left_anti").unionByName(copies)


def catalog(**families: DataFrame) -> DataFrame:
    """(key, type) of every family's keys."""
    out = None
    for kind, df in families.items():
        one = df.select(F.col("key").cast("string").alias("key")).distinct().withColumn("type", F.lit(kind))
        out = one if out is None else out.union(one)
    return out


def type_of(keys: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(keys, "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def keys(df: DataFrame, pattern: str) -> DataFrame:
    return df.select("key").distinct().filter(glob("key", pattern))


def scan(df: DataFrame, cursor: str | None, pattern: str = "*", count: int = 10) -> DataFrame:
    """A page of keys after cursor in key order, then those of it that match."""
    rows = df.select("key").distinct()
    page = (rows if cursor is None else rows.filter(F.col("key") > cursor)).orderBy("key").limit(count)
    return page.filter(glob("key", pattern))


def dbsize(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("key").alias("n"))


def randomkey(df: DataFrame, seed: int) -> DataFrame:
    return df.select("key").distinct().orderBy(F.rand(seed)).limit(1)


def flush(df: DataFrame) -> DataFrame:
    """A family without its keys (FLUSHDB; FLUSHALL does it to each): every row is a victim."""
    return delete(df, df.select("key"))


def clock(now: Column) -> tuple[Column, Column]:
    """TIME: seconds, and the microseconds beyond them."""
    micros = F.unix_micros(now)
    return F.floor(micros / 1_000_000).cast("long").alias("seconds"), F.pmod(micros, F.lit(1_000_000)).cast("long").alias("micros")


def refused(commands: DataFrame) -> DataFrame:
    """MOVE and SWAPDB: an error, as there is one database."""
    return commands.select("command", F.concat(F.lit("ERR "), "command", F.lit(" is not supported: there is one database")).alias("error"))


def memory_usage(df: DataFrame, *values: str) -> DataFrame:
    size = F.octet_length("key")
    for v in values:
        size = size + F.coalesce(F.octet_length(F.col(v).cast("string")), F.lit(0))
    return df.groupBy("key").agg(F.sum(size).alias("bytes"))


# --- expiry --------------------------------------------------------------------------------------


def expire(df: DataFrame, asked: DataFrame, now: Column, condition: str | None = None, keys: tuple[str, ...] = ("key",), at: str = "expires_at") -> DataFrame:
    """df after asked(keys..., new_at): NX only without an expiry, XX only with one, GT not before it (none is infinite),
    LT not after it. A moment before now deletes at once; now itself is stored as already due."""
    j = df.join(asked.select(*keys, "new_at"), list(keys), "left")
    old, new = F.col(at), F.col("new_at")
    ok = {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (new >= old), "LT": old.isNull() | (new <= old)}[condition]
    hit = new.isNotNull() & ok
    return j.filter(~(hit & (new < now))).withColumn(at, F.when(hit, new).otherwise(old)).select(*df.columns)


def persist(df: DataFrame, asked: DataFrame, at: str = "expires_at") -> DataFrame:
    j = df.join(asked.select("key", F.lit(True).alias("hit")).distinct(), "key", "left")
    return j.withColumn(at, F.when(F.col("hit").isNull(), F.col(at))).select(*df.columns)


def ttl(df: DataFrame, asked: DataFrame, now: Column, unit: str = "s", absolute: bool = False) -> DataFrame:
    """Time left, or the moment: -1 without an expiry, -2 without a key. unit: s or ms."""
    j = asked.join(df.select("key", "expires_at", F.lit(True).alias("there")), "key", "left")
    clock = F.unix_seconds if unit == "s" else F.unix_millis
    left = clock("expires_at") if absolute else clock("expires_at") - clock(now)
    return j.select("key", F.when(F.col("there").isNull(), -2).when(F.col("expires_at").isNull(), -1).otherwise(left).cast("long").alias("ttl"))
