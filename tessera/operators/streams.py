"""Streams e(key, ms, seq, fields) with monotone ids, consumer groups g(key, grp, last_ms, last_seq) and their pending
entries p(key, grp, consumer, ms, seq, delivered_at, deliveries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.effects import anti_delete, upsert



def _id() -> Column:
    return F.struct("ms", "seq")


_ENTRY = ["key", "ms", "seq"]
_PENDING = ["key", "grp", "ms", "seq"]


def parse_id(text: str, upper: bool = False) -> tuple[int, int, bool]:
    """(ms, seq, exclusive) of an id, - or +; a missing seq is the least or greatest."""
    open_, text = text.startswith("("), text.removeprefix("(")
    if text in "-+":
        return (0, 0, False) if text == "-" else ((1 << 63) - 1, (1 << 63) - 1, False)
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else ((1 << 63) - 1 if upper else 0), open_


def _after(ms: Column, seq: Column, strict: bool) -> Column:
    a, b = F.struct(F.col("ms"), F.col("seq")), F.struct(ms.alias("ms"), seq.alias("seq"))
    return a > b if strict else a >= b


def in_range(start: str, end: str) -> Column:
    (m1, s1, x1), (m2, s2, x2) = parse_id(start), parse_id(end, upper=True)
    lo = (F.col("ms") > m1) | ((F.col("ms") == m1) & ((F.col("seq") > s1) if x1 else (F.col("seq") >= s1)))
    hi = (F.col("ms") < m2) | ((F.col("ms") == m2) & ((F.col("seq") < s2) if x2 else (F.col("seq") <= s2)))
    return (F.col("ms") >= m1) & (F.col("ms") <= m2) & lo & hi  # the first two reach the scan


def xadd(e: DataFrame, new: DataFrame, maxlen: int | None = None, minid: str | None = None, nomkstream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(e after, rejected) of new(ord, key, ms, seq, fields): an id not above all before it is refused, never reordered.

    nomkstream: keys without a stream get none, and their rows are neither added nor rejected. maxlen, minid: the streams
    that got rows are trimmed.
    """
    if nomkstream:
        new = new.join(e.select("key").distinct(), "key", "left_semi").select(*new.columns)
    if maxlen is not None or minid is not None:
        after, rejected = xadd(e, new)
        keys = new.select("key").distinct()
        hit = after.join(keys, "key", "left_semi").select(*e.columns)
        hit = hit if maxlen is None else xtrim_maxlen(hit, maxlen)
        hit = hit if minid is None else xtrim_minid(hit, minid)
        return after.join(keys, "key", "left_anti").select(*e.columns).unionByName(hit), rejected
    last = e.groupBy("key").agg(F.max(_id()).alias("last"))
    before = F.max(_id()).over(Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    j = new.withColumn("before", before).join(last, "key", "left")
    ok = (F.col("before").isNull() | (_id() > F.col("before"))) & (F.col("last").isNull() | (_id() > F.col("last"))) & ((F.col("ms") > 0) | (F.col("seq") > 0))
    return e.unionByName(j.filter(ok).select(*e.columns)), j.filter(~ok).select(*new.columns)


def idempotent(new: DataFrame) -> DataFrame:
    """new(ord, producer, iid, ...): the first of each producer's message id."""
    w = Window.partitionBy("key", "producer", "iid").orderBy("ord")
    return new.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def auto_iid(fields: Column) -> Column:
    """A message id from content: SHA-256 of the sorted fields."""
    return F.sha2(F.concat_ws("\x1f", F.transform(F.array_sort(F.map_entries(fields)), lambda x: F.concat_ws("\x1e", x["key"], x["value"]))), 256)


def xlen(e: DataFrame) -> DataFrame:
    return e.groupBy("key").agg(F.count("*").alias("n"))


def xrange(e: DataFrame, start: str = "-", end: str = "+", count: int | None = None, rev: bool = False) -> DataFrame:
    order = [F.col("ms").desc(), F.col("seq").desc()] if rev else ["ms", "seq"]
    r = e.filter(in_range(start, end)).withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1)
    return r if count is None else r.filter(F.col("pos") < count)


def xread(e: DataFrame, after: DataFrame, count: int | None = None) -> DataFrame:
    """Entries behind after(key, last_ms, last_seq), oldest first."""
    j = e.join(after, "key").filter(_after(F.col("last_ms"), F.col("last_seq"), True))
    r = j.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("ms", "seq")) - 1)
    return (r if count is None else r.filter(F.col("pos") < count)).select(*e.columns)


def xtrim_maxlen(e: DataFrame, maxlen: int, approximate: int = 0) -> DataFrame:
    """The newest maxlen entries; approximate: whole nodes of so many entries go only."""
    w = Window.partitionBy("key")
    r = e.withColumns({"newest": F.row_number().over(w.orderBy(F.col("ms").desc(), F.col("seq").desc())), "n": F.count("*").over(w)})
    excess = F.greatest(F.col("n") - maxlen, F.lit(0))
    gone = F.floor(excess / approximate) * approximate if approximate else excess
    return r.filter(F.col("newest") <= F.col("n") - gone).select(*e.columns)


def xtrim_minid(e: DataFrame, minid: str) -> DataFrame:
    return e.filter(in_range(minid, "+"))


def xdel(e: DataFrame, ids: DataFrame) -> DataFrame:
    return anti_delete(e, ids, _ENTRY)


def xdelex(e: DataFrame, p: DataFrame, ids: DataFrame, policy: str = "KEEPREF") -> tuple[DataFrame, DataFrame]:
    """(e, p) after: KEEPREF leaves pending references, DELREF takes them too, ACKED deletes only entries none holds."""
    victims = ids.select(*_ENTRY).distinct()
    if policy == "ACKED":
        victims = victims.join(p.select(*_ENTRY), _ENTRY, "left_anti")
    return anti_delete(e, victims, _ENTRY), anti_delete(p, victims, _ENTRY) if policy == "DELREF" else p


def xinfo_stream(e: DataFrame, g: DataFrame) -> DataFrame:
    a = e.groupBy("key").agg(F.count("*").alias("length"), F.min(_id()).alias("first_id"), F.max(_id()).alias("last_id"))
    b = g.groupBy("key").agg(F.count("*").alias("groups"))
    return a.join(b, "key", "left").select("key", "length", "first_id", "last_id", F.coalesce("groups", F.lit(0)).alias("groups"))


def lag(e: DataFrame, g: DataFrame, p: DataFrame) -> DataFrame:
    """XINFO GROUPS: entries behind each group's last delivered id, pending entries and consumers."""
    behind = g.join(e, "key", "left").groupBy("key", "grp").agg(F.count_if(_after(F.col("last_ms"), F.col("last_seq"), True)).alias("lag"))
    held = p.groupBy("key", "grp").agg(F.count("*").alias("pending"), F.countDistinct("consumer").alias("consumers"))
    return behind.join(held, ["key", "grp"], "left").select("key", "grp", "lag", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("consumers", F.lit(0)).alias("consumers"))


def xinfo_consumers(p: DataFrame, now: Column) -> DataFrame:
    return p.groupBy("key", "grp", "consumer").agg(F.count("*").alias("pending"), (F.unix_millis(now) - F.unix_millis(F.max("delivered_at"))).alias("idle"))


def xreadgroup(e: DataFrame, g: DataFrame, p: DataFrame, consumer: str, now: Column, count: int | None = None, noack: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(delivered, g after, p after): new entries for each group go to consumer and become pending."""
    j = e.join(g, "key").filter(_after(F.col("last_ms"), F.col("last_seq"), True))
    r = j.withColumn("pos", F.row_number().over(Window.partitionBy("key", "grp").orderBy("ms", "seq")))
    got = r if count is None else r.filter(F.col("pos") <= count)
    last = got.groupBy("key", "grp").agg(F.max(_id()).alias("last")).select("key", "grp", F.col("last.ms").alias("last_ms"), F.col("last.seq").alias("last_seq"))
    new = got.select("key", "grp", F.lit(consumer).alias("consumer"), "ms", "seq", now.alias("delivered_at"), F.lit(1).cast("long").alias("deliveries"))
    return got.select("key", "grp", "ms", "seq", "fields"), upsert(g, last, ["key", "grp"]), p if noack else p.unionByName(new)


def history(e: DataFrame, p: DataFrame, consumer: str) -> DataFrame:
    """A consumer's own pending entries; deleted ones have null fields."""
    return p.filter(F.col("consumer") == consumer).join(e, _ENTRY, "left").select("key", "grp", "ms", "seq", "fields")


def xack(p: DataFrame, ids: DataFrame) -> DataFrame:
    return anti_delete(p, ids, _PENDING)


def xackdel(e: DataFrame, p: DataFrame, ids: DataFrame, policy: str = "KEEPREF") -> tuple[DataFrame, DataFrame]:
    return xdelex(e, xack(p, ids), ids, policy)


def xpending_summary(p: DataFrame) -> DataFrame:
    return p.groupBy("key", "grp").agg(F.count("*").alias("n"), F.min(_id()).alias("first_id"), F.max(_id()).alias("last_id"))


def xpending_consumers(p: DataFrame) -> DataFrame:
    return p.groupBy("key", "grp", "consumer").agg(F.count("*").alias("n"))


def xpending(p: DataFrame, now: Column, start: str = "-", end: str = "+", count: int | None = None, consumer: str | None = None, min_idle: int = 0) -> DataFrame:
    idle = F.unix_millis(now) - F.unix_millis("delivered_at")
    rows = p.filter(in_range(start, end)).withColumn("idle", idle).filter(F.col("idle") >= min_idle)
    if consumer is not None:
        rows = rows.filter(F.col("consumer") == consumer)
    r = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key", "grp").orderBy("ms", "seq")) - 1)
    return (r if count is None else r.filter(F.col("pos") < count)).drop("pos")


def xclaim(p: DataFrame, ids: DataFrame, consumer: str, min_idle: int, now: Column, just_id: bool = False, force: DataFrame | None = None, retry_count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(claimed, p after): pending entries among ids that idle for min_idle ms pass to consumer. just_id leaves the
    delivery count; force gives existing entries e for which a missing pending entry is made."""
    wanted = ids.select(*_PENDING).distinct()
    held = p.join(wanted, _PENDING, "left_semi").filter(F.unix_millis(now) - F.unix_millis("delivered_at") >= min_idle)
    n = F.lit(retry_count).cast("long") if retry_count is not None else F.col("deliveries") + (0 if just_id else 1)
    claimed = held.select("key", "grp", F.lit(consumer).alias("consumer"), "ms", "seq", now.alias("delivered_at"), n.alias("deliveries"))
    if force is not None:
        made = wanted.join(p, _PENDING, "left_anti").join(force.select(*_ENTRY), _ENTRY, "left_semi")
        claimed = claimed.unionByName(made.select("key", "grp", F.lit(consumer).alias("consumer"), "ms", "seq", now.alias("delivered_at"), F.lit(1).cast("long").alias("deliveries")))
    return claimed, upsert(p, claimed, _PENDING)


def xautoclaim(e: DataFrame, p: DataFrame, consumer: str, min_idle: int, now: Column, start: str = "-", count: int = 100) -> tuple[DataFrame, DataFrame]:
    """The same for a page of pending entries from start on; entries that are gone from the stream leave the pending list."""
    idle = p.filter(in_range(start, "+")).filter(F.unix_millis(now) - F.unix_millis("delivered_at") >= min_idle)
    page = idle.withColumn("pos", F.row_number().over(Window.partitionBy("key", "grp").orderBy("ms", "seq"))).filter(F.col("pos") <= count).drop("pos")
    gone = page.join(e.select(*_ENTRY), _ENTRY, "left_anti")
    return xclaim(xack(p, gone), page.join(e.select(*_ENTRY), _ENTRY, "left_semi"), consumer, min_idle, now)


def group_create(g: DataFrame, new: DataFrame) -> DataFrame:
    """g with new(key, grp, last_ms, last_seq) that aren't there yet."""
    return g.unionByName(new.join(g, ["key", "grp"], "left_anti").select(*g.columns))


def group_destroy(g: DataFrame, p: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    return anti_delete(g, victims, ["key", "grp"]), anti_delete(p, victims, ["key", "grp"])


def group_setid(g: DataFrame, ids: DataFrame) -> DataFrame:
    return upsert(g, ids.join(g, ["key", "grp"], "left_semi").select(*g.columns), ["key", "grp"])


def xsetid(e: DataFrame, new: DataFrame) -> DataFrame:
    """The last id of each stream (key, ms, seq) after new(key, ms, seq): one below the top entry, or without a stream, is refused."""
    top = e.groupBy("key").agg(F.max(_id()).alias("top"))
    j = top.join(new.select("key", _id().alias("asked")), "key", "left")
    last = F.when(F.col("asked") >= F.col("top"), F.col("asked")).otherwise(F.col("top"))
    return j.select("key", last.alias("last")).select("key", F.col("last.ms").alias("ms"), F.col("last.seq").alias("seq"))


def record_producers(seen: DataFrame, most: int) -> DataFrame:
    """XIDMPRECORD: what is remembered of seen(key, producer, iid, at): the newest `most` message ids of each producer."""
    newest = seen.groupBy("key", "producer", "iid").agg(F.max("at").alias("at"))
    w = Window.partitionBy("key", "producer").orderBy(F.col("at").desc(), "iid")
    return newest.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")


def configure(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """XCFGSET: settings(key, ...) after changes, a null leaving what is there; keys without a stream are passed over."""
    rest = [c for c in settings.columns if c != "key"]
    j = settings.alias("s").join(changes.alias("c"), "key", "left")
    return j.select("key", *[F.coalesce(F.col(f"c.{c}"), F.col(f"s.{c}")).alias(c) for c in rest])


def create_consumer(consumers: DataFrame, new: DataFrame) -> DataFrame:
    """consumers(key, grp, consumer) with new ones that aren't there yet."""
    keys = ["key", "grp", "consumer"]
    return consumers.unionByName(new.select(*keys).distinct().join(consumers, keys, "left_anti"))


def del_consumer(p: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending entries each had, p after)."""
    had = victims.join(p, ["key", "grp", "consumer"], "left").groupBy("key", "grp", "consumer").agg(F.count("ms").alias("pending"))
    return had, anti_delete(p, victims, ["key", "grp", "consumer"])
