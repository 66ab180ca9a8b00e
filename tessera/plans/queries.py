"""One query for each operator of the data-structure families and of SQL, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import structs
from tessera.operators import bitmaps, effects, geo, hashes, hll, json_docs, lists, pubsub, sets, sorting, streams, strings, zsets
from tessera.plans import predicates as P
from tessera.plans import transactions
from tessera.plans.fixtures import NOW, Fixtures, sql
from tessera.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Callable[[Fixtures], DataFrame], uses: str = "", body: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(Fixtures(spark, sf_dir))
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if k in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, k in df.dtypes])

    QUERIES[name] = run
    if body is not None:
        ORACLES[name] = sql(uses, body) if uses else body.strip()


BIG = "CAST({} AS BIGINT)"
SEG = ["FURNITURE", "MACHINERY", "BUILDING"]
HIGH, LOW, URGENT = "2-HIGH", "5-LOW", "1-URGENT"
_EPOCH = f"epoch(TIMESTAMP '{NOW}')"
_LIVE = f"(due IS NULL OR due > {_EPOCH})"


def _asked(t: Fixtures) -> DataFrame:
    return t.rows([(i, f"user:{k}") for i, k in enumerate((1, 2, 3, 999_999_999, 3))], "pos long, key string")


_ASKED = "a AS (SELECT * FROM (VALUES (0, 'user:1'), (1, 'user:2'), (2, 'user:3'), (3, 'user:999999999'), (4, 'user:3')) v(pos, key))"

# --- strings, counters, keys, expiry ---------------------------------------------------------------
add("get", lambda t: strings.get(t.kv, t.now), "kv", f"SELECT key, value FROM kv WHERE {_LIVE}")
add("mget", lambda t: strings.mget(t.kv, _asked(t), t.now), "kv", f"WITH {_ASKED} SELECT CAST(a.pos AS BIGINT) AS pos, a.key, kv.value FROM a LEFT JOIN kv ON kv.key = a.key AND {_LIVE}")
add("strlen", lambda t: strings.strlen(t.kv, t.kv.select("key")), "kv", "SELECT key, CAST(strlen(value) AS BIGINT) AS len FROM kv")
add("getrange", lambda t: strings.getrange(t.kv, -6, -2), "kv", "SELECT key, substring(value, length(value) - 5, 5) AS part FROM kv")
add("substr", lambda t: strings.getrange(t.kv, 2, 5), "kv", "SELECT key, substring(value, 3, 4) AS part FROM kv")
add("lcs", lambda t: strings.longest_common(t.t("nation").select(F.col("n_name").alias("a"), F.concat(F.lit("X"), F.substring("n_name", 3, 20)).alias("b"))).select("a", "b", "lcs", "lcs_len"),
    body="SELECT n_name AS a, 'X' || substring(n_name, 3, 20) AS b, substring(n_name, 3, 20) AS lcs, CAST(length(substring(n_name, 3, 20)) AS BIGINT) AS lcs_len FROM nation")
add("digest", lambda t: strings.digest(t.kv))
add("set", lambda t: strings.set_values(t.kv, t.kv.filter("key like '%7'").select("key", F.lit("new").alias("value"))).select("key", "value", F.unix_seconds("expires_at").alias("due")),
    "kv", "SELECT key, CASE WHEN key LIKE '%7' THEN 'new' ELSE value END AS value, CAST(CASE WHEN key NOT LIKE '%7' THEN due END AS BIGINT) AS due FROM kv")
add("set_xx_keepttl", lambda t: strings.set_values(t.kv, t.kv.filter("key like '%7'").select("key", F.lit("new").alias("value")).union(t.rows([("none", "x")], "key string, value string")), "XX", True).select("key", "value", F.unix_seconds("expires_at").alias("due")),
    "kv", "SELECT key, CASE WHEN key LIKE '%7' THEN 'new' ELSE value END AS value, CAST(due AS BIGINT) AS due FROM kv")
add("set_ifeq", lambda t: strings.set_values(t.kv, t.kv.select("key", F.lit("new").alias("value"), F.concat(F.substring("value", 1, 19), F.lit("MACHINERY")).alias("match")), "IFEQ").select("key", "value"),
    "kv", "SELECT key, CASE WHEN value LIKE '%/MACHINERY' THEN 'new' ELSE value END AS value FROM kv")
add("setnx", lambda t: strings.setnx(t.kv, _asked(t).select("key").distinct()), "kv", f"WITH {_ASKED} SELECT DISTINCT a.key, CAST(CASE WHEN kv.key IS NULL THEN 1 ELSE 0 END AS BIGINT) AS created FROM a LEFT JOIN kv USING (key)")
add("setex", lambda t: strings.set_values(t.kv, t.kv.filter("key like '%5'").select("key", "value", F.timestamp_seconds(F.unix_seconds(t.now) + 90).alias("expires_at"))).select("key", F.unix_seconds("expires_at").alias("due")),
    "kv", f"SELECT key, CAST(CASE WHEN key LIKE '%5' THEN {_EPOCH} + 90 ELSE due END AS BIGINT) AS due FROM kv")
add("psetex", lambda t: strings.set_values(t.kv, t.kv.filter("key like '%5'").select("key", "value", F.timestamp_millis(F.unix_millis(t.now) + 1500).alias("expires_at"))).select("key", F.unix_millis("expires_at").alias("at_ms")),
    "kv", f"SELECT key, CAST(CASE WHEN key LIKE '%5' THEN {_EPOCH} * 1000 + 1500 ELSE due * 1000 END AS BIGINT) AS at_ms FROM kv")
add("getset", lambda t: strings.getset(t.kv, _asked(t).select("key").distinct().withColumn("value", F.lit("v"))), "kv", f"WITH {_ASKED} SELECT DISTINCT a.key, kv.value AS old, 'v' AS value FROM a LEFT JOIN kv USING (key)")
add("getdel", lambda t: strings.getdel(t.kv, _asked(t))[1].select("key"), "kv", f"WITH {_ASKED} SELECT key FROM kv WHERE key NOT IN (SELECT key FROM a)")
add("getex", lambda t: strings.getex(t.kv, _asked(t).select("key").distinct().withColumn("expires_at", F.lit(None).cast("timestamp"))).select("key", "value"), "kv", f"WITH {_ASKED} SELECT key, value FROM kv WHERE key IN (SELECT key FROM a)")
add("mset", lambda t: strings.mset(t.kv, t.rows([(1, "user:1", "a"), (2, "user:1", "b"), (3, "new", "c")], "pos long, key string, value string")).select("key", "value"),
    "kv", "SELECT key, CASE WHEN key = 'user:1' THEN 'b' ELSE value END AS value FROM kv UNION ALL SELECT 'new', 'c'")
add("msetnx", lambda t: strings.msetnx(t.kv, t.rows([(1, "user:1", "a"), (2, "fresh", "b")], "pos long, key string, value string")).agg(F.count("*").alias("n")), "kv", "SELECT count(*) AS n FROM kv")
add("msetex_xx", lambda t: strings.msetnx(t.kv, t.rows([(1, "user:1", "a"), (2, "user:2", "b")], "pos long, key string, value string"), "XX").filter("length(value) = 1").select("key", "value"), body="SELECT * FROM (VALUES ('user:1', 'a'), ('user:2', 'b')) v(key, value)")
add("setrange", lambda t: strings.setrange(t.kv, 3, "XYZ"), "kv", "SELECT key, substring(value, 1, 3) || 'XYZ' || substring(value, 7, 1000) AS value FROM kv")
add("append", lambda t: strings.append(t.kv, t.kv.select("key", F.lit("+").alias("part"))), "kv", "SELECT key, value || '+' AS value, CAST(length(value) + 1 AS BIGINT) AS len FROM kv")
_counter = lambda t: t.rows([("click", "10"), ("view", "x")], "key string, value string")
_deltas = lambda t: t.t("events").select(F.col("event_type").alias("key"), F.col("user_id").alias("delta"))
add("incrby", lambda t: strings.incrby(_counter(t), _deltas(t)), body="""SELECT event_type AS key, CAST(CASE event_type WHEN 'view' THEN NULL ELSE sum(user_id) + CASE event_type WHEN 'click' THEN 10 ELSE 0 END END AS BIGINT) AS value,
  CASE event_type WHEN 'view' THEN 'not an integer' END AS error FROM events GROUP BY event_type""")
add("incr", lambda t: strings.incrby(_counter(t), t.t("events").select(F.col("event_type").alias("key"), F.lit(1).alias("delta"))).select("key", "value"), body="SELECT event_type AS key, CAST(CASE event_type WHEN 'view' THEN NULL ELSE count(*) + CASE event_type WHEN 'click' THEN 10 ELSE 0 END END AS BIGINT) AS value FROM events GROUP BY event_type")
add("decrby", lambda t: strings.decrby(_counter(t), _deltas(t)).select("key", "value"), body="SELECT event_type AS key, CAST(CASE event_type WHEN 'view' THEN NULL ELSE -sum(user_id) + CASE event_type WHEN 'click' THEN 10 ELSE 0 END END AS BIGINT) AS value FROM events GROUP BY event_type")
add("decr", lambda t: strings.decrby(_counter(t), t.t("events").select(F.col("event_type").alias("key"), F.lit(1).alias("delta"))).select("key", "value"), body="SELECT event_type AS key, CAST(CASE event_type WHEN 'view' THEN NULL ELSE -count(*) + CASE event_type WHEN 'click' THEN 10 ELSE 0 END END AS BIGINT) AS value FROM events GROUP BY event_type")
add("incrbyfloat", lambda t: strings.incrbyfloat(_counter(t), t.t("events").select(F.col("event_type").alias("key"), F.col("value").alias("delta"))).select("key", F.round("value", 2).alias("value"), "error"),
    body="SELECT event_type AS key, CASE event_type WHEN 'view' THEN NULL ELSE round(sum(value) + CASE event_type WHEN 'click' THEN 10 ELSE 0 END, 2) END AS value, CASE event_type WHEN 'view' THEN 'not a float' END AS error FROM events GROUP BY event_type")
add("del", lambda t: strings.delete(t.kv, _asked(t)).select("key"), "kv", f"WITH {_ASKED} SELECT key FROM kv WHERE key NOT IN (SELECT key FROM a)")
add("unlink", lambda t: strings.delete(t.h, t.rows([("part:1",)], "key string")).select("key", "field"), "h", "SELECT key, field FROM h WHERE key <> 'part:1'")
add("delex", lambda t: strings.delex(t.kv, t.kv.select("key", F.concat(F.substring("value", 1, 19), F.lit("BUILDING")).alias("match")), "IFEQ").select("key"), "kv", "SELECT key FROM kv WHERE value NOT LIKE '%/BUILDING'")
add("exists", lambda t: strings.exists(t.kv, _asked(t)), "kv", f"WITH {_ASKED} SELECT count(*) AS n FROM a WHERE key IN (SELECT key FROM kv)")
_moves = lambda t: t.rows([("user:1", "user:2"), ("user:5", "moved"), ("nothing", "x")], "src string, dst string")
add("rename", lambda t: strings.rename(t.kv, _moves(t)).select("key", "value"), "kv", "SELECT CASE key WHEN 'user:1' THEN 'user:2' WHEN 'user:5' THEN 'moved' ELSE key END AS key, value FROM kv WHERE key <> 'user:2'")
add("renamenx", lambda t: strings.rename(t.kv, _moves(t), only_free=True).select("key", "value"), "kv", "SELECT CASE key WHEN 'user:5' THEN 'moved' ELSE key END AS key, value FROM kv")
add("copy", lambda t: strings.copy(t.kv, _moves(t)).select("key", "value"), "kv", "SELECT key, value FROM kv UNION ALL SELECT 'moved', value FROM kv WHERE key = 'user:5'")
add("copy_replace", lambda t: strings.copy(t.kv, _moves(t), replace=True).select("key", "value"), "kv", "SELECT key, value FROM kv WHERE key <> 'user:2' UNION ALL SELECT 'moved', value FROM kv WHERE key = 'user:5' UNION ALL SELECT 'user:2', value FROM kv WHERE key = 'user:1'")
_catalog = lambda t: strings.catalog(string=t.kv, hash=t.h, list=t.l, set=t.s.select(F.concat(F.lit("s:"), "key").alias("key")), zset=t.z)
add("type", lambda t: strings.type_of(_catalog(t), t.rows([("user:1",), ("part:1",), ("1",), ("s:5-LOW",), ("BUILDING",), ("zzz",)], "key string")), body="SELECT * FROM (VALUES ('user:1', 'string'), ('part:1', 'hash'), ('1', 'list'), ('s:5-LOW', 'set'), ('BUILDING', 'zset'), ('zzz', 'none')) v(key, type)")
add("keys", lambda t: strings.keys(t.kv, "user:?[1-3]*"), "kv", "SELECT key FROM kv WHERE regexp_matches(key, '^user:.[1-3]')")
add("scan", lambda t: strings.scan(t.kv, "user:12", "*5", 40), "kv", "SELECT key FROM (SELECT key FROM kv WHERE key > 'user:12' ORDER BY key LIMIT 40) WHERE key LIKE '%5'")
add("dbsize", lambda t: strings.dbsize(_catalog(t)), "kv h l s z", "SELECT (SELECT count(*) FROM kv) + (SELECT count(DISTINCT key) FROM h) + (SELECT count(DISTINCT key) FROM l) + (SELECT count(DISTINCT key) FROM s) + (SELECT count(DISTINCT key) FROM z) AS n")
add("randomkey", lambda t: strings.randomkey(t.kv, 1).join(t.kv, "key", "left_semi").agg(F.count("*").alias("n")), body="SELECT CAST(1 AS BIGINT) AS n")
add("flushdb", lambda t: strings.flush(t.kv).agg(F.count("*").alias("n")).crossJoin(t.kv.agg(F.count("*").alias("before"))), "kv", "SELECT CAST(0 AS BIGINT) AS n, count(*) AS before FROM kv")
add("flushall", lambda t: strings.catalog(**{n: strings.flush(d) for n, d in (("string", t.kv), ("hash", t.h), ("list", t.l), ("set", t.s), ("zset", t.z))}).agg(F.count("*").alias("n")).crossJoin(strings.dbsize(_catalog(t)).select(F.col("n").alias("before"))), "kv h l s z",
    "SELECT CAST(0 AS BIGINT) AS n, (SELECT count(*) FROM kv) + (SELECT count(DISTINCT key) FROM h) + (SELECT count(DISTINCT key) FROM l) + (SELECT count(DISTINCT key) FROM s) + (SELECT count(DISTINCT key) FROM z) AS before")
add("time", lambda t: t.rows([(1,)], "one int").select(*strings.clock(t.now)), body=f"SELECT CAST({_EPOCH} AS BIGINT) AS seconds, CAST(0 AS BIGINT) AS micros")
add("move", lambda t: strings.refused(t.rows([("MOVE",), ("SWAPDB",)], "command string")), body="SELECT * FROM (VALUES ('MOVE', 'ERR MOVE is not supported: there is one database'), ('SWAPDB', 'ERR SWAPDB is not supported: there is one database')) v(command, error)")
add("memory_usage", lambda t: strings.memory_usage(t.h, "field", "value"), "h", "SELECT key, CAST(sum(strlen(key) + strlen(field) + strlen(value)) AS BIGINT) AS bytes FROM h GROUP BY key")
for _cond, _test in ((None, "true"), ("NX", "due IS NULL"), ("XX", "due IS NOT NULL"), ("GT", "due IS NOT NULL AND na >= due"), ("LT", "due IS NULL OR na <= due")):
    add(f"expire{'_' + _cond.lower() if _cond else ''}", lambda t, c=_cond: strings.expire(t.kv, t.kv.select("key", F.timestamp_seconds(F.unix_seconds(t.now) + (F.length("value") - 26) * 3600).alias("new_at")), t.now, c).select("key", F.unix_seconds("expires_at").alias("due")),
        "kv", f"SELECT key, CAST(CASE WHEN {_test} THEN na ELSE due END AS BIGINT) AS due FROM (SELECT *, {_EPOCH} + (length(value) - 26) * 3600 AS na FROM kv) WHERE NOT (({_test}) AND na < {_EPOCH})")
for _name, _unit in (("expireat", 1), ("pexpire", 1000), ("pexpireat", 1000)):
    add(_name, lambda t, u=_unit: strings.expire(t.kv, t.kv.select("key", F.timestamp_micros((F.unix_seconds(t.now) * u + (F.length("value") - 26) * 3600 * u) * (1_000_000 // u)).alias("new_at")), t.now).select("key", F.unix_millis("expires_at").alias("due")),
        "kv", f"SELECT key, CAST(na * 1000 AS BIGINT) AS due FROM (SELECT *, {_EPOCH} + (length(value) - 26) * 3600 AS na FROM kv) WHERE na >= {_EPOCH}")
add("persist", lambda t: strings.persist(t.kv, _asked(t)).select("key", F.unix_seconds("expires_at").alias("due")), "kv", f"WITH {_ASKED} SELECT key, CAST(CASE WHEN key NOT IN (SELECT key FROM a) THEN due END AS BIGINT) AS due FROM kv")
for _name, _unit, _abs, _expr in (("ttl", "s", False, f"due - {_EPOCH}"), ("pttl", "ms", False, f"(due - {_EPOCH}) * 1000"), ("expiretime", "s", True, "due"), ("pexpiretime", "ms", True, "due * 1000")):
    add(_name, lambda t, u=_unit, a=_abs: strings.ttl(t.kv, t.kv.select("key").union(t.rows([("none",)], "key string")), t.now, u, a), "kv", f"SELECT key, CAST(coalesce({_expr}, -1) AS BIGINT) AS ttl FROM kv UNION ALL SELECT 'none', -2")

# --- hashes ------------------------------------------------------------------------------------------
add("hget", lambda t: hashes.hget(t.h, "brand"), "h", "SELECT key, value FROM h WHERE field = 'brand'")
add("hmget", lambda t: hashes.hmget(t.h, ["size", "brand"]).select("key", F.concat_ws("|", "values").alias("v")), "h", "SELECT a.key, a.value || '|' || b.value AS v FROM h a JOIN h b USING (key) WHERE a.field = 'size' AND b.field = 'brand'")
_hw = lambda t: t.t("part").select(F.lit(1).alias("pos"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.explode(F.array(F.lit("size"), F.lit("colour"))).alias("field"), F.lit("9").alias("value"))
add("hset", lambda t: hashes.hset(t.h, _hw(t)), "h", "SELECT key, field, CASE field WHEN 'size' THEN '9' ELSE value END AS value FROM h UNION ALL SELECT DISTINCT key, 'colour', '9' FROM h")
add("hset_created", lambda t: hashes.created(t.h, _hw(t)), "h", "SELECT DISTINCT key, CAST(1 AS BIGINT) AS created FROM h")
add("hsetnx", lambda t: hashes.hset(t.h, _hw(t), only_new=True), "h", "SELECT key, field, value FROM h UNION ALL SELECT DISTINCT key, 'colour', '9' FROM h")
add("hdel", lambda t: hashes.hdel(t.h, _hw(t)), "h", "SELECT key, field, value FROM h WHERE field <> 'size'")
add("hexists", lambda t: hashes.hexists(t.h, _hw(t).select("key", "field")), "h", "SELECT DISTINCT key, f.field, CAST(CASE f.field WHEN 'size' THEN 1 ELSE 0 END AS BIGINT) AS there FROM h, (VALUES ('size'), ('colour')) f(field)")
add("hgetall", lambda t: hashes.hgetall(t.h).select("key", F.concat_ws("|", F.transform(F.map_entries("fields"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))).alias("v")), "h", "SELECT key, string_agg(field || '=' || value, '|' ORDER BY field) AS v FROM h GROUP BY key")
add("hkeys", lambda t: hashes.hkeys(t.h).select("key", F.concat_ws("|", "fields").alias("v")), "h", "SELECT key, string_agg(field, '|' ORDER BY field) AS v FROM h GROUP BY key")
add("hvals", lambda t: hashes.hvals(t.h).select("key", F.concat_ws("|", "values").alias("v")), "h", "SELECT key, string_agg(value, '|' ORDER BY field) AS v FROM h GROUP BY key")
add("hlen", lambda t: hashes.hlen(t.h), "h", "SELECT key, count(*) AS n FROM h GROUP BY key")
add("hstrlen", lambda t: hashes.hstrlen(t.h, "name"), "h", "SELECT key, CAST(strlen(value) AS BIGINT) AS len FROM h WHERE field = 'name'")
add("hincrby", lambda t: hashes.hincrby(t.h, t.h.filter("field in ('size', 'brand')").select("key", "field", F.lit(5).alias("delta"))), "h", "SELECT key, field, CAST(CASE field WHEN 'size' THEN CAST(CASE field WHEN 'size' THEN value END AS BIGINT) + 5 END AS BIGINT) AS value, CASE field WHEN 'brand' THEN 'not a number' END AS error FROM h WHERE field IN ('size', 'brand')")
add("hincrbyfloat", lambda t: hashes.hincrby(t.h, t.h.filter("field = 'size'").select("key", "field", F.lit(0.5).alias("delta")), "double").select("key", "value"), "h", "SELECT key, CAST(value AS DOUBLE) + 0.5 AS value FROM h WHERE field = 'size'")
add("hrandfield", lambda t: hashes.hrandfield(t.h, 2, 1).join(t.h.select("key", "field"), ["key", "field"], "left_semi").groupBy("key").agg(F.countDistinct("field").alias("n")), "h", "SELECT DISTINCT key, CAST(2 AS BIGINT) AS n FROM h")
add("hscan", lambda t: hashes.hscan(t.h, "brand", "n*", 1), "h", "SELECT key, field, value FROM h WHERE field = 'name'")
add("hgetdel", lambda t: hashes.hgetdel(t.h, t.h.filter("field = 'size'"))[0], "h", "SELECT key, field, value FROM h WHERE field = 'size'")
_hx = lambda t: t.h.withColumn("field_expires_at", F.when(F.col("field") == "size", F.timestamp_seconds(F.unix_seconds(t.now) + 60)))
_hask = lambda t, s: t.h.filter("field in ('size', 'brand')").select("key", "field").union(t.rows([("part:1", "nope")], "key string, field string")).withColumn("new_at", F.timestamp_seconds(F.unix_seconds(t.now) + s))
for _name, _secs, _cond, _size, _brand in (("hexpire", 30, None, 1, 1), ("hpexpire_nx", 30, "NX", 0, 1), ("hexpireat_gt", 30, "GT", 0, 1), ("hpexpireat_lt", 30, "LT", 1, 1), ("hexpire_due", 0, "XX", 2, 0)):
    add(_name, lambda t, s=_secs, c=_cond: hashes.hexpire(_hx(t), _hask(t, s), t.now, c)[0], "h", f"SELECT key, field, CAST(CASE field WHEN 'size' THEN {_size} ELSE {_brand} END AS BIGINT) AS code FROM h WHERE field IN ('size', 'brand') UNION ALL SELECT 'part:1', 'nope', -2")
for _name, _unit, _abs, _value in (("httl", "s", False, "60"), ("hpttl", "ms", False, "60000"), ("hexpiretime", "s", True, f"{_EPOCH} + 60"), ("hpexpiretime", "ms", True, f"({_EPOCH} + 60) * 1000")):
    add(_name, lambda t, u=_unit, a=_abs: hashes.httl(_hx(t), _hask(t, 0).drop("new_at"), t.now, u, a), "h", f"SELECT key, field, CAST(CASE field WHEN 'size' THEN {_value} ELSE -1 END AS BIGINT) AS ttl FROM h WHERE field IN ('size', 'brand') UNION ALL SELECT 'part:1', 'nope', -2")
add("hpersist", lambda t: hashes.hpersist(_hx(t), _hask(t, 0).drop("new_at"))[0], "h", "SELECT key, field, CAST(CASE field WHEN 'size' THEN 1 ELSE -1 END AS BIGINT) AS code FROM h WHERE field IN ('size', 'brand') UNION ALL SELECT 'part:1', 'nope', -2")
add("hsetex_fxx", lambda t: hashes.hsetex(_hx(t), _hw(t).filter("field = 'size' or key like '%1'").withColumn("field_expires_at", t.now), "FXX").select("key", "field", "value"), "h", "SELECT key, field, CASE WHEN field = 'size' AND key NOT LIKE '%1' THEN '9' ELSE value END AS value FROM h")
add("hgetex", lambda t: hashes.hgetex(_hx(t), _hask(t, 0))[0], "h", "SELECT key, field, value FROM h WHERE field IN ('size', 'brand')")

# --- lists -------------------------------------------------------------------------------------------
_I = "i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l)"
_new = lambda t: t.l.select("key").distinct().withColumn("x", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("a").alias("value")), F.struct(F.lit(2).alias("ord"), F.lit("b").alias("value"))))).select("key", "x.*")
_show = lambda df: lists.indexed(df).select("key", "pos", "value")
add("rpush", lambda t: _show(lists.push(t.l, _new(t))), "l", f"WITH {_I} SELECT key, CAST(pos AS BIGINT) AS pos, value FROM i UNION ALL SELECT key, n, 'a' FROM i WHERE pos = 0 UNION ALL SELECT key, n + 1, 'b' FROM i WHERE pos = 0")
add("lpush", lambda t: _show(lists.push(t.l, _new(t), left=True)), "l", f"WITH {_I} SELECT key, CAST(pos + 2 AS BIGINT) AS pos, value FROM i UNION ALL SELECT key, 1, 'a' FROM i WHERE pos = 0 UNION ALL SELECT key, 0, 'b' FROM i WHERE pos = 0")
add("rpushx", lambda t: lists.llen(lists.push(t.l, t.rows([("1", 1, "x"), ("zz", 1, "x")], "key string, ord int, value string"), only_existing=True)), "l", "SELECT key, count(*) + CASE key WHEN '1' THEN 1 ELSE 0 END AS n FROM l GROUP BY key")
add("lpushx", lambda t: lists.lindex(lists.push(t.l, t.rows([("1", 1, "x"), ("zz", 1, "x")], "key string, ord int, value string"), True, True), 0), "l", f"WITH {_I} SELECT key, CASE key WHEN '1' THEN 'x' ELSE value END AS value FROM i WHERE pos = 0")
add("lpop", lambda t: lists.pop(t.l, 2)[0], "l", f"WITH {_I} SELECT key, CAST(pos + 1 AS BIGINT) AS ord, value FROM i WHERE pos < 2")
add("rpop", lambda t: lists.pop(t.l, 2, left=False)[0], "l", f"WITH {_I} SELECT key, CAST(n - pos AS BIGINT) AS ord, value FROM i WHERE pos >= n - 2")
add("lmpop", lambda t: lists.mpop(t.l, t.rows([("r1", 1, "zz"), ("r1", 2, "3"), ("r1", 3, "4"), ("r2", 1, "5")], "req string, ord int, key string")), "l", f"WITH {_I} SELECT CASE key WHEN '3' THEN 'r1' ELSE 'r2' END AS req, key, CAST(1 AS BIGINT) AS ord, value FROM i WHERE key IN ('3', '5') AND pos = 0")
add("llen", lambda t: lists.llen(t.l), "l", "SELECT key, count(*) AS n FROM l GROUP BY key")
add("lrange", lambda t: lists.lrange(t.l, 1, -2), "l", f"WITH {_I} SELECT key, CAST(pos AS BIGINT) AS pos, value FROM i WHERE pos BETWEEN 1 AND n - 2")
add("lindex", lambda t: lists.lindex(t.l, -2), "l", f"WITH {_I} SELECT key, value FROM i WHERE pos = n - 2")
add("lset", lambda t: _show(lists.lset(t.l, -1, "last")), "l", f"WITH {_I} SELECT key, CAST(pos AS BIGINT) AS pos, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM i")
add("lrem", lambda t: lists.lrem(t.l, -1, "user0"), "l", "SELECT key, seq, value FROM (SELECT *, max(CASE WHEN value = 'user0' THEN seq END) OVER (PARTITION BY key) AS x FROM l) WHERE x IS NULL OR seq <> x")
add("ltrim", lambda t: lists.ltrim(t.l, -3, -2), "l", f"WITH {_I} SELECT key, seq, value FROM i WHERE pos BETWEEN n - 3 AND n - 2")
add("linsert", lambda t: _show(lists.linsert(t.l, "assistant1", "new")), "l", f"WITH {_I}, p AS (SELECT key, min(pos) AS due FROM i WHERE value = 'assistant1' GROUP BY key) SELECT i.key, CAST(pos + CASE WHEN pos >= due THEN 1 ELSE 0 END AS BIGINT) AS pos, value FROM i LEFT JOIN p USING (key) UNION ALL SELECT key, due, 'new' FROM p")
add("lpos", lambda t: lists.lpos(t.l, "user0", -1, 2), "l", f"WITH {_I} SELECT key, nth, CAST(pos AS BIGINT) AS pos FROM (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS nth FROM i WHERE value = 'user0') WHERE nth <= 2")
add("lmove", lambda t: _show(lists.lmove(t.l, t.rows([("1", "2")], "src string, dst string"), True, False)), "l", f"WITH {_I} SELECT key, CAST(pos - CASE key WHEN '1' THEN 1 ELSE 0 END AS BIGINT) AS pos, value FROM i WHERE NOT (key = '1' AND pos = 0) UNION ALL SELECT '2', (SELECT count(*) FROM l WHERE key = '2'), value FROM i WHERE key = '1' AND pos = 0")
add("rpoplpush", lambda t: _show(lists.rpoplpush(t.l, t.rows([("1", "1")], "src string, dst string"))), "l", f"WITH {_I} SELECT key, CAST(CASE key WHEN '1' THEN (pos + 1) % n ELSE pos END AS BIGINT) AS pos, value FROM i")

# --- sets --------------------------------------------------------------------------------------------
_IN = lambda k: f"SELECT member FROM s WHERE key = '{k}'"
add("scard", lambda t: sets.scard(t.s), "s", "SELECT key, count(*) AS n FROM s GROUP BY key")
add("sadd", lambda t: sets.scard(sets.sadd(t.s, t.rows([("5-LOW", "x"), ("5-LOW", "x"), ("new", "y")], "key string, member string"))), "s", "SELECT key, count(*) + CASE key WHEN '5-LOW' THEN 1 ELSE 0 END AS n FROM s GROUP BY key UNION ALL SELECT 'new', 1")
add("srem", lambda t: sets.srem(t.s, t.s.filter("member like '%3'")), "s", "SELECT key, member FROM s WHERE member NOT LIKE '%3'")
add("sismember", lambda t: sets.smismember(t.s, t.rows([("5-LOW", "7")], "key string, member string")), "s", f"SELECT '5-LOW' AS key, '7' AS member, CAST((SELECT count(*) FROM ({_IN(LOW)}) WHERE member = '7') AS BIGINT) AS hit")
add("smismember", lambda t: sets.smismember(t.s, t.s.select("key").distinct().withColumn("member", F.explode(F.array(F.lit("7"), F.lit("nope"))))), "s", "SELECT k.key, v.member, CAST(CASE WHEN s.member IS NULL THEN 0 ELSE 1 END AS BIGINT) AS hit FROM (SELECT DISTINCT key FROM s) k CROSS JOIN (VALUES ('7'), ('nope')) v(member) LEFT JOIN s ON s.key = k.key AND s.member = v.member")
add("smembers", lambda t: sets.smembers(t.s).select("key", F.concat_ws(",", "members").alias("members")), "s", "SELECT key, string_agg(member, ',' ORDER BY member) AS members FROM s GROUP BY key")
add("srandmember", lambda t: sets.srandmember(t.s, 7, 1).join(t.s, ["key", "member"], "left_semi").groupBy("key").agg(F.countDistinct("member").alias("n")), "s", "SELECT DISTINCT key, CAST(7 AS BIGINT) AS n FROM s")
add("spop", lambda t: sets.scard(sets.spop(t.s, 4, 1)[1].join(t.s, ["key", "member"], "left_semi")), "s", "SELECT key, count(*) - 4 AS n FROM s GROUP BY key")
add("spop_all", lambda t: (lambda popped: popped[0].select("key", "member").union(popped[1].select("key", "member")))(sets.spop(t.s, 4, 1)), "s", "SELECT key, member FROM s")
add("smove", lambda t: sets.smove(t.s, t.s.filter("key = '5-LOW' and member like '1%'").select(F.col("key").alias("src"), F.lit("low").alias("dst"), "member")), "s", "SELECT CASE WHEN key = '5-LOW' AND member LIKE '1%' THEN 'low' ELSE key END AS key, member FROM s")
add("sinter", lambda t: sets.sinter(t.s, [HIGH, LOW, URGENT]), "s", f"{_IN(HIGH)} INTERSECT {_IN(LOW)} INTERSECT {_IN(URGENT)}")
add("sintercard", lambda t: sets.sintercard(t.s, [HIGH, LOW], 10), "s", f"SELECT least(count(*), 10) AS n FROM ({_IN(HIGH)} INTERSECT {_IN(LOW)})")
add("sunion", lambda t: sets.sunion(t.s, [HIGH, LOW]), "s", f"{_IN(HIGH)} UNION {_IN(LOW)}")
add("sdiff", lambda t: sets.sdiff(t.s, [HIGH, LOW, URGENT]), "s", f"{_IN(HIGH)} EXCEPT {_IN(LOW)} EXCEPT {_IN(URGENT)}")
for _name, _fn, _op in (("sinterstore", sets.sinter, "INTERSECT"), ("sunionstore", sets.sunion, "UNION"), ("sdiffstore", sets.sdiff, "EXCEPT")):
    add(_name, lambda t, f=_fn: sets.scard(sets.store(t.s, URGENT, f(t.s, [HIGH, LOW]))), "s", f"SELECT key, count(*) AS n FROM s WHERE key <> '{URGENT}' GROUP BY key UNION ALL SELECT '{URGENT}', count(*) FROM ({_IN(HIGH)} {_op} {_IN(LOW)})")

# --- sorted sets -------------------------------------------------------------------------------------
_R = "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev, count(*) OVER (PARTITION BY key) AS n FROM z)"
_W = {HIGH: 2.0, LOW: 1.0, URGENT: 0.5}
_WSQL = "w AS (SELECT key, member, score * CASE key WHEN '2-HIGH' THEN 2.0 WHEN '5-LOW' THEN 1.0 ELSE 0.5 END AS score FROM zo WHERE key IN ('2-HIGH', '5-LOW', '1-URGENT'))"
add("zscore", lambda t: zsets.zscore(t.z, "Customer#000000007"), "z", "SELECT key, score FROM z WHERE member = 'Customer#000000007'")
add("zmscore", lambda t: zsets.zmscore(t.z, t.z.select("key").distinct().withColumn("member", F.lit("Customer#000000007"))), "z", "SELECT k.key, 'Customer#000000007' AS member, z.score FROM (SELECT DISTINCT key FROM z) k LEFT JOIN z ON z.key = k.key AND z.member = 'Customer#000000007'")
add("zcard", lambda t: zsets.zcard(t.z), "z", "SELECT key, count(*) AS n FROM z GROUP BY key")
add("zrank", lambda t: zsets.ranked(t.z).select("key", "member", "rank", "score"), "z", f"WITH {_R} SELECT key, member, CAST(rank AS BIGINT) AS rank, score FROM r")
add("zrevrank", lambda t: zsets.ranked(t.z, rev=True).select("key", "member", "rank", "score"), "z", f"WITH {_R} SELECT key, member, CAST(rev AS BIGINT) AS rank, score FROM r")
add("zrange", lambda t: zsets.zrange(t.z, 5, -5), "z", f"WITH {_R} SELECT key, CAST(rank AS BIGINT) AS rank, member, score FROM r WHERE rank BETWEEN 5 AND n - 5")
add("zrevrange", lambda t: zsets.zrange(t.z, 0, 9, rev=True), "z", f"WITH {_R} SELECT key, CAST(rev AS BIGINT) AS rank, member, score FROM r WHERE rev <= 9")
_PAGE = "SELECT key, CAST(p AS BIGINT) AS pos, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {}) - 1 AS p FROM z WHERE {})"
add("zrangebyscore", lambda t: zsets.zrangebyscore(t.z, "(100", "5000", limit=(3, 20)), "z", _PAGE.format("score, member", "score > 100 AND score <= 5000") + " WHERE p BETWEEN 3 AND 22")
add("zrevrangebyscore", lambda t: zsets.zrangebyscore(t.z, "-inf", "(5000", rev=True, limit=(0, 10)), "z", _PAGE.format("score DESC, member DESC", "score < 5000") + " WHERE p < 10")
add("zrangebylex", lambda t: zsets.zrangebylex(t.z, "[Customer#000000100", "(Customer#000000200"), "z", _PAGE.format("score, member", "member >= 'Customer#000000100' AND member < 'Customer#000000200'"))
add("zrevrangebylex", lambda t: zsets.zrangebylex(t.z, "(Customer#000000100", "+", rev=True, limit=(1, 5)), "z", _PAGE.format("score DESC, member DESC", "member > 'Customer#000000100'") + " WHERE p BETWEEN 1 AND 5")
add("zcount", lambda t: zsets.zcount(t.z, "(0", "+inf"), "z", "SELECT key, CAST(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM z GROUP BY key")
add("zlexcount", lambda t: zsets.zlexcount(t.z, "-", "[Customer#000000500"), "z", "SELECT key, CAST(sum(CASE WHEN member <= 'Customer#000000500' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM z GROUP BY key")
add("zrandmember", lambda t: zsets.zrandmember(t.z, 3, 1).join(t.z.select("key", "member"), ["key", "member"], "left_semi").groupBy("key").agg(F.countDistinct("member").alias("n")), "z", "SELECT DISTINCT key, CAST(3 AS BIGINT) AS n FROM z")
for _agg in ("sum", "min", "max"):
    add(f"zunion_{_agg}", lambda t, a=_agg: zsets.zunion(t.zo, _W, a), "zo", f"WITH {_WSQL} SELECT member, {_agg}(score) AS score FROM w GROUP BY member")
    add(f"zinter_{_agg}", lambda t, a=_agg: zsets.zinter(t.zo, _W, a), "zo", f"WITH {_WSQL} SELECT member, {_agg}(score) AS score FROM w GROUP BY member HAVING count(*) = 3")
add("zintercard", lambda t: zsets.zintercard(t.zo, [HIGH, LOW], 12), "zo", "SELECT least(count(*), 12) AS n FROM (SELECT member FROM zo WHERE key = '2-HIGH' INTERSECT SELECT member FROM zo WHERE key = '5-LOW')")
add("zdiff", lambda t: zsets.zdiff(t.zo, [HIGH, LOW]), "zo", "SELECT member, score FROM zo WHERE key = '2-HIGH' AND member NOT IN (SELECT member FROM zo WHERE key = '5-LOW')")
add("zunionstore", lambda t: zsets.zcard(zsets.store(t.zo, "out", zsets.zunion(t.zo, _W))), "zo", "SELECT key, count(*) AS n FROM zo GROUP BY key UNION ALL SELECT 'out', count(DISTINCT member) FROM zo WHERE key IN ('2-HIGH', '5-LOW', '1-URGENT')")
add("zinterstore", lambda t: zsets.store(t.zo, "out", zsets.zinter(t.zo, _W)).filter("key = 'out'"), "zo", f"WITH {_WSQL} SELECT 'out' AS key, member, sum(score) AS score FROM w GROUP BY member HAVING count(*) = 3")
add("zdiffstore", lambda t: zsets.store(t.zo, "out", zsets.zdiff(t.zo, [HIGH, LOW])).filter("key = 'out'"), "zo", "SELECT 'out' AS key, member, score FROM zo WHERE key = '2-HIGH' AND member NOT IN (SELECT member FROM zo WHERE key = '5-LOW')")
add("zrangestore", lambda t: zsets.store(t.z, "out", zsets.zrange(t.z.filter("key = 'BUILDING'"), 0, 4)).filter("key = 'out'"), "z", f"WITH {_R} SELECT 'out' AS key, member, score FROM r WHERE key = 'BUILDING' AND rank <= 4")
_zw = lambda t: t.z.select(F.lit(1).alias("pos"), "key", "member", F.lit(1000.0).alias("score")).union(t.rows([(1, "BUILDING", "new", 1.0)], "pos int, key string, member string, score double"))
_NEWROW = " UNION ALL SELECT 'BUILDING', 'new', 1.0"
for _name, _c, _cmp, _e, _tail in (("zadd", None, None, "1000.0", _NEWROW), ("zadd_nx", "NX", None, "score", _NEWROW), ("zadd_xx", "XX", None, "1000.0", ""), ("zadd_gt", None, "GT", "greatest(score, 1000.0)", _NEWROW), ("zadd_lt", None, "LT", "least(score, 1000.0)", _NEWROW)):
    add(_name, lambda t, c=_c, m=_cmp: zsets.zadd(t.z, _zw(t), c, m), "z", f"SELECT key, member, CAST({_e} AS DOUBLE) AS score FROM z{_tail}")
add("zadd_ch", lambda t: zsets.changed(t.z, zsets.zadd(t.z, _zw(t), None, "GT")), "z", "SELECT key, CAST(sum(CASE WHEN score < 1000 THEN 1 ELSE 0 END) + CASE key WHEN 'BUILDING' THEN 1 ELSE 0 END AS BIGINT) AS changed FROM z GROUP BY key")
add("zincrby", lambda t: zsets.zincrby(t.z, t.z.filter("score < 0").select("key", "member", F.lit(0.5).alias("delta"))), "z", "SELECT key, member, CASE WHEN score < 0 THEN score + 0.5 ELSE score END AS score FROM z")
add("zrem", lambda t: zsets.zrem(t.z, t.z.filter("score < 0")), "z", "SELECT key, member, score FROM z WHERE score >= 0")
add("zpopmin", lambda t: zsets.zpop(t.z, 3)[0], "z", f"WITH {_R} SELECT key, member, score, CAST(rank + 1 AS BIGINT) AS ord FROM r WHERE rank < 3")
add("zpopmax", lambda t: zsets.zpop(t.z, 3, highest=True)[1], "z", f"WITH {_R} SELECT key, member, score FROM r WHERE rev >= 3")
add("zmpop", lambda t: zsets.zmpop(t.z, t.rows([("r", 1, "none"), ("r", 2, "BUILDING"), ("r", 3, "FURNITURE")], "req string, ord int, key string"), 2), "z", f"WITH {_R} SELECT 'r' AS req, key, CAST(rank + 1 AS BIGINT) AS ord, member, score FROM r WHERE key = 'BUILDING' AND rank < 2")
add("zremrangebyrank", lambda t: zsets.zremrangebyrank(t.z, 2, -3), "z", f"WITH {_R} SELECT key, member, score FROM r WHERE NOT rank BETWEEN 2 AND n - 3")
add("zremrangebyscore", lambda t: zsets.zremrangebyscore(t.z, "0", "(5000"), "z", "SELECT key, member, score FROM z WHERE NOT (score >= 0 AND score < 5000)")
add("zremrangebylex", lambda t: zsets.zremrangebylex(t.z, "-", "(Customer#000000900"), "z", "SELECT key, member, score FROM z WHERE member >= 'Customer#000000900'")

# --- geo ---------------------------------------------------------------------------------------------
_R_ = "6372797.560856"
_cell = lambda v, lo, hi: f"(least(floor(({v} - ({lo})) / ({hi} - ({lo})) * 67108864), 67108863) + 0.5) / 67108864 * ({hi} - ({lo})) + ({lo})"
_GP = f"p AS (SELECT key, member, {_cell('lon', -180.0, 180.0)} AS lon, {_cell('lat', -geo.LAT_MAX, geo.LAT_MAX)} AS lat FROM g)"
_hav = lambda a, b, c, d: f"(2 * {_R_} * asin(sqrt(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({c}) - radians({a})) / 2), 2))))"
_g = lambda t: geo.geoadd(t.points)
add("geoadd", lambda t: _g(t).groupBy("key").agg(F.count("*").alias("n")), "g", "SELECT key, count(*) AS n FROM g WHERE abs(lat) <= 85.05112878 GROUP BY key")
add("geopos", lambda t: geo.geopos(_g(t)).select("key", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), "g", f"WITH {_GP} SELECT key, member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
add("geohash", lambda t: geo.geohash(_g(t)))
_gpairs = lambda t: t.points.groupBy("key").agg(F.min("member").alias("a"), F.max("member").alias("b"))
add("geodist", lambda t: geo.geodist(_g(t), _gpairs(t), "km").withColumn("dist", F.round("dist", 3)), "g", f"WITH {_GP}, x AS (SELECT key, min(member) AS a, max(member) AS b FROM g GROUP BY key) SELECT x.key, x.a, x.b, round({_hav('p.lon', 'p.lat', 'q.lon', 'q.lat')} / 1000, 3) AS dist FROM x JOIN p ON p.key = x.key AND p.member = x.a JOIN p q ON q.key = x.key AND q.member = x.b")
_near = f"SELECT key, member, {_hav('10', '20', 'lon', 'lat')} AS dist FROM p"
add("geosearch", lambda t: geo.geosearch(_g(t), 10.0, 20.0, radius=3000, unit="km", count=5).select("key", "member", F.round("dist", 3).alias("dist"), "pos"), "g", f"WITH {_GP} SELECT key, member, round(dist / 1000, 3) AS dist, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, member) - 1 AS pos FROM ({_near}) WHERE dist <= 3000000) WHERE pos < 5")
add("geosearch_box", lambda t: geo.geosearch(_g(t), 10.0, 20.0, box=(6000, 2000), unit="km").select("key", "member"), "g", f"WITH {_GP} SELECT key, member FROM p WHERE {_hav('lon', '20', 'lon', 'lat')} <= 1000000 AND {_hav('10', 'lat', 'lon', 'lat')} <= 3000000")
add("georadius", lambda t: geo.geosearch(_g(t), 10.0, 20.0, radius=2000, unit="mi", desc=True).select("key", "member", "pos"), "g", f"WITH {_GP} SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY dist DESC, member) - 1 AS pos FROM ({_near}) WHERE dist <= 2000 * 1609.34")
add("georadiusbymember", lambda t: geo.geosearch_around_members(_g(t), t.points.groupBy("key").agg(F.min("member").alias("centre")), 2500, "km").select("key", "centre", "member", F.round("dist", 3).alias("dist")),
    "g", f"WITH {_GP}, c AS (SELECT key, min(member) AS centre FROM g GROUP BY key), x AS (SELECT p.key, centre, q.member, {_hav('p.lon', 'p.lat', 'q.lon', 'q.lat')} AS dist FROM c JOIN p ON p.key = c.key AND p.member = centre JOIN p q ON q.key = c.key) SELECT key, centre, member, round(dist / 1000, 3) AS dist FROM x WHERE dist <= 2500000")
add("geosearchstore", lambda t: geo.geosearchstore(geo.geosearch(_g(t), 10.0, 20.0, radius=3000, unit="km"), "out", True).withColumn("score", F.round("score", 3)), "g", f"WITH {_GP} SELECT 'out' AS key, member, round(dist / 1000, 3) AS score FROM ({_near}) WHERE dist <= 3000000")

# --- sketches ----------------------------------------------------------------------------------------
_el = lambda t: t.t("lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").cast("string").alias("element"))
_ok = lambda n, exact: (F.abs(n - exact) <= 0.03 * exact + 2).alias("close")
_exact = lambda t: _el(t).groupBy("key").agg(F.countDistinct("element").alias("exact"))
_CLOSE = "SELECT DISTINCT l_returnflag AS key, true AS close FROM lineitem"
add("pfadd", lambda t: hll.changed(hll.pfadd(_el(t).limit(0)), hll.pfadd(_el(t))), body="SELECT DISTINCT l_returnflag AS key, CAST(1 AS BIGINT) AS changed FROM lineitem")
add("pfcount", lambda t: hll.pfcount(hll.pfadd(_el(t))).join(_exact(t), "key").select("key", _ok(F.col("n"), F.col("exact"))), body=_CLOSE)
add("pfcount_sketch", lambda t: hll.sketch_count(hll.sketch(_el(t))).join(_exact(t), "key").select("key", _ok(F.col("n"), F.col("exact"))), body=_CLOSE)
add("pfmerge", lambda t: hll.pfcount_union(hll.pfadd(_el(t)), ["A", "N", "R"]).crossJoin(_el(t).agg(F.countDistinct("element").alias("exact"))).select(_ok(F.col("n"), F.col("exact"))), body="SELECT true AS close")
add("pfdebug", lambda t: hll.decode(hll.pfadd(_el(t))).groupBy("key").agg(F.count("*").alias("registers")), body="SELECT DISTINCT l_returnflag AS key, CAST(16384 AS BIGINT) AS registers FROM lineitem")

# --- bitmaps -----------------------------------------------------------------------------------------
add("getbit", lambda t: bitmaps.getbit(t.b, 77), "b", 'SELECT key, CAST(max(CASE WHEN "offset" = 77 THEN 1 ELSE 0 END) AS BIGINT) AS bit FROM b GROUP BY key')
add("setbit", lambda t: bitmaps.setbit(t.b, t.b.select(F.lit(1).alias("pos"), "key", "offset", (F.col("offset") % 2).alias("bit"))), "b", 'SELECT key, "offset" FROM b WHERE "offset" % 2 = 1')
add("bitcount", lambda t: bitmaps.bitcount(t.b), "b", "SELECT key, count(*) AS n FROM b GROUP BY key")
add("bitcount_range", lambda t: bitmaps.bitcount(t.b, 2, 9), "b", 'SELECT key, CAST(sum(CASE WHEN "offset" BETWEEN 16 AND 79 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM b GROUP BY key')
add("bitcount_dense", lambda t: bitmaps.bitcount_dense(t.b), "b", "SELECT key, count(*) AS n FROM b GROUP BY key")
add("bitpos", lambda t: bitmaps.bitpos(t.b, 1, 3), "b", 'SELECT key, coalesce(min(CASE WHEN "offset" >= 24 THEN "offset" END), -1) AS pos FROM b GROUP BY key')
add("bitpos_clear", lambda t: bitmaps.bitpos(t.b, 0), "b", 'SELECT k.key, min(x.i) AS pos FROM (SELECT DISTINCT key FROM b) k CROSS JOIN (SELECT unnest(range(0, 100000)) AS i) x LEFT JOIN b ON b.key = k.key AND b."offset" = x.i WHERE b.key IS NULL GROUP BY k.key')
_OFF = "x AS (SELECT \"offset\", sum(CASE WHEN key = 'click' THEN 1 ELSE 0 END) AS x, sum(CASE WHEN key <> 'click' THEN 1 ELSE 0 END) AS y FROM b WHERE key IN ('click', 'view', 'error') AND (\"offset\" % 3 > 0 OR key = 'view') GROUP BY \"offset\")"
_some = lambda t: t.b.filter("offset % 3 > 0 or key = 'view'")
for _op, _test in (("AND", "x + y = 3"), ("OR", "true"), ("XOR", "(x + y) % 2 = 1"), ("ONE", "x + y = 1"), ("DIFF", "x = 1 AND y = 0"), ("DIFF1", "x = 0 AND y > 0"), ("ANDOR", "x = 1 AND y > 0")):
    add(f"bitop_{_op.lower()}", lambda t, o=_op: bitmaps.bitop(_some(t), o, ["click", "view", "error"]), "b", f'WITH {_OFF} SELECT "offset" FROM x WHERE {_test}')
add("bitop_not", lambda t: bitmaps.bitop(_some(t), "NOT", ["click"]), "b", "WITH c AS (SELECT \"offset\" FROM b WHERE key = 'click' AND \"offset\" % 3 > 0) SELECT i AS \"offset\" FROM (SELECT unnest(range(0, (max(\"offset\") // 8 + 1) * 8)) AS i FROM c) WHERE i NOT IN (SELECT \"offset\" FROM c)")
_FIELD = 'CAST(coalesce(sum(CASE WHEN "offset" BETWEEN 16 AND 23 AND "offset" % 3 > 0 THEN CAST(1 AS BIGINT) << CAST(23 - "offset" AS INTEGER) END), 0) AS BIGINT)'
_thin = lambda t: t.b.filter("offset % 3 > 0")
add("bitfield_ro", lambda t: bitmaps.bitfield_get(_thin(t), 8, 16, False), "b", f"SELECT key, {_FIELD} AS value FROM b GROUP BY key")
add("bitfield_get_signed", lambda t: bitmaps.bitfield_get(_thin(t), 8, 16, True), "b", f"SELECT key, CASE WHEN v >= 128 THEN v - 256 ELSE v END AS value FROM (SELECT key, {_FIELD} AS v FROM b GROUP BY key)")
add("bitfield_set", lambda t: bitmaps.bitfield_get(bitmaps.bitfield_set(_thin(t), 8, 16, t.b.select("key").distinct().withColumn("value", F.lit(165))), 8, 16, False), "b", "SELECT DISTINCT key, CAST(165 AS BIGINT) AS value FROM b")
for _mode, _e in (("WRAP", "(v + 100) % 256"), ("SAT", "least(v + 100, 255)"), ("FAIL", "CASE WHEN v + 100 <= 255 THEN v + 100 END")):
    add(f"bitfield_incrby_{_mode.lower()}", lambda t, m=_mode: bitmaps.bitfield_incrby(_thin(t), 8, 16, t.b.select("key").distinct().withColumn("delta", F.lit(100)), False, m)[0], "b", f"SELECT key, CAST({_e} AS BIGINT) AS value FROM (SELECT key, {_FIELD} AS v FROM b GROUP BY key)")

# --- JSON --------------------------------------------------------------------------------------------
_nested = lambda t: t.d.select("key", F.concat(F.lit('{"a":{"n":'), F.get_json_object("doc", "$.k"), F.lit(',"s":"x"},"l":[1,'), F.get_json_object("doc", "$.k"), F.lit(',true],"f":false}')).alias("doc"))
_reply = lambda e: f"SELECT key, {e} AS reply FROM d"
_edited = lambda d, r: f"SELECT key, {d} AS doc, {r} AS reply FROM d"
_DOC = lambda n="k", s="'\"x\"'", l="'[1,' || k || ',true]'", f="'false'": f"'{{\"a\":{{\"n\":' || {n} || ',\"s\":' || {s} || '}},\"l\":' || {l} || ',\"f\":' || {f} || '}}'"  # noqa: E731,E741
add("json_get", lambda t: json_docs.get(_nested(t), "$.a.n"), "d", "SELECT key, '[' || k || ']' AS value FROM d")
add("json_get_concrete", lambda t: json_docs.get_concrete(t.d, "$.k"), "d", "SELECT key, CAST(k AS VARCHAR) AS value FROM d")
add("json_get_paths", lambda t: json_docs.get(_nested(t), "$.a.s", "$..n"), "d", "SELECT key, '{\"$.a.s\":[\"x\"],\"$..n\":[' || k || ']}' AS value FROM d")
add("json_get_filter", lambda t: json_docs.get(_nested(t), "$.l[?(@ > 50)]"), "d", "SELECT key, CASE WHEN k > 50 THEN '[' || k || ']' ELSE '[]' END AS value FROM d")
add("json_mget", lambda t: json_docs.mget(t.d, t.rows([("1",), ("zz",)], "key string"), "$.k"), "d", "SELECT key, '[' || k || ']' AS value FROM d WHERE key = '1' UNION ALL SELECT 'zz', NULL")
add("json_type", lambda t: json_docs.inspect(_nested(t), "type", "$.*"), "d", _reply("'[\"object\",\"array\",\"boolean\"]'"))
add("json_arrlen", lambda t: json_docs.inspect(_nested(t), "arrlen", "$.l"), "d", _reply("'[3]'"))
add("json_arrindex", lambda t: json_docs.inspect(_nested(t), "arrindex", "$.l", 42, 1, 0), "d", _reply("CASE k WHEN 42 THEN '[1]' ELSE '[-1]' END"))
add("json_strlen", lambda t: json_docs.inspect(_nested(t), "strlen", "$..s"), "d", _reply("'[1]'"))
add("json_objkeys", lambda t: json_docs.inspect(_nested(t), "objkeys", "$.a"), "d", _reply("'[[\"n\",\"s\"]]'"))
add("json_objlen", lambda t: json_docs.inspect(_nested(t), "objlen", "a"), "d", _reply("'2'"))
add("json_resp", lambda t: json_docs.inspect(_nested(t), "resp", "$.a"), "d", _reply("'[[\"{\",\"n\",' || k || ',\"s\",\"x\"]]'"))
add("json_debug_memory", lambda t: json_docs.inspect(t.d, "memory", "$"), "d", _reply("'[' || (length(CAST(k AS VARCHAR)) + 6) || ']'"))
add("json_set", lambda t: json_docs.edit(_nested(t), "set", "$.a.n", 7, None), "d", _edited(_DOC("'7'"), "'\"OK\"'"))
add("json_set_nx", lambda t: json_docs.edit(_nested(t), "set", "$.f", 7, "NX"), "d", _edited(_DOC(), "CAST(NULL AS VARCHAR)"))
add("json_mset", lambda t: json_docs.mset(t.d, t.rows([(1, "1", "{}"), (2, "1", "[]")], "pos int, key string, doc string")).filter("key = '1'"), body="SELECT '1' AS key, '[]' AS doc")
add("json_merge", lambda t: json_docs.edit(_nested(t), "merge", "$", {"a": {"s": None}, "l": 1}), "d", "SELECT key, '{\"a\":{\"n\":' || k || '},\"l\":1,\"f\":false}' AS doc, '\"OK\"' AS reply FROM d")
add("json_del", lambda t: json_docs.edit(_nested(t), "del", "$.l[0,1]"), "d", _edited(_DOC(l="'[true]'"), "'2'"))
add("json_clear", lambda t: json_docs.edit(_nested(t), "clear", "$.l"), "d", _edited(_DOC(l="'[]'"), "'1'"))
add("json_numincrby", lambda t: json_docs.edit(_nested(t), "numincrby", "$.a.n", 5), "d", _edited(_DOC("(k + 5)"), "'[' || (k + 5) || ']'"))
add("json_nummultby", lambda t: json_docs.edit(_nested(t), "nummultby", "$.a.n", 3), "d", _edited(_DOC("(k * 3)"), "'[' || (k * 3) || ']'"))
add("json_numpowby", lambda t: json_docs.edit(_nested(t), "numpowby", "$.a.n", 2), "d", _edited(_DOC("(k * k)"), "'[' || (k * k) || ']'"))
add("json_strappend", lambda t: json_docs.edit(_nested(t), "strappend", "$.a.s", "yz"), "d", _edited(_DOC(s="'\"xyz\"'"), "'[3]'"))
add("json_toggle", lambda t: json_docs.edit(_nested(t), "toggle", "$.f"), "d", _edited(_DOC(f="'true'"), "'[true]'"))
add("json_arrappend", lambda t: json_docs.edit(_nested(t), "arrappend", "$.l", 8, 9), "d", _edited(_DOC(l="'[1,' || k || ',true,8,9]'"), "'[5]'"))
add("json_arrinsert", lambda t: json_docs.edit(_nested(t), "arrinsert", "$.l", -1, 8), "d", _edited(_DOC(l="'[1,' || k || ',8,true]'"), "'[4]'"))
add("json_arrpop", lambda t: json_docs.edit(_nested(t), "arrpop", "$.l", 1), "d", _edited(_DOC(l="'[1,true]'"), "'[' || k || ']'"))
add("json_arrtrim", lambda t: json_docs.edit(_nested(t), "arrtrim", "$.l", 1, 1), "d", _edited(_DOC(l="'[' || k || ']'"), "'[1]'"))

# --- streams -----------------------------------------------------------------------------------------
_MS = "1704070000000"
_after = f"ms > {_MS}"
_slim = lambda df: df.drop("fields")
_groups = lambda t: t.e.select("key").distinct().select("key", F.lit("g").alias("grp"), F.lit(int(_MS)).cast("long").alias("last_ms"), F.lit(0).cast("long").alias("last_seq"))
_PEND = f"p AS (SELECT key, 'g' AS grp, 'c' || (seq % 3) AS consumer, ms, seq, ms // 1000 * 1000 AS due, 1 + seq % 2 AS deliveries FROM e WHERE ms <= {_MS})"
_pend = lambda t: t.e.filter(f"ms <= {_MS}").select("key", F.lit("g").alias("grp"), F.concat(F.lit("c"), (F.col("seq") % 3).cast("string")).alias("consumer"), "ms", "seq", F.timestamp_seconds(F.expr("ms div 1000")).alias("delivered_at"), (1 + F.col("seq") % 2).alias("deliveries"))
_at = lambda t: F.timestamp_millis(F.lit(int(_MS)))
_none = lambda t: _pend(t).limit(0)
add("xadd", lambda t: streams.xadd(t.e, t.rows([(1, "click", 1, 1), (2, "click", 2_000_000_000_000, 1), (3, "click", 2_000_000_000_000, 1), (4, "click", 2_000_000_000_000, 2)], "ord int, key string, ms long, seq long").withColumn("fields", F.create_map(F.lit("a"), F.lit("b"))))[1].select("ord", "ms"), body="SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (3, 2000000000000)) v(ord, ms)")
add("xadd_idmp", lambda t: streams.idempotent(t.t("events").select(F.col("event_id").alias("ord"), F.lit("s").alias("key"), F.col("event_type").alias("producer"), (F.col("user_id") % 20).alias("iid"))).select("ord", "producer", "iid"), body="SELECT min(event_id) AS ord, event_type AS producer, user_id % 20 AS iid FROM events GROUP BY 2, 3")
add("xadd_idmpauto", lambda t: t.e.select("seq", streams.auto_iid(F.map_from_arrays(F.array(F.lit("user")), F.array(F.col("fields")["user"]))).alias("iid")), "e", "SELECT seq, sha256('user' || chr(30) || user_id) AS iid FROM e")
add("xlen", lambda t: streams.xlen(t.e), "e", "SELECT key, count(*) AS n FROM e GROUP BY key")
add("xrange", lambda t: _slim(streams.xrange(t.e, f"({_MS}-0", "1704150000000", 10)), "e", f"SELECT key, ms, seq, pos FROM (SELECT key, ms, seq, row_number() OVER (PARTITION BY key ORDER BY ms, seq) - 1 AS pos FROM e WHERE (ms > {_MS} OR (ms = {_MS} AND seq > 0)) AND ms <= 1704150000000) WHERE pos < 10")
add("xrevrange", lambda t: _slim(streams.xrange(t.e, count=10, rev=True)), "e", "SELECT key, ms, seq, pos FROM (SELECT key, ms, seq, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) - 1 AS pos FROM e) WHERE pos < 10")
add("xread", lambda t: _slim(streams.xread(t.e, _groups(t).drop("grp"), 5)), "e", f"SELECT key, ms, seq FROM (SELECT key, ms, seq, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM e WHERE ms > {_MS} OR (ms = {_MS} AND seq > 0)) WHERE r <= 5")
add("xtrim_maxlen", lambda t: _slim(streams.xtrim_maxlen(t.e, 100)), "e", "SELECT key, ms, seq FROM (SELECT key, ms, seq, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM e) WHERE r <= 100")
add("xtrim_approx", lambda t: streams.xlen(streams.xtrim_maxlen(t.e, 150, 100)), "e", "SELECT key, CAST(n - greatest(n - 150, 0) // 100 * 100 AS BIGINT) AS n FROM (SELECT key, count(*) AS n FROM e GROUP BY key)")
add("xtrim_minid", lambda t: _slim(streams.xtrim_minid(t.e, _MS)), "e", f"SELECT key, ms, seq FROM e WHERE ms >= {_MS}")
add("xdel", lambda t: _slim(streams.xdel(t.e, t.e.filter("seq % 5 = 0"))), "e", "SELECT key, ms, seq FROM e WHERE seq % 5 > 0")
add("xdelex_acked", lambda t: _slim(streams.xdelex(t.e, _pend(t), t.e.filter("seq % 5 = 0"), "ACKED")[0]), "e", f"WITH {_PEND} SELECT key, ms, seq FROM e WHERE seq % 5 > 0 OR ms <= {_MS}")
add("xackdel_delref", lambda t: streams.xackdel(t.e, _pend(t), _pend(t).filter("seq % 5 = 0"), "DELREF")[1].select("key", "seq"), "e", f"WITH {_PEND} SELECT key, seq FROM p WHERE seq % 5 > 0")
add("xinfo_stream", lambda t: streams.xinfo_stream(t.e, _groups(t)).select("key", "length", F.col("first_id.ms").alias("first_ms"), F.col("last_id.ms").alias("last_ms"), "groups"), "e", "SELECT key, count(*) AS length, min(ms) AS first_ms, max(ms) AS last_ms, CAST(1 AS BIGINT) AS groups FROM e GROUP BY key")
add("xinfo_groups", lambda t: streams.lag(t.e, _groups(t), _pend(t)), "e", f"WITH {_PEND} SELECT key, 'g' AS grp, CAST(sum(CASE WHEN ms > {_MS} OR (ms = {_MS} AND seq > 0) THEN 1 ELSE 0 END) AS BIGINT) AS lag, CAST(sum(CASE WHEN ms <= {_MS} THEN 1 ELSE 0 END) AS BIGINT) AS pending, count(DISTINCT CASE WHEN ms <= {_MS} THEN seq % 3 END) AS consumers FROM e GROUP BY key")
add("xinfo_consumers", lambda t: streams.xinfo_consumers(_pend(t), _at(t)), "e", f"WITH {_PEND} SELECT key, grp, consumer, count(*) AS pending, CAST({_MS} - max(due) AS BIGINT) AS idle FROM p GROUP BY 1, 2, 3")
add("xreadgroup", lambda t: streams.xreadgroup(t.e, _groups(t), _none(t), "c", _at(t), 4)[2].select("key", "consumer", "ms", "seq", "deliveries"), "e", f"SELECT key, 'c' AS consumer, ms, seq, CAST(1 AS BIGINT) AS deliveries FROM (SELECT key, ms, seq, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM e WHERE ms > {_MS} OR (ms = {_MS} AND seq > 0)) WHERE r <= 4")
add("xreadgroup_history", lambda t: _slim(streams.history(t.e, _pend(t), "c1")), "e", f"WITH {_PEND} SELECT key, grp, ms, seq FROM p WHERE consumer = 'c1'")
add("xack", lambda t: streams.xack(_pend(t), _pend(t).filter("seq % 2 = 0")).select("key", "seq"), "e", f"WITH {_PEND} SELECT key, seq FROM p WHERE seq % 2 = 1")
add("xpending_summary", lambda t: streams.xpending_summary(_pend(t)).select("key", "grp", "n", F.col("first_id.seq").alias("first_seq"), F.col("last_id.seq").alias("last_seq")), "e", f"WITH {_PEND} SELECT key, grp, count(*) AS n, arg_min(seq, (ms, seq)) AS first_seq, arg_max(seq, (ms, seq)) AS last_seq FROM p GROUP BY 1, 2")
add("xpending_consumers", lambda t: streams.xpending_consumers(_pend(t)), "e", f"WITH {_PEND} SELECT key, grp, consumer, count(*) AS n FROM p GROUP BY 1, 2, 3")
add("xpending", lambda t: streams.xpending(_pend(t), _at(t), count=5, consumer="c1", min_idle=3_600_000).select("key", "ms", "seq", "idle", "deliveries"), "e", f"WITH {_PEND} SELECT key, ms, seq, CAST({_MS} - due AS BIGINT) AS idle, deliveries FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM p WHERE consumer = 'c1' AND {_MS} - due >= 3600000) WHERE r <= 5")
add("xclaim", lambda t: streams.xclaim(_pend(t), _pend(t).filter("seq % 2 = 0"), "new", 3_600_000, _at(t))[1].select("key", "seq", "consumer", "deliveries"), "e", f"WITH {_PEND} SELECT key, seq, CASE WHEN c THEN 'new' ELSE consumer END AS consumer, deliveries + CASE WHEN c THEN 1 ELSE 0 END AS deliveries FROM (SELECT *, seq % 2 = 0 AND {_MS} - due >= 3600000 AS c FROM p)")
add("xclaim_force", lambda t: streams.xclaim(_none(t), _pend(t).filter("seq % 2 = 0"), "new", 0, _at(t), force=t.e)[1].select("key", "seq", "deliveries"), "e", f"WITH {_PEND} SELECT key, seq, CAST(1 AS BIGINT) AS deliveries FROM p WHERE seq % 2 = 0")
add("xautoclaim", lambda t: streams.xautoclaim(t.e.filter("seq % 7 > 0"), _pend(t), "new", 3_600_000, _at(t), count=20)[1].filter("consumer = 'new'").select("key", "seq"), "e", f"WITH {_PEND} SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM p WHERE {_MS} - due >= 3600000) WHERE r <= 20 AND seq % 7 > 0")
add("xgroup_create", lambda t: streams.group_create(_groups(t), t.rows([("click", "g", 0, 0), ("click", "h", 0, 0)], "key string, grp string, last_ms long, last_seq long")).groupBy("key").agg(F.count("*").alias("n")), "e", "SELECT DISTINCT key, CAST(CASE key WHEN 'click' THEN 2 ELSE 1 END AS BIGINT) AS n FROM e")
add("xsetid", lambda t: streams.xsetid(t.e, t.rows([("click", 2_000_000_000_000, 7), ("view", 5, 0)], "key string, ms long, seq long")), "e", "SELECT key, CAST(CASE key WHEN 'click' THEN 2000000000000 ELSE max(ms) END AS BIGINT) AS ms, CAST(CASE key WHEN 'click' THEN 7 ELSE arg_max(seq, CAST(ms AS HUGEINT) * 10000000 + seq) END AS BIGINT) AS seq FROM e GROUP BY key")
add("xadd_maxlen", lambda t: _slim(streams.xadd(t.e, t.rows([(1, "click", 2_000_000_000_000, 1), (2, "nostream", 5, 1)], "ord int, key string, ms long, seq long").withColumn("fields", F.create_map(F.lit("a"), F.lit("b"))), maxlen=50, nomkstream=True)[0]), "e",
    "WITH x AS (SELECT key, ms, seq FROM e UNION ALL SELECT 'click', 2000000000000, 1) SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM x) WHERE r <= 50 OR key <> 'click'")
add("xidmprecord", lambda t: streams.record_producers(t.t("events").select(F.lit("s").alias("key"), F.col("event_type").alias("producer"), F.col("user_id").alias("iid"), F.col("event_id").alias("at")), 20), body="SELECT 's' AS key, producer, iid, last AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY last DESC, iid) AS r FROM (SELECT event_type AS producer, user_id AS iid, max(event_id) AS last FROM events GROUP BY 1, 2)) WHERE r <= 20")
add("xcfgset", lambda t: streams.configure(t.e.select("key").distinct().select("key", F.lit(100).cast("long").alias("idmp_max"), F.lit(60).cast("long").alias("idmp_seconds")), t.rows([("click", 5, None)], "key string, idmp_max long, idmp_seconds long")), "e", "SELECT DISTINCT key, CAST(CASE key WHEN 'click' THEN 5 ELSE 100 END AS BIGINT) AS idmp_max, CAST(60 AS BIGINT) AS idmp_seconds FROM e")
add("xgroup_createconsumer", lambda t: streams.create_consumer(t.rows([("click", "g", "c1")], "key string, grp string, consumer string"), t.rows([("click", "g", "c1"), ("click", "g", "c2"), ("click", "g", "c2")], "key string, grp string, consumer string")), body="SELECT 'click' AS key, 'g' AS grp, c AS consumer FROM (VALUES ('c1'), ('c2')) v(c)")
add("xgroup_destroy", lambda t: streams.group_destroy(_groups(t), _pend(t), t.rows([("click", "g")], "key string, grp string"))[0].select("key"), "e", "SELECT DISTINCT key FROM e WHERE key <> 'click'")
add("xgroup_setid", lambda t: streams.group_setid(_groups(t), t.rows([("click", "g", 5, 6)], "key string, grp string, last_ms long, last_seq long")), "e", f"SELECT DISTINCT key, 'g' AS grp, CAST(CASE key WHEN 'click' THEN 5 ELSE {_MS} END AS BIGINT) AS last_ms, CAST(CASE key WHEN 'click' THEN 6 ELSE 0 END AS BIGINT) AS last_seq FROM e")
add("xgroup_delconsumer", lambda t: streams.del_consumer(_pend(t), t.rows([("click", "g", "c1"), ("click", "g", "zz")], "key string, grp string, consumer string"))[0].select("consumer", "pending"), "e", f"WITH {_PEND} SELECT 'c1' AS consumer, count(*) AS pending FROM p WHERE key = 'click' AND consumer = 'c1' UNION ALL SELECT 'zz', 0")

# --- publish and subscribe ---------------------------------------------------------------------------
_SUBS = [("a", "click", False), ("b", "*i*", True), ("c", "[cv]*", True), ("a", "?i*", True), ("d", "view", False)]
_subs = lambda t: t.rows(_SUBS, "client string, pattern string, is_glob boolean")
_SUB = "u AS (SELECT * FROM (VALUES ('a', '^click$'), ('b', 'i'), ('c', '^[cv]'), ('a', '^.i'), ('d', '^view$')) v(client, re))"
add("publish", lambda t: pubsub.publish(t.m, _subs(t)), "m", f"WITH {_SUB} SELECT channel, CAST(sum(CASE WHEN regexp_matches(channel, re) THEN 1 ELSE 0 END) AS BIGINT) AS receivers FROM m, u GROUP BY channel")
add("psubscribe", lambda t: pubsub.deliveries(t.m, _subs(t)).groupBy("client").agg(F.count("*").alias("n")), "m", f"WITH {_SUB} SELECT client, count(*) AS n FROM m, u WHERE regexp_matches(channel, re) GROUP BY client")
add("pubsub_channels", lambda t: pubsub.channels(_subs(t), "c*"), body="SELECT 'click' AS channel")
add("pubsub_numsub", lambda t: pubsub.numsub(_subs(t)), body="SELECT * FROM (VALUES ('click', CAST(1 AS BIGINT)), ('view', 1)) v(channel, n)")
add("pubsub_numpat", lambda t: pubsub.numpat(_subs(t)), body="SELECT CAST(3 AS BIGINT) AS n")

# --- sort --------------------------------------------------------------------------------------------
_items = lambda t: t.t("part").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("value"))
add("sort", lambda t: sorting.sort(_items(t), desc=True, limit=(1, 5)), body="SELECT * FROM (SELECT p_brand AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) - 1 AS pos, CAST(p_partkey AS VARCHAR) AS value FROM part) WHERE pos BETWEEN 1 AND 5")
add("sort_alpha", lambda t: sorting.sort(_items(t), alpha=True), body="SELECT p_brand AS key, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS pos, CAST(p_partkey AS VARCHAR) AS value FROM part")
add("sort_by_get", lambda t: sorting.sort(_items(t), by="part:*->size", get=("#", "part:*->name"), h=t.h), body="SELECT p_brand AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, CAST(p_partkey AS VARCHAR)) - 1 AS pos, CAST(p_partkey AS VARCHAR) AS value, CAST(p_partkey AS VARCHAR) AS got_0, p_name AS got_1 FROM part")
add("sort_store", lambda t: sorting.store(sorting.sort(_items(t).filter("key = 'Brand#2'")), "out"), body="SELECT 'out' AS key, row_number() OVER (ORDER BY p_partkey) - 1 AS seq, CAST(p_partkey AS VARCHAR) AS value FROM part WHERE p_brand = 'Brand#2'")

# --- effect log, transactions ------------------------------------------------------------------------
_log = lambda t: t.t("events").select(
    F.col("event_type").alias("key"), (F.col("user_id") % 10).cast("string").alias("elem"), F.when(F.col("event_id") % 29 == 0, "remove").otherwise("insert").alias("op"), F.when(F.col("user_id") % 2 == 0, "lww").otherwise("add_int").alias("merge"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("hlc"), F.lit(1).alias("node")
)
add("effects_reduce", lambda t: effects.reduce_effects(_log(t)), body="""WITH l AS (SELECT event_type AS key, CAST(user_id % 10 AS VARCHAR) AS elem, event_id % 29 = 0 AS gone, user_id, event_id FROM events),
  x AS (SELECT *, max(CASE WHEN gone THEN event_id ELSE -1 END) OVER (PARTITION BY key, elem) AS last FROM l)
  SELECT key, elem, CASE WHEN CAST(elem AS INTEGER) % 2 = 0 THEN 'lww' ELSE 'add_int' END AS merge, CAST(CASE WHEN CAST(elem AS INTEGER) % 2 = 0 THEN arg_max(user_id, event_id) ELSE sum(user_id) END AS VARCHAR) AS value FROM x WHERE NOT gone AND event_id > last GROUP BY key, elem""")
add("row_materialisation", lambda t: effects.materialise(t.h.select("key", F.col("field").alias("elem"), F.lit("insert").alias("op"), F.lit("lww").alias("merge"), "value", F.lit(1).alias("hlc"), F.lit(1).alias("node")), {"name": ("string", None), "size": ("bigint", 0), "stock": ("bigint", 7)}), body="SELECT 'part:' || p_partkey AS key, p_name AS name, CAST(p_size AS BIGINT) AS size, CAST(7 AS BIGINT) AS stock FROM part")
_writes = lambda t: t.t("orders").select(F.concat(F.lit("t"), (F.col("o_orderkey") % 7).cast("string")).alias("txn"), F.lit("orders").alias("tbl"), F.lit("UPDATE").alias("kind"), "o_orderkey", "o_orderstatus", "o_totalprice")
_OBS = [("t0", "orders", P.both(P.cmp("o_orderstatus", "=", "F"), P.cmp("o_totalprice", ">", 250000.0))), ("t1", "orders", P.between("o_orderkey", 0, 1000)), ("t2", "orders", P.cmp("o_orderstatus", "=", 5)), ("t3", "orders", P.TRUE)]
_TYPES = {"o_orderkey": "integer", "o_orderstatus": "text", "o_totalprice": "real"}
_CONF = "w AS (SELECT 't' || (o_orderkey % 7) AS txn, * FROM orders), f AS (SELECT 't0' AS reader, txn AS writer FROM w WHERE o_orderstatus = 'F' AND o_totalprice > 250000 AND txn <> 't0' UNION SELECT 't1', txn FROM w WHERE o_orderkey BETWEEN 0 AND 1000 AND txn <> 't1' UNION SELECT 't3', txn FROM w WHERE txn <> 't3')"
# --- files by path and command text -----------------------------------------------------------------
_files = lambda t: t.t("pages").select(F.concat(F.lit("acme/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("value"))
_FILES = "c AS (SELECT 'acme/' || (page_id % 7) || '/' || page_id AS path, html AS value FROM pages)"
add("store_put", lambda t: tables.store(_files(t), t.rows([("acme/0/0", "new"), ("other", "x")], "path string, value string")), body=f"WITH {_FILES} SELECT path, value FROM c WHERE path <> 'acme/0/0' UNION ALL SELECT * FROM (VALUES ('acme/0/0', 'new'), ('other', 'x')) v(path, value)")
add("store_load", lambda t: tables.load(_files(t), "acme/3/3"), body=f"WITH {_FILES} SELECT path, value FROM c WHERE path = 'acme/3/3'")
add("store_exists", lambda t: tables.exists(_files(t), "acme/3").select(F.col("there").cast("int").alias("there")).union(tables.exists(_files(t), "acme/3/").select(F.col("there").cast("int"))).union(tables.exists(_files(t), "acm").select(F.col("there").cast("int"))), body="SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (0), (0)) v(there)")
add("store_delete", lambda t: tables.delete(_files(t), "acme/3").select("path"), body=f"WITH {_FILES} SELECT path FROM c WHERE path NOT LIKE 'acme/3/%'")
add("store_list", lambda t: tables.list_below(_files(t), "acme", False), body=f"WITH {_FILES} SELECT DISTINCT regexp_extract(path, '^acme/[^/]*') AS path FROM c")
add("store_list_recursive", lambda t: tables.list_below(_files(t), "acme/3/", True), body=f"WITH {_FILES} SELECT path FROM c WHERE path LIKE 'acme/3/%'")
add("store_stat", lambda t: tables.stat(_files(t).withColumn("modified", t.now), "acme/3/3").select("path", F.col("size").cast("long").alias("size"), F.unix_seconds("modified").alias("modified")), body=f"WITH {_FILES} SELECT path, CAST(strlen(value) AS BIGINT) AS size, CAST({_EPOCH} AS BIGINT) AS modified FROM c WHERE path = 'acme/3/3'")
add("inline_commands", lambda t: tables.commands(t.t("events").select(F.concat(F.lit("  set k"), F.col("event_id").cast("string"), F.lit(' "'), F.col("event_type"), F.lit(" x\" 'y z'")).alias("value"))).select("name", F.get("args", F.lit(0)).alias("a"), F.get("args", F.lit(1)).alias("b"), F.get("args", F.lit(2)).alias("c"), F.size("args").alias("n")),
    body="SELECT 'SET' AS name, 'k' || event_id AS a, event_type || ' x' AS b, 'y z' AS c, CAST(3 AS BIGINT) AS n FROM events")

# --- the same functions under their other names -----------------------------------------------------
for _other, _name in (("hmset", "hset"), ("json_forget", "json_del"), ("georadius_ro", "georadius"), ("georadiusbymember_ro", "georadiusbymember"), ("sort_ro", "sort")):
    QUERIES[_other], ORACLES[_other] = QUERIES[_name], ORACLES[_name]

add("txn_conflicts", lambda t: transactions.conflicts(_writes(t), _OBS, _TYPES), body=f"WITH {_CONF} SELECT reader, writer FROM f")
add("txn_aborted", lambda t: transactions.aborted(transactions.conflicts(_writes(t), _OBS, _TYPES), t.rows([(f"t{i}", i, 1) for i in range(7)], "txn string, hlc long, node int")), body=f"WITH {_CONF} SELECT DISTINCT greatest(reader, writer) AS txn FROM f")
add("watch", lambda t: transactions.watch_conflicts(t.rows([("a", "user:1", 1), ("b", "user:2", 1), ("c", "gone", 1)], "txn string, key string, version long"), t.kv.select("key", F.when(F.col("key") == "user:2", 2).otherwise(1).cast("long").alias("version"))), body="SELECT * FROM (VALUES ('b'), ('c')) v(txn)")

# Binary records
add("struct_pack", lambda t: t.t("customer").select("c_custkey", F.hex(structs.pack(">I4Hs", F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment"))).alias("packed")), body="SELECT c_custkey, printf('%08X', c_custkey) || printf('%04X', c_nationkey) || hex(c_mktsegment) || '00' AS packed FROM customer")
add("struct_unpack", lambda t: t.t("customer").select(structs.unpack("<!4bi8dBc0", structs.pack("<!4bi8dBc0", -F.col("c_nationkey"), F.col("c_custkey") * -(1 << 40), F.col("c_acctbal"), F.length("c_name"), F.col("c_name"))).alias("u")).select("u.v1", "u.v2", "u.v3", F.col("u.v4").cast("string").alias("v4"), "u.next"),
    body="SELECT CAST(-c_nationkey AS BIGINT) AS v1, c_custkey * -1099511627776 AS v2, c_acctbal AS v3, c_name AS v4, CAST(22 + length(c_name) AS BIGINT) AS next FROM customer")
