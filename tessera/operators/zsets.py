"""Sorted sets in long form: z(key, member, score), ordered by (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.functions.text import from_end, lex_bound, score_bound, within_indexes
from tessera.operators.effects import anti_delete, upsert

def _by() -> WindowSpec:
    return Window.partitionBy("key")


def _order(rev: bool = False) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if rev else [F.col("score"), F.col("member")]


def ranked(z: DataFrame, rev: bool = False) -> DataFrame:
    """With rank (zero-based) and n: ZRANK or ZREVRANK of every member at once."""
    return z.withColumns({"rank": F.row_number().over(_by().orderBy(*_order(rev))) - 1, "n": F.count("*").over(_by())})


def zscore(z: DataFrame, member: str) -> DataFrame:
    return z.filter(F.col("member") == member).select("key", "score")


def zmscore(z: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(z, ["key", "member"], "left").select("key", "member", "score")


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("n"))


def zrange(z: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """Indexes from the beginning need no count, so each task keeps a key's first stop + 1 members only and sends no more."""
    if start >= 0 and stop >= 0:
        first = z.withColumn("nth", F.row_number().over(_by().orderBy(*_order(rev)))).filter((F.col("nth") <= stop + 1) & (F.col("nth") > start))
        return first.select("key", (F.col("nth") - 1).alias("rank"), "member", "score")
    r = ranked(z, rev)
    return r.filter(within_indexes(F.col("rank"), F.col("n"), start, stop)).select("key", "rank", "member", "score")


def _page(z: DataFrame, rev: bool, limit: tuple[int, int] | None) -> DataFrame:
    r = z.withColumn("pos", F.row_number().over(_by().orderBy(*_order(rev))) - 1)
    if limit:
        offset, count = limit
        r = r.filter((F.col("pos") >= offset) & ((F.col("pos") < offset + count) if count >= 0 else F.lit(True)))
    return r


def zrangebyscore(z: DataFrame, lo: str, hi: str, rev: bool = False, limit: tuple[int, int] | None = None) -> DataFrame:
    """Per key, with pos counted from the range's beginning."""
    s = F.col("score")
    return _page(z.filter(score_bound(s, lo, True) & score_bound(s, hi, False)), rev, limit).select("key", "pos", "member", "score")


def zrangebylex(z: DataFrame, lo: str, hi: str, rev: bool = False, limit: tuple[int, int] | None = None) -> DataFrame:
    m = F.col("member")
    return _page(z.filter(lex_bound(m, lo, True) & lex_bound(m, hi, False)), rev, limit).select("key", "pos", "member", "score")


def zcount(z: DataFrame, lo: str, hi: str) -> DataFrame:
    s = F.col("score")
    return z.groupBy("key").agg(F.count_if(score_bound(s, lo, True) & score_bound(s, hi, False)).alias("n"))


def zlexcount(z: DataFrame, lo: str, hi: str) -> DataFrame:
    m = F.col("member")
    return z.groupBy("key").agg(F.count_if(lex_bound(m, lo, True) & lex_bound(m, hi, False)).alias("n"))


def zrandmember(z: DataFrame, count: int, seed: int) -> DataFrame:
    from tessera.operators.sets import srandmember

    return srandmember(z.select("key", "member"), count, seed).join(z, ["key", "member"])


def _weighted(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    s = F.col("score") * F.element_at(w, F.col("key"))
    return z.filter(F.col("key").isin(list(weights))).withColumn("score", F.when(F.isnan(s), 0.0).otherwise(s))


_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def zunion(z: DataFrame, weights: dict[str, float], aggregate: str = "sum") -> DataFrame:
    """(member, score) over the keys of weights; a sum of infinities of both signs is 0."""
    a = _weighted(z, weights).groupBy("member").agg(_AGGREGATES[aggregate]("score").alias("score"))
    return a.withColumn("score", F.when(F.isnan("score"), 0.0).otherwise(F.col("score")))


def zinter(z: DataFrame, weights: dict[str, float], aggregate: str = "sum") -> DataFrame:
    a = _weighted(z, weights).groupBy("member").agg(_AGGREGATES[aggregate]("score").alias("score"), F.count("*").alias("n"))
    return a.filter(F.col("n") == len(weights)).select("member", F.when(F.isnan("score"), 0.0).otherwise(F.col("score")).alias("score"))


def zintercard(z: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    rows = zinter(z, dict.fromkeys(keys, 1.0)).select("member")
    return (rows.limit(limit) if limit else rows).agg(F.count("*").alias("n"))


def zdiff(z: DataFrame, keys: list[str]) -> DataFrame:
    others = z.filter(F.col("key").isin(keys[1:])).select("member")
    return z.filter(F.col("key") == keys[0]).join(others, "member", "left_anti").select("member", "score")


def store(z: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """z with key holding just those rows (ZUNIONSTORE, ZINTERSTORE, ZDIFFSTORE, ZRANGESTORE)."""
    return z.filter(F.col("key") != key).unionByName(rows.select(F.lit(key).alias("key"), "member", "score"))


def zadd(z: DataFrame, writes: DataFrame, condition: str | None = None, compare: str | None = None) -> DataFrame:
    """z after writes(pos, key, member, score): NX only new members, XX only known ones; GT and LT only raise or lower a
    known score. Of several writes to a member the last counts, or the greatest or least with GT or LT."""
    pick = {None: F.max_by("score", "pos"), "GT": F.max("score"), "LT": F.min("score")}[compare]
    w = writes.filter(~F.isnan("score")).groupBy("key", "member").agg(pick.alias("new"))
    j = w.join(z.select("key", "member", F.col("score").alias("old")), ["key", "member"], "left")
    new = {None: F.col("new"), "GT": F.greatest("new", "old"), "LT": F.least("new", "old")}[compare]
    ok = {None: F.lit(True), "NX": F.col("old").isNull(), "XX": F.col("old").isNotNull()}[condition]
    return upsert(z, j.filter(ok).select("key", "member", new.alias("score")), ["key", "member"])


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many members of each key are new or have another score (CH)."""
    b = before.select("key", "member", F.col("score").alias("old"))
    j = after.join(b, ["key", "member"], "left").filter(F.col("old").isNull() | (F.col("old") != F.col("score")))
    return j.groupBy("key").agg(F.count("*").alias("changed"))


def zincrby(z: DataFrame, deltas: DataFrame) -> DataFrame:
    """z after adding deltas(key, member, delta); absent members start at 0. A NaN result leaves the score."""
    d = deltas.groupBy("key", "member").agg(F.sum("delta").alias("delta"))
    j = d.join(z, ["key", "member"], "left").withColumn("new", F.coalesce("score", F.lit(0.0)) + F.col("delta"))
    return upsert(z, j.select("key", "member", F.when(F.isnan("new"), F.coalesce("score", F.lit(0.0))).otherwise(F.col("new")).alias("score")), ["key", "member"])


def zrem(z: DataFrame, victims: DataFrame) -> DataFrame:
    return anti_delete(z, victims, ["key", "member"])


def zpop(z: DataFrame, count: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    r = z.withColumn("ord", F.row_number().over(_by().orderBy(*_order(highest))))
    return r.filter(F.col("ord") <= count), r.filter(F.col("ord") > count).drop("ord")


def zmpop(z: DataFrame, asked: DataFrame, count: int = 1, highest: bool = False) -> DataFrame:
    """asked(req, ord, key): of each request the first non-empty key gives its elements."""
    first = asked.join(z.select("key").distinct(), "key", "left_semi").groupBy("req").agg(F.min_by("key", "ord").alias("key"))
    return first.join(zpop(z, count, highest)[0], "key").select("req", "key", "ord", "member", "score")


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    r = ranked(z)
    return r.filter(~((F.col("rank") >= F.greatest(from_end(start, F.col("n")), F.lit(0))) & (F.col("rank") <= from_end(stop, F.col("n"))))).select(*z.columns)


def zremrangebyscore(z: DataFrame, lo: str, hi: str) -> DataFrame:
    s = F.col("score")
    return z.filter(~(score_bound(s, lo, True) & score_bound(s, hi, False)))


def zremrangebylex(z: DataFrame, lo: str, hi: str) -> DataFrame:
    m = F.col("member")
    return z.filter(~(lex_bound(m, lo, True) & lex_bound(m, hi, False)))
