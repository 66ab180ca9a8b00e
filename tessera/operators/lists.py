"""Lists in long form: l(key, seq, value), ordered by seq, which only has to be unique and ascending within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.functions.text import from_end, within_indexes
from tessera.operators.effects import anti_delete

def _by() -> WindowSpec:
    return Window.partitionBy("key")


def indexed(lst: DataFrame) -> DataFrame:
    """With pos (zero-based) and n (length)."""
    return lst.withColumns({"pos": F.row_number().over(_by().orderBy("seq")) - 1, "n": F.count("*").over(_by())})


def push(lst: DataFrame, new: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """lst after new(key, ord, value): each pushed in turn to the tail, or to the head."""
    ends = lst.groupBy("key").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    j = new.join(ends, "key", "inner" if only_existing else "left")
    nth = F.row_number().over(_by().orderBy("ord"))
    seq = F.coalesce("lo", F.lit(0)) - nth if left else F.coalesce("hi", F.lit(-1)) + nth
    return lst.unionByName(j.select("key", seq.cast("long").alias("seq"), "value"))


def pop(lst: DataFrame, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(popped with ord, rest)."""
    ranked = lst.withColumn("ord", F.row_number().over(_by().orderBy(F.col("seq") if left else F.col("seq").desc())))
    return ranked.filter(F.col("ord") <= count).select("key", "ord", "value"), ranked.filter(F.col("ord") > count).drop("ord")


def mpop(lst: DataFrame, asked: DataFrame, count: int = 1, left: bool = True) -> DataFrame:
    """asked(req, ord, key): of each request the first non-empty list gives its elements."""
    first = asked.join(lst.select("key").distinct(), "key", "left_semi").groupBy("req").agg(F.min_by("key", "ord").alias("key"))
    return first.join(pop(lst, count, left)[0], "key").select("req", "key", "ord", "value")


def llen(lst: DataFrame) -> DataFrame:
    return lst.groupBy("key").agg(F.count("*").alias("n"))


def lrange(lst: DataFrame, start: int, stop: int) -> DataFrame:
    """Indexes from the head need no length, so each task keeps a list's first stop + 1 elements only and sends no more."""
    if start >= 0 and stop >= 0:
        first = lst.withColumn("nth", F.row_number().over(_by().orderBy("seq"))).filter((F.col("nth") <= stop + 1) & (F.col("nth") > start))
        return first.select("key", (F.col("nth") - 1).alias("pos"), "value")
    i = indexed(lst)
    return i.filter(within_indexes(F.col("pos"), F.col("n"), start, stop)).select("key", "pos", "value")


def lindex(lst: DataFrame, index: int) -> DataFrame:
    i = indexed(lst)
    return i.filter(F.col("pos") == from_end(index, F.col("n"))).select("key", "value")


def lset(lst: DataFrame, index: int, value: str) -> DataFrame:
    """Lists too short for the index stay as they are."""
    i = indexed(lst)
    return i.withColumn("value", F.when(F.col("pos") == from_end(index, F.col("n")), F.lit(value)).otherwise(F.col("value"))).select(*lst.columns)


def lrem(lst: DataFrame, count: int, value: str) -> DataFrame:
    """Without the first count matches, the last -count, or all (0)."""
    hit = F.col("value") == value
    order = F.col("seq").desc() if count < 0 else F.col("seq")
    nth = F.sum(F.when(hit, 1).otherwise(0)).over(_by().orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = lst.withColumn("nth", nth)
    return ranked.filter(~F.coalesce(hit, F.lit(False)) | (F.lit(bool(count)) & (F.col("nth") > abs(count)))).drop("nth")


def ltrim(lst: DataFrame, start: int, stop: int) -> DataFrame:
    i = indexed(lst)
    return i.filter(within_indexes(F.col("pos"), F.col("n"), start, stop)).select(*lst.columns)


def linsert(lst: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:
    """The new element beside the first pivot; lists without it stay. Sequence numbers are dealt anew."""
    doubled = lst.withColumn("seq", F.col("seq") * 2)
    at = doubled.filter(F.col("value") == pivot).groupBy("key").agg(F.min("seq").alias("at"))
    return doubled.unionByName(at.select("key", (F.col("at") + (-1 if before else 1)).alias("seq"), F.lit(value).alias("value")))


def lpos(lst: DataFrame, value: str, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """Positions of matches from the rank-th on, from the tail for negative ranks; count 0 gives all, None the first.
    maxlen bounds how many elements are looked at."""
    i = indexed(lst)
    seen = F.col("pos") if rank > 0 else F.col("n") - 1 - F.col("pos")
    hits = (i.filter(seen < maxlen) if maxlen else i).filter(F.col("value") == value)
    nth = F.row_number().over(_by().orderBy(F.col("pos") if rank > 0 else F.col("pos").desc()))
    take = hits.withColumn("nth", nth).filter(F.col("nth") >= abs(rank))
    most = 1 if count is None else count
    return (take.filter(F.col("nth") < abs(rank) + most) if most else take).select("key", "nth", "pos")


def lmove(lst: DataFrame, moves: DataFrame, from_left: bool, to_left: bool) -> DataFrame:
    """moves(src, dst) of distinct sources: one element from an end of src to an end of dst."""
    popped, _ = pop(lst.join(moves.select(F.col("src").alias("key")).distinct(), "key", "left_semi"), 1, from_left)
    end = lst.groupBy("key").agg((F.min("seq") if from_left else F.max("seq")).alias("seq"))
    rest = anti_delete(lst, end.join(moves.select(F.col("src").alias("key")), "key", "left_semi"), ["key", "seq"])
    new = popped.join(moves, F.col("key") == F.col("src")).select(F.col("dst").alias("key"), F.row_number().over(Window.partitionBy("dst").orderBy("src")).alias("ord"), "value")
    return push(rest, new, to_left)


def rpoplpush(lst: DataFrame, moves: DataFrame) -> DataFrame:
    return lmove(lst, moves, from_left=False, to_left=True)
