"""Serialisable transactions as a query: a transaction conflicts with another if a row the other wrote meets a predicate it read by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.predicates import Predicate


def conflicts(writes: DataFrame, observations: list[tuple[str, str, Predicate]], types: dict[str, str] | None = None) -> DataFrame:
    """(reader, writer): writes(txn, tbl, kind, columns...) of another transaction that satisfy one of the observations
    (txn, table, predicate). The writes are scanned once, whatever the number of observations: each is a condition on a
    row, which gives its readers. INSERT and UPDATE give their new row, DELETE its old one."""
    if not observations:
        return writes.select(F.lit(None).cast("string").alias("reader"), F.col("txn").alias("writer")).limit(0)
    hits = [F.when((F.col("tbl") == table) & (F.col("txn") != txn) & F.coalesce(p.column(types), F.lit(False)), F.lit(txn)) for txn, table, p in observations]
    return writes.select(F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("reader"), F.col("txn").alias("writer")).distinct()


def aborted(found: DataFrame, order: DataFrame) -> DataFrame:
    """Which transactions abort, by a rule of our own: of two that conflict, the later by order(txn, hlc, node)."""
    o = order.select("txn", F.struct("hlc", "node", "txn").alias("at"))
    pairs = found.join(o.select(F.col("txn").alias("reader"), F.col("at").alias("r")), "reader").join(o.select(F.col("txn").alias("writer"), F.col("at").alias("w")), "writer")
    return pairs.select(F.greatest("r", "w")["txn"].alias("txn")).distinct()


def watch_conflicts(read: DataFrame, head: DataFrame) -> DataFrame:
    """Of read(txn, key, version), the transactions with a key that has another version now, or is gone: EXEC gives nothing for them."""
    j = read.join(head.select("key", F.col("version").alias("now")), "key", "left")
    return j.filter(~F.col("version").eqNullSafe(F.col("now"))).select("txn").distinct()


def commit(base: DataFrame, writes: DataFrame, abort: DataFrame, keys: list[str]) -> DataFrame:
    """base after the writes of the transactions that weren't aborted; writes(txn, kind, hlc, columns...) in hlc order."""
    ok = writes.join(abort, "txn", "left_anti")
    rest = [c for c in base.columns if c not in keys]
    last = ok.groupBy(*keys).agg(F.max_by(F.struct("kind", *rest), "hlc").alias("x")).select(*keys, "x.*")
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter("kind <> 'DELETE'").select(*base.columns))
