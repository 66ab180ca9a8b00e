"""Structured Streaming forms: dedup of idempotent producers, windows, fan-out, and consumer groups on keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import glob_regex


def deduplicated(stream: DataFrame, time: str, window: str, keys: list[str]) -> DataFrame:
    """The first message of each producer id within the window; state is bounded by it."""
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def subscribed(stream: DataFrame, pattern: str, channel: str = "channel") -> DataFrame:
    return stream.filter(F.col(channel).rlike(glob_regex(pattern)))


DELIVERED = "key string, consumer string, ms long, seq long, deliveries long"
_STATE = "next long, pending array<struct<ms:long,seq:long,consumer:string,at:long,n:long>>"


def consume(stream: DataFrame, consumers: list[str], redeliver_ms: int) -> DataFrame:
    """A consumer group for each key of stream(key, ms, seq, ack boolean): a new entry goes to the next consumer in turn and
    is pending; a row with ack takes it off; entries pending longer than redeliver_ms are delivered again to another one
    (XREADGROUP, XACK, XAUTOCLAIM). State is one group's pending list, in the state store. With redelivery the query wakes
    by the clock and never runs out of work; without it (redeliver_ms 0) it rests when the source does."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, held = state.get if state.exists else (0, [])
        pending = {(p["ms"], p["seq"]): dict(p.asDict() if hasattr(p, "asDict") else p) for p in held}
        now = state.getCurrentProcessingTimeMs() if redeliver_ms > 0 else 0
        out = []

        def deliver(ms: int, seq: int, n: int) -> None:
            nonlocal turn
            consumer = consumers[turn % len(consumers)]
            turn += 1
            pending[ms, seq] = {"ms": ms, "seq": seq, "consumer": consumer, "at": now, "n": n}
            out.append((key[0], consumer, ms, seq, n))

        rows = sorted((int(m), int(s), bool(a)) for b in batches for m, s, a in zip(b.ms, b.seq, b.ack, strict=True))
        for ms, seq, ack in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
            if ack:
                pending.pop((ms, seq), None)
            else:
                deliver(ms, seq, 1)
        for p in sorted((p for p in pending.values() if now - p["at"] >= redeliver_ms > 0), key=lambda p: (p["ms"], p["seq"])):
            deliver(p["ms"], p["seq"], p["n"] + 1)
        state.update((turn, [(p["ms"], p["seq"], p["consumer"], p["at"], p["n"]) for p in pending.values()]))
        if pending and redeliver_ms > 0:
            oldest = min(p["at"] for p in pending.values())
            state.setTimeoutDuration(max(1, oldest + redeliver_ms - now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DELIVERED.split(", ")])

    return stream.groupBy("key").applyInPandasWithState(step, DELIVERED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if redeliver_ms > 0 else GroupStateTimeout.NoTimeout)


POPPED = "key string, client string, seq long, value string"
_QUEUE = "queue array<struct<seq:long,value:string>>, waiting array<struct<seq:long,client:string,n:long>>"


def blocking_pops(stream: DataFrame, left: bool = True) -> DataFrame:
    """BLPOP, BRPOP, BLMPOP and their kin over stream(key, seq, kind, value, n): rows of kind `push` bring an element, rows of
    kind `pop` a client (value) that waits for up to n elements. Clients are served in order of seq, as soon as their key
    has an element, by one row (key, client, seq, value) for each; what isn't popped stays, what waits goes on waiting.
    seq orders a key's rows within a batch; for sorted sets push in score order. State is one key's queue."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, waiting = ([tuple(x) for x in part or []] for part in (state.get if state.exists else ([], [])))
        out = []
        rows = sorted((int(s), str(k), v, int(n)) for b in batches for s, k, v, n in zip(b.seq, b.kind, b.value, b.n, strict=True))
        for seq, kind, value, n in rows:
            if kind == "push":
                queue.append((seq, value))
            else:
                waiting.append((seq, value, n))
            while queue and waiting:
                _, client, want = waiting.pop(0)
                for _ in range(min(want, len(queue))):
                    at, element = queue.pop(0 if left else -1)
                    out.append((key[0], client, at, element))
        state.update((queue, waiting))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in POPPED.split(", ")])

    return stream.groupBy("key").applyInPandasWithState(step, POPPED, _QUEUE, "append", GroupStateTimeout.NoTimeout)


def joined_streams(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Inner join of two streams on a key, of rows at most `within` apart; the watermarks bound what is kept."""
    a, b = left.withWatermark(left_time, late).alias("a"), right.withWatermark(right_time, late).alias("b")
    gap = F.expr(f"INTERVAL {within}")
    near = (F.col(f"b.{right_time}") >= F.col(f"a.{left_time}") - gap) & (F.col(f"b.{right_time}") <= F.col(f"a.{left_time}") + gap)
    return a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & near).select(F.col(f"a.{on}").alias(on), F.col(f"a.{left_time}").alias(left_time), F.col(f"b.{right_time}").alias(right_time))
