"""Streaming forms over files. Each test ends by itself: a query is stopped when its sink has what is awaited, or at a deadline."""

import time

import pytest

from tessera.streaming import groups

TIME = "cast(t as timestamp) as t"


@pytest.fixture()
def run(spark, tmp_path):
    queries = []

    def start(rows, schema, fn, done=None, seconds=60, expr=None, mode="append"):
        """The sink's rows after one batch for each list of rows, or when done(rows) holds."""
        name = f"sink{len(queries)}_{tmp_path.name}".replace("-", "_")
        given = None
        for i, part in enumerate(rows):
            df = spark.createDataFrame(part, schema)
            df = df.selectExpr(*expr) if expr else df
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{i}")
            given = df.schema
        stream = spark.readStream.schema(given).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
        q = fn(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}_cp").start()
        queries.append(q)
        if done is None:
            q.processAllAvailable()
        else:
            end = time.monotonic() + seconds
            while time.monotonic() < end and q.isActive and not done(spark.table(name).collect()):
                time.sleep(0.3)
        q.stop()
        return spark.table(name).collect()

    yield start
    for q in queries:
        q.stop()


def test_consumer_group(run):
    rows = [[("k", 1, 0, False), ("k", 2, 0, False), ("k", 3, 0, False), ("j", 1, 0, False)]]
    got = run(rows, "key string, ms long, seq long, ack boolean", lambda s: groups.consume(s, ["a", "b"], 0))
    assert sorted((r.key, r.ms, r.consumer, r.deliveries) for r in got) == [("j", 1, "a", 1), ("k", 1, "a", 1), ("k", 2, "b", 1), ("k", 3, "a", 1)]


def test_consumer_group_redelivers_what_is_not_acknowledged(run):
    rows = [[("k", 1, 0, False), ("k", 2, 0, False), ("k", 1, 0, True)]]
    got = run(rows, "key string, ms long, seq long, ack boolean", lambda s: groups.consume(s, ["a", "b", "c"], 500), lambda r: any(x.deliveries > 1 for x in r))
    again = [(r.ms, r.consumer) for r in got if r.deliveries == 2]
    assert again == [(2, "c")] and not [r for r in got if r.ms == 1 and r.deliveries > 1]


def test_blocking_pops(run):
    rows = [[("k", 1, "pop", "x", 1), ("k", 2, "pop", "y", 2), ("j", 1, "push", "j1", 0)], [("k", 3, "push", "a", 0), ("k", 4, "push", "b", 0), ("k", 5, "push", "c", 0), ("j", 2, "pop", "z", 5)]]
    got = run(rows, "key string, seq long, kind string, value string, n long", groups.blocking_pops)
    assert sorted((r.key, r.client, r.value) for r in got) == [("j", "z", "j1"), ("k", "x", "a"), ("k", "y", "b")]
    right = run([[("k", i, "push", f"e{i}", 0) for i in range(4)] + [("k", 9, "pop", "x", 2)]], "key string, seq long, kind string, value string, n long", lambda s: groups.blocking_pops(s, left=False))
    assert sorted(r.value for r in right) == ["e2", "e3"]


def test_deduplicated(run):
    rows = [[("p", 1, "2024-01-01 00:00:00"), ("p", 1, "2024-01-01 00:00:05"), ("p", 2, "2024-01-01 00:00:06")]]
    got = run(rows, "producer string, iid long, t string", lambda s: groups.deduplicated(s, "t", "1 hour", ["producer", "iid"]), expr=["producer", "iid", TIME])
    assert sorted(r.iid for r in got) == [1, 2]


# A row is late by the watermark of two batches before it.
EVENTS = [[("u", "2024-01-01 00:00:01"), ("u", "2024-01-01 00:00:09"), ("v", "2024-01-01 00:00:11")], [("u", "2024-01-01 00:01:40")], [("u", "2024-01-01 00:01:41")], [("w", "2024-01-01 00:00:02"), ("w", "2024-01-01 00:10:00")]]


def test_windows_drop_late_rows(run):
    got = run(EVENTS, "k string, t string", lambda s: groups.windowed_counts(s, "t", "10 seconds", "5 seconds", ["k"]), expr=["k", TIME])
    assert sorted((r.start.second, r.k, r.n) for r in got if r.start.minute == 0) == [(0, "u", 2), (10, "v", 1)]
    slides = run(EVENTS[:1] + EVENTS[3:], "k string, t string", lambda s: groups.windowed_counts(s, "t", "10 seconds", "5 seconds", ["k"], "5 seconds"), expr=["k", TIME])
    assert sum(r.n for r in slides if r.k == "u") == 4


def test_sessions(run):
    got = run(EVENTS, "k string, t string", lambda s: groups.sessions(s, "t", "20 seconds", "5 seconds", ["k"]), expr=["k", TIME])
    assert sorted((r.k, r.n) for r in got if r.start.minute == 0) == [("u", 2), ("v", 1)]


def test_subscribed(run):
    rows = [[("news.a", "1"), ("news.b", "2"), ("other", "3")]]
    assert sorted(r.payload for r in run(rows, "channel string, payload string", lambda s: groups.subscribed(s, "news.*"))) == ["1", "2"]


def test_joined_streams(run):
    rows = [[("k", "2024-01-01 00:00:01", "l"), ("k", "2024-01-01 00:00:03", "r"), ("k", "2024-01-01 00:01:00", "r"), ("j", "2024-01-01 00:00:02", "r")]]
    fn = lambda s: groups.joined_streams(s.filter("side = 'l'").select("k", "t"), s.filter("side = 'r'").select("k", s.t.alias("u")), "k", "t", "u", "10 seconds", "1 minute")
    got = run(rows, "k string, t string, side string", fn, expr=["k", TIME, "side"])
    assert [(r.k, r.t.second, r.u.second) for r in got] == [("k", 1, 3)]
