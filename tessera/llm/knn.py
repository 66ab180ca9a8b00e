"""Exact top-k by inner product: a Voronoi join of queries and data.

Queries and data are each grouped by their nearest pivot; a group's summary is its size, its mean c and its radius R. For a
query q of group (c, R) and a vector x of group (m, r), q.x lies within c.m +- (R |m| + r |c| + R r), and for x itself
within c.x +- R |x|. The first bounds give, from summaries alone, a score theta that k vectors reach for every query of
the group, and which data groups can matter to it at all; the others aren't read for it. The second raise theta and pick
the vectors that are sent to the group. Each meeting of a block of queries with a block of the vectors sent is solved by a
matrix product. No bound drops anything that could be among the k; where data don't cluster (evenly spread directions)
bounds exclude little, and the join is a block join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import map_batches, settle, small_batches, with_doc_columns

SCALE = 256
#: Groups of either side at most; about one for each GROUP_ROWS queries, and the root of the number of vectors.
GROUPS, GROUP_ROWS = 256, 256
#: Queries and vectors of one local product.
QUERY_BLOCK, DATA_BLOCK = 1_024, 65_536
#: What sums of rounded products may be off by, as a share of both lengths.
ROUNDING = 1e-12
#: What a bound may fall short of a threshold by, as a share of it, and still count.
SLACK = 1e-6


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component). Rows with a null id, a null vector or a null or non-finite component are left out.

    A component that is beyond a long after scaling is an error, as is a score beyond one.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = rows.filter("vec_id IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    return sound.select("vec_id", F.expr(f"transform(e, x -> if(abs({scale} * x) < 9223372036854775808D, floor({scale} * x), cast(raise_error('component beyond a long') AS bigint)))").alias("x"))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros, which changes no inner product."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where every partial sum is below 2**53, in longs below 2**63, else in integers of any size.

    Components are doubles, which hold floor(scale * component) exactly.
    """
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] if q.size and x.size else 0.0
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    return (q.astype(np.int64).astype(object) @ x.T.astype(np.int64).astype(object)).astype(np.int64)  # an OverflowError beyond a long


def _near(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argmin((pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), axis=1)


@dataclass
class Groups:
    """Pivots and what is known of the vectors nearest to each: how many, their mean and their radius about it (-1: none)."""

    pivots: np.ndarray
    count: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def drawn_pivots(table: DataFrame, dims: int, n: int) -> np.ndarray:
    """n vectors, at most GROUPS, by hash order: a bounded sample."""
    rows = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(GROUPS, n))).collect()
    return matrix(pa.array([r.x for r in rows], pa.list_(pa.int64())), dims)


def summaries(table: DataFrame, dims: int, pivots: np.ndarray) -> Groups:
    """Each group's size and mean, and then its radius, from sums and maxima that the executors make. table has x and g."""
    n = len(pivots)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, dims + 1))
        for b in batches:
            x = matrix(b["x"], dims)
            np.add.at(total, b["g"].to_numpy(zero_copy_only=False), np.column_stack((x, np.ones(len(x)))))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    got = dict(table.select("x", "g").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v")).collect())
    total = np.array([got.get(i, 0.0) for i in range(n * (dims + 1))]).reshape(n, dims + 1)
    centre = total[:, :dims] / np.maximum(total[:, dims:], 1)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(n, -1.0)
        for b in batches:
            own = b["g"].to_numpy(zero_copy_only=False)
            np.maximum.at(most, own, np.linalg.norm(matrix(b["x"], dims) - centre[own], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(most)], ["i", "v"])

    got = dict(table.select("x", "g").mapInArrow(far, "i long, v double").groupBy("i").agg(F.max("v")).collect())
    radius = np.array([got.get(i, -1.0) for i in range(n)])
    radius = np.where(radius < 0, radius, radius + ROUNDING * (np.linalg.norm(centre, axis=1) + radius))
    return Groups(pivots, total[:, dims].astype(np.int64), centre, radius)


def grouped(table: DataFrame, dims: int, pivots: np.ndarray, name: str) -> DataFrame:
    """table with g, the nearest pivot, settled; files are ordered by it, so that a filter on g skips what it leaves out."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(_near(matrix(b["x"], dims), pivots).astype(np.int32))], [*b.schema.names, "g"])

    return settle(map_batches(table, run, with_doc_columns(table, [("g", "int")])).sortWithinPartitions("g"), name)


def group_bounds(q: Groups, d: Groups) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of a pair of each query group and data group."""
    middle = q.centre @ d.centre.T
    reach = np.maximum(q.radius, 0)[:, None] * (np.linalg.norm(d.centre, axis=1) + np.maximum(d.radius, 0))[None, :] + np.linalg.norm(q.centre, axis=1)[:, None] * np.maximum(d.radius, 0)[None, :]
    return middle - reach, middle + reach


def reached(low: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """For each query group the k-th largest of low with each value standing count times; minus infinity where there are fewer."""
    order = np.argsort(-low, axis=1)
    upto = np.cumsum(count[order], axis=1)
    at = (upto < k).sum(1)
    value = np.take_along_axis(low, order, 1)
    return np.where(at < low.shape[1], value[np.arange(len(low)), np.minimum(at, low.shape[1] - 1)], -np.inf)


def can_matter(high: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return high + SLACK * (1 + np.abs(high)) >= theta


def thresholds(data: DataFrame, dims: int, q: Groups, near: np.ndarray, theta: np.ndarray, k: int) -> np.ndarray:
    """theta of each query group, raised to the k-th largest c.x - R |x| over the data groups near it."""
    n = len(q.pivots)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((n, k), -np.inf)
        for b in batches:
            x, own = matrix(b["x"], dims), b["g"].to_numpy(zero_copy_only=False)
            low = q.centre @ x.T - q.radius[:, None] * np.linalg.norm(x, axis=1)[None, :]
            low[~near[:, own]] = -np.inf
            top = -np.sort(-np.concatenate((top, low), axis=1), axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), k)), pa.array(top.ravel())], ["i", "v"])

    w = Window.partitionBy("i").orderBy(F.col("v").desc())
    rows = data.select("x", "g").mapInArrow(best, "i long, v double").withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("i", "v")
    got = dict(rows.collect())
    return np.maximum(theta, np.array([got.get(i, -np.inf) for i in range(n)]))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, ties to smaller ids."""
    if scores.shape[1] > k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        keep = np.flatnonzero((scores >= cut[:, None]).any(0))
        scores, ids = scores[:, keep], ids[:, keep] if ids.ndim == 2 else ids[keep]
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


MEETINGS = "i long, block long, s long, kind int, uid long, vec_id long, x array<long>"
_COLS = [c.split()[0] for c in MEETINGS.split(", ")]


def meetings(queries: DataFrame, data: DataFrame, k: int, dims: int, n_queries: int, n_data: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """What meets where: rows of cells (i, block, s), queries (kind 0, with their uid) and the vectors that may matter to them (kind 1).

    A cell is a query group, a block of its queries and a share of the vectors sent to the group, so that a group may hold
    any part of either side. queries has uid; both tables are settled.
    """
    asked, pivots = drawn_pivots(queries, dims, n_queries // group_rows), drawn_pivots(data, dims, isqrt(n_data))
    queries, data = grouped(queries, dims, asked, "queries"), grouped(data, dims, pivots, "vectors")
    q, d = summaries(queries, dims, asked), summaries(data, dims, pivots)
    low, high = group_bounds(q, d)
    theta = reached(low, d.count, k)
    near = can_matter(high, theta[:, None]) & (q.count > 0)[:, None] & (d.count > 0)[None, :]
    theta = thresholds(data, dims, q, near, theta, k)
    near &= can_matter(high, theta[:, None])
    q_blocks = -(-q.count // QUERY_BLOCK)
    shares = np.maximum(1, -(-(near @ d.count) // DATA_BLOCK))

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["g"].to_numpy(zero_copy_only=False).astype(np.int64)
            block = _spread(b["uid"].to_numpy(zero_copy_only=False), 7) % q_blocks[own]
            for s in range(int(shares[own].max()) if len(own) else 0):  # each block of queries meets each share of the vectors
                on = np.flatnonzero(shares[own] > s)
                some = b.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([pa.array(own[on]), pa.array(block[on]), pa.array(np.full(len(on), s)), pa.array(np.zeros(len(on), np.int32)), some["uid"], some["vec_id"], some["x"]], _COLS)

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            x, own = matrix(b["x"], dims), b["g"].to_numpy(zero_copy_only=False)
            norm = np.linalg.norm(x, axis=1)
            salt = _spread(b["vec_id"].to_numpy(zero_copy_only=False) + np.arange(row, row + len(x)), 9)  # repeated ids are spread, too
            row += len(x)
            for i in np.flatnonzero(near[:, np.unique(own)].any(1)).tolist():
                on = np.flatnonzero(near[i, own])
                on = on[can_matter(x[on] @ q.centre[i] + q.radius[i] * norm[on], theta[i])]
                if not len(on):
                    continue
                some = b.take(pa.array(on))
                for block in range(q_blocks[i]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), i)), pa.array(np.full(len(on), block)), pa.array(salt[on] % shares[i]), pa.array(np.ones(len(on), np.int32)), pa.array(np.zeros(len(on), np.int64)), some["vec_id"], some["x"]], _COLS)

    # Groups that no query is near aren't read.
    touched = data.filter(F.col("g").isin(np.flatnonzero(near.any(0)).tolist()))
    return queries.mapInArrow(send_queries, MEETINGS).union(touched.mapInArrow(send_data, MEETINGS))


def _spread(x: np.ndarray, shift: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32 + shift)).astype(np.int64)


FOUND = "uid long, query_id long, vec_id long, score long"


def solved(met: DataFrame, dims: int, k: int) -> DataFrame:
    """The k best vectors of each query in each cell of meetings()."""
    met = met.repartition("i", "block", "s").sortWithinPartitions("i", "block", "s", "kind")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asks, best = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            if best is not None:
                uid, own, _, scores, ids = best
                row = np.repeat(np.arange(len(uid)), scores.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(own[row]), pa.array(ids.ravel()), pa.array(scores.ravel())], ["uid", "query_id", "vec_id", "score"])

        for whole in batches:
            cols = [whole[c].to_numpy(zero_copy_only=False) for c in ("i", "block", "s", "kind")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, z in zip([0, *change.tolist()], [*change.tolist(), whole.num_rows], strict=True):
                if z <= a:
                    continue
                b, now = whole.slice(a, z - a), tuple(int(c[a]) for c in cols[:3])
                if now != key:
                    yield from close()
                    key, asks, best = now, [], None
                ids = b["vec_id"].to_numpy(zero_copy_only=False)
                if not cols[3][a]:
                    asks.append((b["uid"].to_numpy(zero_copy_only=False), ids, matrix(b["x"], dims)))
                    continue
                if not asks:
                    continue
                if best is None:
                    uid, own, x = (np.concatenate(c) for c in zip(*asks, strict=True))
                    best = (uid, own, x, np.zeros((len(uid), 0), np.int64), np.zeros((len(uid), 0), np.int64))
                uid, own, x, scores, have = best
                new = exact_products(x, matrix(b["x"], dims))
                best = (uid, own, x, *_top(np.concatenate((scores, new), 1), np.concatenate((have, np.broadcast_to(ids, new.shape)), 1), k))
        yield from close()

    return met.mapInArrow(solve, FOUND)


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of data for each row of queries, a row of its own vec_id left out.

    Both are integer_vectors(). Ties go to smaller vec_ids; fewer than k rows give what there is. Vectors of different
    lengths are compared as if padded with zeros. Of repeated rows each is a row: a query leaves out one row with its
    vec_id and vector, and equal query rows are answered each. Jobs run while the plan is made: both tables are settled,
    and the groups' summaries, some numbers a group, come to the driver.
    """
    small_batches(data.sparkSession)
    data, queries = settle(data, "vectors"), settle(queries.withColumn("uid", F.monotonically_increasing_id()), "queries")
    sizes = data.agg(F.count("*"), F.max(F.size("x"))).first()
    asked = queries.agg(F.count("*"), F.max(F.size("x"))).first()
    if not sizes[0] or not asked[0]:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(sizes[1], asked[1], 1)
    found = solved(meetings(queries, data, k + 1, dims, asked[0], sizes[0], group_rows), dims, k + 1)
    # One row of the query's own vec_id goes: the query itself, if it is among the k + 1 best.
    first = found.withColumn("same", F.row_number().over(Window.partitionBy("uid", "vec_id").orderBy(F.col("score").desc())))
    self_score = queries.select(F.col("uid").alias("u"), F.expr("aggregate(x, 0L, (a, v) -> a + v * v)").alias("own_score"))
    joined = first.join(self_score, F.col("uid") == F.col("u"))
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score"))
    dropped = joined.withColumn("nth", F.row_number().over(Window.partitionBy("uid").orderBy(mine.desc(), "same"))).filter(~(mine & (F.col("nth") == 1)))
    w = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return dropped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(d.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
