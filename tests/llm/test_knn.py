"""The kNN join against brute force, with ties, repeats, bad vectors and few rows."""

import numpy as np
import pytest

from tessera.llm import knn


def brute(rows, k):
    out = []
    for i, (q, x) in enumerate(rows):
        if q % 3:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), v) for j, (v, y) in enumerate(rows) if j != i)[:k]
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("group_rows", "block"), [(256, 1_024), (5, 7)])
def test_equals_brute_force(spark, monkeypatch, group_rows, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "DATA_BLOCK", 100 if block == 7 else 65_536)
    rng = np.random.default_rng(1)
    raw = [(i, rng.normal(0, 0.3, 8).round(2).tolist()) for i in range(250)]
    raw += [(300, raw[0][1]), (301, raw[0][1]), (303, [0.0] * 8), (306, [1.0, 2.0]), (309, [])]
    table = spark.createDataFrame([(*r, 1) for r in raw] + [(401, None, 1), (402, [1.0, None], 1), (403, [float("nan")] * 8, 1), (405, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)], "vec_id long, embedding array<double>, score int")
    vectors = knn.integer_vectors(table)
    rows = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in raw]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(vectors.filter("vec_id % 3 = 0"), vectors, 5, group_rows).collect())
    assert got == brute(rows, 5)


def test_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    v = knn.integer_vectors(table)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in knn.top_k(v, v).collect()) == [(0, 1, 3), (3, 1, 0)]
    assert knn.top_k(v.limit(0), v).count() == 0 and knn.top_k(v, v.limit(0)).count() == 0


def test_repeated_rows_are_rows(spark):
    v = knn.integer_vectors(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in knn.top_k(v.filter("vec_id = 0"), v).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]


def test_large_components_keep_their_value(spark):
    raw = [(0, [1.0, -0.5]), (3, [1e7, 2.0]), (1, [5_000.0, 0.25]), (2, [8_000.0, 0.0]), (4, [-6_000.0, 0.0]), (5, [-5_000.0, 9_000.0]), (7, [5_000.0, -1e6])]
    vectors = knn.integer_vectors(spark.createDataFrame(raw, "vec_id long, embedding array<float>"))
    rows = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in raw]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(vectors.filter("vec_id % 3 = 0"), vectors, 5, 1).collect())
    assert got == brute(rows, 5)


def test_products_are_exact_or_an_error():
    q = np.array([[2.0**40, 3.0], [2.0**33, 1.0]])
    assert knn.exact_products(q, np.array([[2.0**22, 1.0], [-(2.0**22), 7.0]])).tolist() == [[2**62 + 3, 21 - 2**62], [2**55 + 1, 7 - 2**55]]
    with pytest.raises(OverflowError):
        knn.exact_products(q, np.array([[2.0**23, 1.0]]))


def test_extreme_ids(spark):
    ids = [-(1 << 63), -(1 << 62) - 5, (1 << 63) - 1, 0, 3]
    vectors = knn.integer_vectors(spark.createDataFrame([(i, [float(n + 1), 0.5]) for n, i in enumerate(ids)], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(vectors.filter("vec_id = 0 OR vec_id = 3"), vectors, 4).collect())
    x = {i: [256 * (n + 1), 128] for n, i in enumerate(ids)}
    want = []
    for q in (0, 3):
        scored = sorted((-sum(a * b for a, b in zip(x[q], x[v], strict=True)), v) for v in ids if v != q)
        want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored)]
    assert got == want


def test_bounds_leave_out_what_cannot_matter(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 16))
    centres *= 100 / np.linalg.norm(centres, axis=1)[:, None]
    raw = [(i, (centres[i % 20] + rng.normal(0, 0.5, 16)).tolist()) for i in range(4_000)]
    vectors = knn.settle(knn.integer_vectors(spark.createDataFrame(raw, "vec_id long, embedding array<double>")), "v")
    queries = knn.settle(vectors.filter("vec_id % 21 = 0").withColumn("uid", knn.F.monotonically_increasing_id()), "q")
    n = queries.count()
    sent = knn.meetings(queries, vectors, 6, 16, n, 4_000, 10).groupBy("kind").count().collect()
    sent = {r.kind: r["count"] for r in sent}
    groups = max(1, n // 10)
    assert sent[0] == n and sent[1] < 0.25 * groups * 4_000
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(vectors.filter("vec_id % 21 = 0"), vectors, 5, 10).collect())
    x = np.floor(256 * np.array([v for _, v in raw])).astype(np.int64)
    want = []
    for q in range(0, 4_000, 21):
        s = x @ x[q]
        best = sorted((-int(s[v]), v) for v in np.argsort(-s)[:20].tolist() if v != q)[:5]
        want += [(q, r + 1, v, -sc) for r, (sc, v) in enumerate(best)]
    assert got == want


def test_group_bounds_hold():
    rng = np.random.default_rng(5)
    for spread in (0.1, 3.0):
        a, b = rng.normal(0, 1, 6) + rng.normal(0, spread, (40, 6)), rng.normal(0, 1, 6) + rng.normal(0, spread, (50, 6))
        groups = [knn.Groups(v[:1], np.array([len(v)]), v.mean(0)[None], np.linalg.norm(v - v.mean(0), axis=1).max()[None]) for v in (a, b)]
        low, high = knn.group_bounds(*groups)
        assert low[0, 0] <= (a @ b.T).min() and (a @ b.T).max() <= high[0, 0]
    assert knn.reached(np.array([[3.0, 1.0, 2.0]]), np.array([2, 5, 0]), 2).tolist() == [3.0]
    assert knn.reached(np.array([[3.0, 1.0, 2.0]]), np.array([2, 5, 0]), 3).tolist() == [1.0]
    assert knn.reached(np.array([[3.0, 1.0, 2.0]]), np.array([2, 5, 0]), 8).tolist() == [-np.inf]
