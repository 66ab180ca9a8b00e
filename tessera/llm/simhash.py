"""SimHash fingerprints and their links by the generalised pigeonhole principle.

With the 64 bits dealt to m partitions and thresholds t_1..t_m (each -1 or more) that sum to
T - m + 1, two fingerprints within T bits differ by at most t_i bits in some partition i: otherwise
they differ by at least sum(t_i + 1) = T + 1 bits. The thresholds are free for each probing
fingerprint, so each takes those with the fewest candidates by the counted values of each partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, join_by_key, map_batches, settle, text_columns
from tessera.llm.components import components

BITS = 64
SEED = 42
SHINGLE = 4
#: Rows of one bucket that a task holds at once; buckets with more are dealt out in blocks.
BLOCK = 8_192
#: Pairs compared in one go.
PAIRS = 2_000_000
#: What a probe costs, in candidates.
PROBE_COST = 4.0
#: Rows to drop (two numbers each) that are broadcast to the texts; beyond it the texts are shuffled to them.
DROPPED_ROWS = 200_000
_ID, _HASH = "__tessera_id", "__tessera_hash"

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's k-word shingles; 0 for a text without words."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, hash): the fingerprint as a signed long, and a hash of the whole text. Every row of docs gets them; null texts count as empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, k) for t in b["text"].to_pylist()), np.uint64, b.num_rows)
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64)), b["hash"]], ["doc_id", "fp", "hash"])

    return map_batches(text_columns(docs).withColumn("hash", _text_hash()), run, "doc_id long, fp long, hash long")


# --- partitions of the bits -------------------------------------------------------------------


def co_occurrence(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bit i and bit j. 64 x 64 sums, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            on = bits_of(b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            total += (on.T @ on).astype(np.float64)
            n += len(on)
        flat = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "n"])

    got = dict(nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    return int(got.get(BITS * BITS, 0)), np.array([got.get(i, 0) for i in range(BITS * BITS)], np.float64).reshape(BITS, BITS)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partition_count(n: int, most: int, rows: float = 3.0) -> int:
    """The number of partitions with the least work for n evenly spread fingerprints: index rows, probes and candidates."""

    def work(m: int) -> float:
        width, spare = BITS / m, most - m + 1
        share = [spare // m + (i < spare % m) for i in range(m)] if spare >= 0 else [0] * (most + 1) + [-1] * (m - most - 1)
        probes = sum(sum(comb(int(width), d) for d in range(t + 1)) for t in share)
        return rows * (m + probes) + 0.05 * probes * n / 2**width

    return min(range(2, most + 2), key=work)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to m partitions of even width so that correlated bits share one: grown greedily from the strongest pair left."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        free = sorted(left)
        sub = corr[np.ix_(free, free)]
        own = [free[i] for i in np.unravel_index(int(sub.argmax()), sub.shape)] if size > 1 and len(free) > 1 else [free[0]]
        own = list(dict.fromkeys(own))
        while len(own) < size:
            rest = [i for i in free if i not in own]
            own.append(max(rest, key=lambda i: (corr[i, own].mean(), -i)))
        groups.append(sorted(own))
        left -= set(own)
    return groups


def project(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The group's bits of each fingerprint, packed from bit 0 up."""
    out = np.zeros(len(fps), np.uint64)
    for to, at in enumerate(group):
        out |= ((fps >> np.uint64(at)) & np.uint64(1)) << np.uint64(to)
    return out


# --- candidate counts and thresholds -----------------------------------------------------------


def halves(group: list[int]) -> list[list[int]]:
    """Blocks of at most 16 bits whose values are counted; the counts' size is bounded by that, not by the data."""
    k = -(-len(group) // 16)
    return [group[i * len(group) // k : (i + 1) * len(group) // k] for i in range(k)]


def value_counts(nodes: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """For each partition, the counts of the values of each of its blocks."""
    blocks = [b for g in groups for b in halves(g)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << len(b), np.int64) for b in blocks]
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for s, b in zip(sums, blocks, strict=True):
                s += np.bincount(project(fps, b).astype(np.int64), minlength=len(s))
        for i, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(s[at])], ["block", "v", "n"])

    got = nodes.select("fp").mapInArrow(run, "block long, v long, n long").groupBy("block", "v").agg(F.sum("n").alias("n")).toPandas()
    sums = [np.zeros(1 << len(b)) for b in blocks]
    for i, s in enumerate(sums):
        own = got[got.block == i]
        s[own.v.to_numpy()] = own.n.to_numpy()
    it = iter(sums)
    return [[next(it) for _ in halves(g)] for g in groups]


def within(counts: np.ndarray, most: int) -> list[np.ndarray]:
    """For d = 0..most: how many rows have a value at exactly d bits from each value."""
    width = int(len(counts)).bit_length() - 1
    at = np.arange(len(counts))
    ring = [counts.astype(np.float64)] + [np.zeros(len(counts)) for _ in range(most)]
    for bit in range(width):  # the standard recurrence over the bits of a hypercube
        flip = at ^ (1 << bit)
        ring = [ring[0]] + [ring[d] + ring[d - 1][flip] for d in range(1, most + 1)]
    return ring


class Estimator:
    """Candidates of a partition value within t bits: exact up to 16 bits, else blocks taken as independent."""

    def __init__(self, groups: list[list[int]], counts: list[list[np.ndarray]], n: int, most: int) -> None:
        self.groups, self.n, self.most = groups, max(n, 1), most
        self.rings = [[within(c, most) for c in cs] for cs in counts]

    def table(self, fps: np.ndarray) -> np.ndarray:
        """cost[i, t + 1, row]: work of threshold t in partition i; t = -1 costs nothing."""
        out = np.zeros((len(self.groups), self.most + 2, len(fps)))
        for i, g in enumerate(self.groups):
            exact = None
            for b, rings in zip(halves(g), self.rings[i], strict=True):
                v = project(fps, b).astype(np.int64)
                own = [r[v] for r in rings]
                exact = own if exact is None else [sum(exact[a] * own[d - a] for a in range(d + 1)) / self.n for d in range(self.most + 1)]
            probes = np.cumsum([comb(len(g), d) for d in range(self.most + 1)])
            out[i, 1:] = np.cumsum(exact, axis=0) + PROBE_COST * probes[:, None]
        return out


def allocate(cost: np.ndarray, most: int) -> np.ndarray:
    """Thresholds by dynamic programming: for each row the t_i >= -1 with sum most - m + 1 and the least total cost. (m, rows)."""
    m, levels, rows = cost.shape
    budget = most + 1  # sum of t_i + 1
    best = np.full((budget + 1, rows), np.inf)
    best[0] = 0
    choice = np.zeros((m, budget + 1, rows), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for used in range(budget + 1):
            for t in range(min(used, levels - 1) + 1):
                total = best[used - t] + cost[i, t]
                better = total < new[used]
                new[used][better] = total[better]
                choice[i, used][better] = t
        best = new
    out, used, at = np.zeros((m, rows), np.int8), np.full(rows, budget), np.arange(rows)
    for i in reversed(range(m)):
        out[i] = choice[i, used, at]
        used = used - out[i]
    return out - 1


def masks(width: int, most: int) -> list[np.ndarray]:
    """For d = 0..most the values with d of width bits set."""
    out = [np.zeros(1, np.uint64)]
    for _ in range(most):
        grown = (out[-1][:, None] | (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]).ravel()
        out.append(np.unique(grown[np.bitwise_count(grown) == len(out)]))
    return out


# --- links -------------------------------------------------------------------------------------


def _mixed(fps: np.ndarray, salt: int) -> np.ndarray:
    x = (fps ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(40)


def _least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links a-b: (node, least node) without the roots."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        new = root.copy()
        np.minimum.at(new, rx, low)
        np.minimum.at(new, ry, low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, root):
            break
        root = new
    on = root != np.arange(len(nodes))
    return nodes[on], nodes[root[on]]


def _solve(key: np.ndarray, probe: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows that are sorted by bucket, data before probes; a star forest of them."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    bucket = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    data = np.add.reduceat((~probe).astype(np.int64), first)
    p = np.flatnonzero(probe)
    reps = data[bucket[p]]
    p, reps = p[reps > 0], reps[reps > 0]
    links = []
    ends = np.cumsum(reps)
    i = 0
    while i < len(p):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        r = reps[i:j]
        left = np.repeat(p[i:j], r)
        right = np.repeat(first[bucket[p[i:j]]], r) + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
        a, b = fps[left], fps[right]
        ok = (np.bitwise_count(a ^ b) <= most) & (a != b)
        if ok.any():
            links.append(_least_labels(a[ok], b[ok]))
        i = j
    if not links:
        none = np.zeros(0, np.uint64)
        return none, none
    return _least_labels(*(np.concatenate(x) for x in zip(*links, strict=True))) if len(links) > 1 else links[0]


def links(nodes: DataFrame, most: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints whose components are those of all pairs of nodes(fp) within `most` bits.

    nodes must be distinct and settled. Each bucket gives a forest of its links, never all its pairs.
    """
    n, both = co_occurrence(nodes)
    groups = correlated_groups(n, both, partition_count(n, most))
    estimator = Estimator(groups, value_counts(nodes, groups), n, most)
    flips = [masks(len(g), most) for g in groups]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                cost = estimator.table(fps)
                t = allocate(cost, most)
                rows = []
                for i, g in enumerate(groups):
                    value = project(fps, g)
                    size = cost[i, 1] - PROBE_COST  # data rows under each value: counted or estimated
                    rows.append((i, fps, value, size, False))
                    for d in range(int(t[i].max()) + 1):
                        on = t[i] >= d
                        probes = (value[on][:, None] ^ flips[i][d][None, :]).ravel()
                        rows.append((i, np.repeat(fps[on], len(flips[i][d])), probes, None, True))
                for i, f, value, _, probe in rows:
                    v = [project_block(value, groups[i], k) for k in range(len(halves(groups[i])))]
                    filled = estimator.rings[i][0][0][v[0]]
                    for k in range(1, len(v)):
                        filled = np.minimum(filled, estimator.rings[i][k][0][v[k]])
                    if probe:  # a probe of an empty bucket finds nothing
                        f, value, filled = f[filled > 0], value[filled > 0], filled[filled > 0]
                    blocks = np.maximum(1, -(-filled // block)).astype(np.int64)
                    own = (_mixed(f, i + (77 if probe else 0)) % blocks.astype(np.uint64)).astype(np.int64)
                    # An item of a bucket of s blocks meets each of the s blocks of the other kind once.
                    f, value, own, s = (np.repeat(x, blocks) for x in (f, value, own, blocks))
                    other = np.arange(len(f)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    cell = np.where(probe, other * s + own, own * s + other)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(f), i, np.int32)), pa.array(value.view(np.int64)), pa.array(cell), pa.array(np.full(len(f), probe)), pa.array(f.view(np.int64))],
                        ["part", "value", "cell", "probe", "fp"],
                    )

    dealt = nodes.select("fp").mapInArrow(deal, "part int, value long, cell long, probe boolean, fp long")
    dealt = dealt.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell", "probe")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, probe, fps in whole_buckets(batches):
            a, b = _solve(key, probe, fps, most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(solve, "a long, b long").distinct()


def project_block(value: np.ndarray, group: list[int], k: int) -> np.ndarray:
    """Of a packed partition value, the bits of its k-th counted block."""
    hs = halves(group)
    at = sum(map(len, hs[:k]))
    return ((value >> np.uint64(at)) & np.uint64((1 << len(hs[k])) - 1)).astype(np.int64)


def whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Join sorted batches into larger ones that end where a bucket ends. A bucket has a bounded number of data rows;
    its probes, which may be more, come in several parts, each with the data rows before it."""
    held: list[tuple[np.ndarray, ...]] = []

    def columns(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def numbered(part: np.ndarray, value: np.ndarray, cell: np.ndarray) -> np.ndarray:
        new = np.concatenate(([False], (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (cell[1:] != cell[:-1])))
        return np.cumsum(new)

    size = 0
    for b in batches:
        held.append(tuple(b[c].to_numpy(zero_copy_only=False) for c in ("part", "value", "cell", "probe", "fp")))
        size += b.num_rows
        if size < rows:
            continue
        part, value, cell, probe, fp = columns(held)
        key = numbered(part, value, cell)
        cut = int(np.searchsorted(key, key[-1]))
        keep = slice(cut, None)
        yield key, probe.astype(bool), fp.view(np.uint64)  # the last bucket so far as well: its data rows stay for what follows
        last = [x[keep] for x in (part, value, cell, probe, fp)]
        data = ~last[3].astype(bool)
        held = [tuple(x[data] for x in last)]
        size = int(data.sum())
    if size:
        part, value, cell, probe, fp = columns(held)
        yield numbered(part, value, cell), probe.astype(bool), fp.view(np.uint64)


def classes(fps: DataFrame, most: int = 4) -> DataFrame:
    """fps(doc_id, fp, ...) with component_id, the least doc_id of the fingerprint's component, and keeper, its least (doc_id, hash).

    fps must be settled and have hash, a number of the row's text.
    """
    ranked = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))
    nodes = settle(fps.groupBy("fp").agg(F.min(ranked).alias("rep"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes, most))  # over fingerprints; their least is only a name
    named = settle(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("keeper"), F.count("*").alias("n"))
    # A component of many fingerprints, and a fingerprint of many documents (blank texts), are keys with many rows.
    sizes = named.agg(F.count("*"), F.sum("n")).first()
    of = settle(join_by_key(named.select("fp", "root", F.col("n").alias("rows")), least, "root", sizes[0]).select("fp", "keeper", F.col("rows").alias("n")), "classes")
    return join_by_key(fps, of, "fp", sizes[1] or 0).withColumn("component_id", F.col("keeper.doc_id"))


def near_duplicates(docs: DataFrame, most: int = 4, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): components of the documents whose fingerprints differ in at most `most` bits.

    One row for each row of docs. component_id is the least doc_id of the component. Null and blank texts have
    fingerprint 0 and are linked like others. A null doc_id never names a component unless it is all there is.
    Jobs run while the plan is made.
    """
    return classes(settle(fingerprints(docs, k), "fps"), most).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, most: int = 4, k: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that with the least doc_id, of rows that share it that with the least hash of its text.

    Of rows equal in doc_id and text one stays. Rows without a doc_id all stay, as nothing ranks them. Two rows of one
    doc_id with unlike texts are in two components, and both stay. Jobs run while the plan is made.
    """
    found = classes(settle(fingerprints(docs, k), "fps"), most).filter("doc_id IS NOT NULL")
    rows = found.groupBy("doc_id", "hash").agg(F.first("keeper").alias("keeper"), F.count("*").alias("n"))
    other = (F.col("keeper.doc_id") != F.col("doc_id")) | (F.col("keeper.hash") != F.col("hash"))
    marked = settle(rows.withColumn("goes", other).filter("goes OR n > 1").select(F.col("doc_id").alias(_ID), F.col("hash").alias(_HASH), "goes"), "dropped")
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(_ID), _text_hash().alias(_HASH))
    kept = keyed.join(bounded(marked.drop("goes"), DROPPED_ROWS), [_ID, _HASH], "left_anti")
    again = keyed.join(bounded(marked.filter("NOT goes").drop("goes"), DROPPED_ROWS), [_ID, _HASH], "left_semi").dropDuplicates([_ID, _HASH])
    return kept.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])
