"""Token ids packed into fixed-length rows: best-fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm import bpe
from tessera.llm.common import small_batches, text_columns

LENGTH = 2_048
#: Tokens that are packed together: a task packs blocks of about so many, so its memory doesn't follow its input.
BLOCK = 4_000_000
PAD = 50_256  # free in the rank files


class Capacities:
    """A segment tree over capacities 0..most: how many open rows have each. Finds the least capacity that is enough."""

    def __init__(self, most: int) -> None:
        self.size = 1 << int(most).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least capacity >= need that an open row has, or -1."""
        i, count = need + self.size, self.count
        if count[i]:
            return need
        while i > 1:  # up to the first right sibling with rows, then down its left edge
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into sizes (each 1..length): longest first, each into the fullest row that takes it."""
    tree, open_rows, rows = Capacities(length), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        free = tree.least(sizes[i])
        if free < 0:
            rows.append([i])
            at, free = len(rows) - 1, length
        else:
            at = open_rows[free].pop()
            tree.add(free, -1)
            rows[at].append(i)
        if free - sizes[i]:
            open_rows.setdefault(free - sizes[i], []).append(at)
            tree.add(free - sizes[i], 1)
    return rows


SCHEMA = "pack_id long, n_tokens int, ids array<int>, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack_block(ids: np.ndarray, offsets: np.ndarray, length: int, pad: int) -> list[np.ndarray]:
    """Flat columns of one block's rows: the id matrix, rows' token counts and segments; and for each segment its place, size, document (its number in the block) and start in it."""
    piece_from, piece_size, piece_doc, piece_start = [], [], [], []
    for d in range(len(offsets) - 1):
        a, b = int(offsets[d]), int(offsets[d + 1])
        for s in range(a, b, length):  # documents longer than a row go on in further pieces; nothing is dropped
            piece_from.append(s)
            piece_size.append(min(length, b - s))
            piece_doc.append(d)
            piece_start.append(s - a)
    rows = best_fit_decreasing(piece_size, length)
    order = np.array([i for r in rows for i in r], np.int64)
    per = np.array([len(r) for r in rows], np.int64)
    size = np.array(piece_size, np.int64)[order] if len(order) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), per)
    upto = np.cumsum(size) - size
    base = np.repeat(upto[np.cumsum(per) - per], per) if len(order) else upto
    place = upto - base
    matrix = np.full(len(rows) * length, pad, np.int32)
    step = np.arange(int(size.sum())) - np.repeat(upto, size)
    matrix[np.repeat(row * length + place, size) + step] = ids[np.repeat(np.array(piece_from, np.int64)[order] if len(order) else upto, size) + step]
    tokens = np.bincount(row, size, minlength=len(rows)).astype(np.int32)
    return [matrix, tokens, per, place, size, np.array(piece_doc, np.int64)[order] if len(order) else upto, np.array(piece_start, np.int64)[order] if len(order) else upto]


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, pad: int = PAD) -> DataFrame:
    """Packed rows of exactly `length` ids: pack_id, n_tokens, ids (padded at the end with `pad`), cu_seqlens (0 and
    the end of each segment), position_resets (where positions start again at 0: each segment's start, and the
    padding's), doc_ids and doc_starts (the segment's document and its first token's place there).

    Every token of every text is in just one row; texts without tokens are in none. A null doc_id stays null; rows that
    repeat a doc_id are packed each. Blocks of a task are packed by themselves, so only a block's last rows have slack.
    """
    path = path or bpe.rank_file()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            ids = np.concatenate([h[0] for h in held])
            offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(h[1]) for h in held]))))
            matrix, count, per, place, size, doc, start = pack_block(ids, offsets, length, pad)
            doc = pa.concat_arrays([h[2] for h in held]).take(pa.array(doc))
            rows = len(count)
            seg = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
            lists = lambda values, off, kind: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))
            ends = np.insert((place + size).astype(np.int32), seg[:-1], 0)
            padded = (count < length).astype(np.int64)
            resets = np.insert(place.astype(np.int32), seg[1:][padded > 0], count[padded > 0])
            out = pa.RecordBatch.from_arrays([
                pa.array(task + n + np.arange(rows)), pa.array(count), lists(matrix, np.arange(rows + 1) * length, pa.int32()),
                lists(ends, seg + np.arange(rows + 1), pa.int32()), lists(resets, seg + np.concatenate(([0], np.cumsum(padded))), pa.int32()),
                lists(doc, seg, pa.int64()), lists(start, seg, pa.int64()),
            ], _NAMES)
            n += rows
            return out

        for b in batches:
            ids, offsets = bpe.encode_column(b["text"], path)
            at = 0
            while at < b.num_rows:  # a block ends at the document that fills it
                to = min(b.num_rows, int(np.searchsorted(offsets, offsets[at] + BLOCK - tokens, "left")))
                to = max(to, at + 1)
                held.append((ids[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], b["doc_id"].slice(at, to - at)))
                tokens += int(offsets[to] - offsets[at])
                at = to
                if tokens >= BLOCK:
                    yield from slices(flush())
                    held, tokens = [], 0
        if tokens:
            yield from slices(flush())

    return text_columns(docs).mapInArrow(run, SCHEMA)


def slices(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def positions(resets: list[int], length: int) -> np.ndarray:
    """Position ids of a row: 0, 1, ... from each reset."""
    at = np.zeros(length, np.int64)
    at[resets] = resets
    return np.arange(length) - np.maximum.accumulate(at)


def write_binary(packed: DataFrame, path: str) -> None:
    """Packed rows as little-endian binaries, one Parquet row each: ids as unsigned 16 or 32 bits, the rest as signed 32."""

    def raw(lists: pa.Array, kind: str) -> list[bytes]:
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return [flat[i:j].astype(kind).tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = "<u2" if (b["ids"].flatten().to_numpy(zero_copy_only=False).max(initial=0)) < 1 << 16 else "<u4"
            yield pa.RecordBatch.from_arrays(
                [b["pack_id"], pa.array([kind] * b.num_rows), pa.array(raw(b["ids"], kind), pa.binary()), pa.array(raw(b["cu_seqlens"], "<i4"), pa.binary()), pa.array(raw(b["position_resets"], "<i4"), pa.binary())],
                ["pack_id", "dtype", "ids", "cu_seqlens", "position_resets"],
            )

    packed.select("pack_id", "ids", "cu_seqlens", "position_resets").mapInArrow(run, "pack_id long, dtype string, ids binary, cu_seqlens binary, position_resets binary").write.mode("overwrite").parquet(path)
