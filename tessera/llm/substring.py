"""Passages that recur across or within documents: the earliest ranked occurrence stays, the others go.

A word goes if it lies in a run of `least` words that occurs in an earlier text, by doc_id, or in a line of `least` or
more words that stands earlier in its own text. Words or short lines that a text repeats by itself aren't passages, and
stay. So the result depends on the texts alone, whatever else shares parts of a passage and however rows are dealt.

Not every run is compared. Of any `window` successive `window`-word grams of a text the one whose hash is least is an
anchor. All anchors inside a repeated run stand in its other occurrence too, so a first pass looks for anchors
that occur twice, and a second one compares only those runs all of whose anchors do, by digests. Runs are dealt
by their first and last anchors, so that neighbouring ones meet their repeats in one task and leave as one range.

Lines or paragraphs alone as units would miss what begins inside one; a repeated line is a repeated run all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordnum
from tessera.llm.common import map_batches, parts, small_batches, strings, with_doc_columns, without

WINDOW = 16
LEAST = 50
#: Units of a task that are held before they are handed on.
HELD = 2_000_000
#: Tasks (a power of two) that the runs between two anchors are dealt to: each task has them once, and a common passage is in most tasks.
SPREAD = 8
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Places of a row: word numbers (anchors), or pairs of them (ranges).
_PLACES = "doc long, key int, at array<int>"
_KINDS = {"d1": pa.int64(), "d2": pa.int64(), "doc": pa.int64(), "key": pa.int32(), "first": pa.int32(), "firsts": pa.list_(pa.int32()), "at": pa.list_(pa.int32())}
#: A run and the places of one text that it begins at (firsts), or ranges that are known to go (at).
_UNIT = "d1 long, d2 long, doc long, key int, firsts array<int>, at array<int>"
_FIELDS = ("d1", "d2", "doc", "key")
#: Names of our own beside the caller's columns.
_DOC, _KEY, _ANCHORS, _MARKS = "__tessera_doc", "__tessera_key", "__tessera_anchors", "__tessera_marks"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with two columns more, which name a distinct pair of doc_id and text: rows that repeat a doc_id with another text have another key."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return docs.withColumn(_DOC, F.col("doc_id").cast("long")).withColumn(_KEY, key)


def _mins(grams: np.ndarray, window: int) -> np.ndarray:
    return wordnum.slide(grams, window, np.minimum) if len(grams) >= window else grams[:0]


def anchors(words: np.ndarray, at: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, among the words of a batch, of the anchors of texts of `least` words and more, and the hashes of all grams."""
    grams = wordnum.gram_hashes(words, window)
    low = _mins(grams, window)
    inside = _inside(at, len(low), 2 * window - 1, least)
    # A gram is an anchor if one of the `window` minima over it, each within its text, is its own hash.
    edge = np.zeros(window - 1, np.uint64)
    high = wordnum.slide(np.concatenate((edge, np.where(inside, low, 0), edge)), window, np.maximum) if len(low) else grams[:0]
    # The greatest minimum over a gram is at most its hash, as each such window holds the gram.
    return np.flatnonzero(high == grams[: len(high)]), grams


def _inside(at: np.ndarray, n: int, span: int, least: int) -> np.ndarray:
    """Of n starts, those whose span of words lies in one text of at least `least` words."""
    step = np.zeros(n + 1, np.int64)
    starts, ends = at[:-1], at[1:] - span + 1
    on = (np.diff(at) >= least) & (ends > starts)
    np.add.at(step, starts[on], 1)
    np.add.at(step, ends[on], -1)
    return np.cumsum(step)[:n] > 0


def candidates(words: np.ndarray, at: np.ndarray, found: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of `least` words all of whose anchors are among the places `found`, a digest of their first and last anchors, and one of all words."""
    grams = wordnum.gram_hashes(words, window)
    known = np.full(len(grams), _TOP)
    known[found] = grams[found]
    low = _mins(grams, window)
    if len(words) < least:
        first = np.zeros(0, np.int64)
    else:
        lost = (_mins(known, window) != low).astype(np.uint8)
        first = np.flatnonzero((wordnum.slide(lost, least - 2 * window + 2, np.maximum) == 0) & _inside(at, len(words) - least + 1, least, least))
    d1 = wordnum.mix(low[first] * np.uint64(wordnum.BASES[0]) + low[first + least - 2 * window + 1])
    d2 = wordnum.mix(wordnum.span_sums(wordnum.mix(words), first, first + least, wordnum.BASES[0]))
    return first, d1.view(np.int64), d2.view(np.int64)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = wordnum.bounds(raw, offsets)
    return (wordnum.word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)), at, starts


def _new(*cols: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _batch(cols: dict[str, pa.Array], n: int, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[k], _KINDS[k]) if k in cols else pa.nulls(n, _KINDS[k]) for k in names], list(names))


def _lists(doc: np.ndarray, key: np.ndarray, at: np.ndarray, names: tuple[str, ...], each: bool = False) -> pa.RecordBatch:
    """A row for each (doc, key), which are sorted, with its entries of `at` (one or more columns) end to end; or a row for each entry."""
    heads = np.arange(len(doc)) if each else np.flatnonzero(_new(doc, key))
    width = at.shape[1] if at.ndim > 1 else 1
    lists = pa.ListArray.from_arrays(pa.array((np.append(heads, len(doc)) * width).astype(np.int32)), pa.array(at.ravel().astype(np.int32)))
    return _batch({"doc": doc[heads], "key": key[heads], "at": lists}, len(heads), names)


def _places(cols: dict[str, np.ndarray], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if len(cols["doc"]):
        order = np.lexsort((cols["first"], cols["key"], cols["doc"]))
        yield _lists(cols["doc"][order], cols["key"][order], cols["first"][order], names)


def _ranges(marks: dict[str, np.ndarray], names: tuple[str, ...], each: bool = False) -> Iterator[pa.RecordBatch]:
    """The ranges of each (doc, key), joined where one begins within the one before."""
    if len(marks["doc"]):
        order = np.lexsort((marks["hi"], marks["lo"], marks["key"], marks["doc"]))
        doc, key, lo, hi = (marks[k][order] for k in ("doc", "key", "lo", "hi"))
        head = np.flatnonzero(_new(doc, key) | np.concatenate(([True], lo[1:] > hi[:-1])))
        yield _lists(doc[head], key[head], np.stack((lo[head], np.maximum.reduceat(hi, head)), 1), names, each)


def _later(cols: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of runs sorted by digest and rank: which are their digest's first, which are of the same text as that, and the marks (doc, key, lo, hi) of the others."""
    new = _new(cols["d1"], cols["d2"])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = (cols["doc"] == cols["doc"][head]) & (cols["key"] == cols["key"][head])
    first = cols["first"][~own].astype(np.int64)
    return new, own, {"doc": cols["doc"][~own], "key": cols["key"][~own], "lo": first, "hi": first + least}


def repeated_lines(raw: np.ndarray, words: np.ndarray, starts: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of `least` or more words that stand earlier in the same text: the text of each, and its first and last word's places in the batch."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    line = np.cumsum(raw == 10)[starts]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    lo = np.flatnonzero(_new(line, text))
    hi = np.append(lo[1:], len(words))
    long = hi - lo >= least
    lo, hi = lo[long], hi[long]
    digests = [wordnum.mix(wordnum.span_sums(wordnum.mix(words), lo, hi, b)) for b in wordnum.BASES]
    order = np.lexsort((lo, *digests, text[lo]))
    lo, hi = lo[order], hi[order]
    again = ~_new(text[lo], *[d[order] for d in digests]) if len(lo) else np.zeros(0, bool)
    return text[lo[again]], lo[again], hi[again]


def _joined(many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([m[k] for m in many]) for k in many[0]}


def _identified(b: pa.RecordBatch, on: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """By parts of the batch's rows `on`: row numbers, ids, keys, word hashes, where each row's words begin among them, the bytes and each word's place there."""
    rows = np.flatnonzero(on)
    if not len(rows):
        return
    b = b.select(["text", _DOC, _KEY]).take(pa.array(rows))
    raw, offsets = strings(b["text"].cast(pa.string()))
    doc, key = (b[k].to_numpy(zero_copy_only=False) for k in (_DOC, _KEY))
    for i, j in parts(offsets):
        own = raw[offsets[i] : offsets[j]]
        words, at, starts = _words(own, offsets[i : j + 1] - offsets[i])
        yield rows[i:j], doc[i:j], key[i:j], words, at, own, starts


def repeated_anchors(docs: DataFrame, window: int, least: int) -> DataFrame:
    """(doc, key, at): word places of the anchors whose hash occurs twice or more. docs is keyed(); places can repeat."""
    names = ("d1", "doc", "key", "first", "at")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of a task. Those met twice here are known to repeat: of each such hash one row, without a place, goes on to meet others."""
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = _joined(held)
            order = np.argsort(cols["d1"], kind="stable")
            cols = {k: v[order] for k, v in cols.items()}
            new = _new(cols["d1"])
            many = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1
            yield _batch({k: np.where(many, -1, v)[new] if k == "first" else v[new] for k, v in cols.items()}, int(new.sum()), names)
            yield from _places({k: v[many] for k, v in cols.items()}, names)

        for b in batches:
            for _, doc, key, words, at, _, _ in _identified(b, ~np.asarray(b[_DOC].is_null())):
                place, grams = anchors(words, at, window, least)
                row = np.searchsorted(at, place, "right") - 1
                held.append({"d1": grams[place].view(np.int64), "doc": doc[row], "key": key[row], "first": (place - at[row]).astype(np.int32)})
                size += len(place)
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    found = docs.select(_DOC, _KEY, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(local, "d1 long, doc long, key int, first int, at array<int>")
    # Rows with `at` are known already: they travel beside the others, spread by document, and skip the comparison.
    dealt = found.repartition(F.when(F.col("at").isNull(), F.col("d1")).otherwise(F.xxhash64("doc", "key"))).sortWithinPartitions("d1")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        for b in batches:
            known = ~np.asarray(b["at"].is_null())
            if known.any():
                m = b.filter(pa.array(known))
                yield pa.RecordBatch.from_arrays([m["doc"], m["key"], m["at"]], ["doc", "key", "at"])
            u = b.filter(pa.array(~known))
            if not u.num_rows:
                continue
            cols = {k: u[k].to_numpy(zero_copy_only=False) for k in names[:-1]}
            if carry is not None:
                cols = {k: np.concatenate((carry[k], cols[k])) for k in cols}
            carry = {k: v[-1:] for k, v in cols.items()}  # what the next batch begins with may have the same hash
            same = ~_new(cols["d1"])
            twice = (same | np.append(same[1:], False)) & (cols["first"] >= 0)
            if twice.any():
                yield _lists(cols["doc"][twice], cols["key"][twice], cols["first"][twice], ("doc", "key", "at"), each=True)

    return dealt.mapInArrow(across, _PLACES)


def _by_row(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy(F.col("doc").alias("__tessera_d"), F.col("key").alias("__tessera_k")).agg(F.collect_set("at").alias(name)).hint("shuffle_hash")


def _with(docs: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """docs, all columns, so that both joins share one shuffle of them, beside the places of each row."""
    by_row = _by_row(places, name)
    return docs.join(by_row, (docs[_DOC] == by_row["__tessera_d"]) & (docs[_KEY] == by_row["__tessera_k"]), "left").drop("__tessera_d", "__tessera_k")


def repeated(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc long, key int, at array<int>): ranges of words, lo and hi by turns, of runs of `least` words that an earlier text has and of lines repeated in one text. docs is keyed(); ranges overlap."""
    small_batches(docs.sparkSession)
    window = max(1, min(window, (least + 1) // 2))
    names = (*_FIELDS, "firsts", "at")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a task. Those that an earlier text of the task has are known to go and need no shuffle, so that each
        digest reaches the shuffle once a task at most, with its places in one text, however common it is."""
        held: list[dict[str, np.ndarray]] = []
        lines: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = _joined(held)
            order = np.lexsort((cols["first"], *(cols[k] for k in reversed(_FIELDS))))
            cols = {k: v[order] for k, v in cols.items()}
            new, own, marks = _later(cols, least)
            of = np.flatnonzero(new[own])  # a digest's places in its first text stand behind one another
            if len(of):
                firsts = pa.ListArray.from_arrays(pa.array(np.append(of, int(own.sum())).astype(np.int32)), pa.array(cols["first"][own]))
                yield _batch({**{k: cols[k][new] for k in _FIELDS}, "firsts": firsts}, len(of), names)
            yield from _ranges(_joined([marks, *lines]), names)

        for b in batches:
            places = b[_ANCHORS]
            for rows, doc, key, words, at, raw, starts in _identified(b, ~np.asarray(places.is_null())):
                found = [places[i].values.flatten().to_numpy(zero_copy_only=False) + at[j] for j, i in enumerate(rows.tolist())]
                first, d1, d2 = candidates(words, at, np.concatenate(found), window, least)
                row = np.searchsorted(at, first, "right") - 1
                held.append({"d1": d1, "d2": d2, "doc": doc[row], "key": key[row], "first": (first - at[row]).astype(np.int32)})
                row, lo, hi = repeated_lines(raw, words, starts, at, least)
                lines.append({"doc": doc[row], "key": key[row], "lo": lo - at[row], "hi": hi - at[row]})
                size += len(first)
            if size > HELD:
                yield from flush()
                held, lines, size = [], [], 0
        if held:
            yield from flush()

    found = _with(docs, repeated_anchors(docs, window, least), _ANCHORS).mapInArrow(local, _UNIT)
    dealt = found.repartition(F.when(F.col("at").isNull(), F.xxhash64("d1", F.col("d2").bitwiseAND(SPREAD - 1))).otherwise(F.xxhash64("doc", "key"))).sortWithinPartitions(*_FIELDS)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        for b in batches:
            known = ~np.asarray(b["at"].is_null())
            if known.any():
                m = b.filter(pa.array(known))
                yield pa.RecordBatch.from_arrays([m["doc"], m["key"], m["at"]], ["doc", "key", "at"])
            u = b.filter(pa.array(~known))
            if not u.num_rows:
                continue
            many = np.diff(u["firsts"].offsets.to_numpy())
            cols = {k: np.repeat(u[k].to_numpy(zero_copy_only=False), many) for k in _FIELDS}
            cols["first"] = u["firsts"].flatten().to_numpy(zero_copy_only=False)
            if carry is not None:
                cols = {k: np.concatenate((carry[k], v)) for k, v in cols.items()}
            new, _, marks = _later(cols, least)
            head = int(np.flatnonzero(new)[-1])
            carry = {k: v[head : head + 1] for k, v in cols.items()}  # the last digest's first: later batches compare with it
            yield from _ranges(marks, ("doc", "key", "at"), each=True)

    return dealt.mapInArrow(across, _PLACES)


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined where they overlap or touch; sorted."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def _cut(text: str, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the word ranges, and what went as byte offsets of the UTF-8 text, with its count of words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = wordnum.bounds(raw, np.array([0, len(raw)]))
    hi = np.minimum(hi, len(starts))
    lo, hi = _union(lo[lo < hi], hi[lo < hi]) if (lo < hi).any() else (lo[:0], hi[:0])
    on = hi - lo >= least
    lo, hi = lo[on], hi[on]
    spans, keep, at = [], [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        s = int(starts[a])
        e = int(starts[b]) if b < len(starts) else len(raw)  # with the white space behind it
        keep.append(raw[at:s].tobytes())
        spans.append((s, e))
        at = e
    keep.append(raw[at:].tobytes())
    return b"".join(keep).decode("utf-8", "surrogatepass"), spans, int((hi - lo).sum())


def substring_dedup(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """docs with text rewritten, plus removed_spans array<struct<start,end>> (byte offsets in the original UTF-8 text)
    and removed_words long.

    Rows come back one for one. Null texts stay null, and texts that lose nothing stay as they are, bit for bit. The
    earliest occurrence is that with the least (doc_id, place). Rows without a doc_id have no rank: they neither keep
    nor lose anything. Rows that repeat a doc_id rank by a hash of their texts; where those are equal too,
    they count as one occurrence and come out alike. Columns of docs that have the names of the added ones are replaced.
    """
    docs = without(docs, "removed_spans", "removed_words")
    rows = keyed(docs)
    joined = _with(rows, repeated(rows, window, least), _MARKS)
    names = docs.columns
    schema = with_doc_columns(docs, [("removed_spans", "array<struct<start:int,end:int>>"), ("removed_words", "long")])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        spans, words = [[]] * b.num_rows, [0] * b.num_rows
        texts, marked = b["text"].to_pylist(), b[_MARKS]
        for i in np.flatnonzero(~np.asarray(marked.is_null())).tolist():
            lo, hi = marked[i].values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2).T
            if texts[i] is not None:
                texts[i], got, words[i] = _cut(texts[i], lo, hi, least)
                spans[i] = [{"start": s, "end": e} for s, e in got]
        cols = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(spans, span), pa.array(words, pa.int64())], [*names, "removed_spans", "removed_words"])

    return map_batches(joined, cut, schema)


def cleaned(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """docs' columns with texts rewritten, and n_chars, where there is one, counted anew for texts that changed."""
    names = docs.columns
    back = {c: f"__tessera_{c.lower()}" for c in names if c.lower() in ("removed_spans", "removed_words")}  # the caller's own, kept aside
    done = substring_dedup(docs.withColumnsRenamed(back), window, least)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{back.get(c, c)}`").alias(c) for c in names])
