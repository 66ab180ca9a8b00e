"""Importance resampling: log ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import wordnum
from tessera.llm.common import map_batches, parts, settle, small_batches, strings, text_columns

BUCKETS = 1 << 14


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of a batch of texts, and the text of each."""
    starts, ends, at = wordnum.bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = wordnum.word_hashes(raw, starts, ends)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = np.flatnonzero(text[1:] == text[:-1])
    pair = wordnum.mix(h[:-1] * np.uint64(wordnum.BASES[1]) + h[1:])[same]
    low = np.uint64(buckets - 1)
    return np.concatenate((h >> np.uint64(20) & low, pair >> np.uint64(20) & low)).astype(np.int64), np.concatenate((text, text[same]))


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all texts, and of those with in_target. docs(text, in_target)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            raw, offsets = strings(b["text"])
            on = b["in_target"].to_numpy(zero_copy_only=False).astype(bool)
            for i, j in parts(offsets):
                f, text = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                total[0] += np.bincount(f, minlength=buckets)
                total[1] += np.bincount(f[on[i:j][text]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    return docs.select("text", "in_target").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one count added to each; zeros where there is no target text."""
    rows = counts.toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[rows.bucket] += rows.raw
    target[rows.bucket] += rows.target
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def sortable(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def draws(ids: pa.Array, text: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 for each row, by its doc_id (null is an id of its own), the hash of its text, and seed."""
    none = np.asarray(ids.is_null()).astype(np.uint64)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    x = wordnum.mix(own * np.uint64(wordnum.BASES[0]) + none) + text.astype(np.int64).view(np.uint64) * np.uint64(wordnum.BASES[1]) + np.uint64(seed)
    return ((wordnum.mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_features, log_weight, key, order): key is log_weight plus a Gumbel draw by draws(). docs has hash, a number of the text."""
    buckets = len(ratios)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = strings(b["text"])
        weight, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
        for i, j in parts(offsets):
            f, text = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
            weight[i:j] = np.bincount(text, ratios[f], minlength=j - i)
            n[i:j] = np.bincount(text, minlength=j - i)
        u = draws(b["doc_id"], b["hash"].to_numpy(zero_copy_only=False), seed)
        key = weight - np.log(-np.log(u))
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(weight), pa.array(key), pa.array(sortable(key))], ["doc_id", "n_features", "log_weight", "gumbel_key", "order"])

    return map_batches(docs, run, "doc_id long, n_features long, log_weight double, gumbel_key double, order long")


def kth_largest(scored: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest `order` and how many rows with it are among the k: exact, 16 bits a job, 65,536 counts a job at most."""
    prefix, shift, left = None, 48, k
    while shift >= 0:
        rows = scored if prefix is None else scored.filter(F.shiftright("order", shift + 16) == prefix)
        digit = F.shiftright("order", shift)
        for value, n in sorted(rows.groupBy(digit.alias("v")).count().collect(), reverse=True):
            if n >= left:
                prefix = value
                break
            left -= n
        shift -= 16
    return prefix, left


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 5) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key and selected, for each row of docs: the top share of rows by key.

    The target model comes from all documents labelled quality 1; share defaults to their share among the labels. Texts
    without words have log_weight 0. Of rows with equal keys (rows equal in doc_id and text) just as many as fit are taken.
    Jobs run while the plan is made. Without labels nothing is told apart and half of the rows are drawn evenly.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q")).filter("id IS NOT NULL AND q IS NOT NULL").groupBy("id").agg(F.max("q").alias("q"))
    stats = known.agg(F.avg((F.col("q") == 1).cast("double"))).first()[0]
    share = (0.5 if stats is None else stats) if share is None else share
    target = known.filter("q = 1").select("id", F.lit(True).alias("t"))
    texts = text_columns(docs)
    flagged = texts.join(target.hint("shuffle_hash"), texts["doc_id"] == target["id"], "left").select("text", F.coalesce("t", F.lit(False)).alias("in_target"))
    ratios = log_ratios(ngram_counts(flagged))
    scored = settle(weigh(texts.withColumn("hash", F.xxhash64("text")), ratios, seed), "weights")
    k = int(round(share * scored.count()))
    if k <= 0:
        return scored.select("doc_id", "n_features", "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    at, left = kth_largest(scored, k)
    # Rows at the threshold itself: equal keys need equal ids, so these are repeats of one document.
    above = scored.filter(F.col("order") != at).withColumn("selected", F.col("order") > at)
    tied = scored.filter(F.col("order") == at).withColumn("selected", F.row_number().over(Window.partitionBy("order").orderBy("doc_id")) <= left)
    return above.unionByName(tied).select("doc_id", "n_features", "log_weight", "gumbel_key", "selected")
