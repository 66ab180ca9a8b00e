"""Toxicity scores by the subword model of subword.py."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import subword
from tessera.llm.common import give_back, map_batches, text_columns, with_doc_columns, without

#: Labelled rows of each label that training takes, by hash order of doc_id, and how many characters they may have in all.
SAMPLE_ROWS, SAMPLE_CHARS = 2_000, 40_000_000
THRESHOLD = 0.3
HELD_OUT = 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, values: int, rows: int, hold_out: int | None = HELD_OUT) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts and labels of at most `rows` labelled documents of each value, and the values' true shares among all usable labels.

    Ids are drawn first, by a hash, then their texts alone are fetched, whole and of any length; those that no longer fit
    SAMPLE_CHARS are left out, the last drawn first. So what reaches the driver is bounded by rows and SAMPLE_CHARS. Rows
    with a null id or label, or with a label outside 0..values - 1, are not used; of contradicting labels the largest is.
    Of rows that repeat a doc_id the text that is least by a hash is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter(f"id IS NOT NULL AND y >= 0 AND y < {values}")
    if hold_out is not None:
        known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != hold_out)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    share = dict(known.groupBy("y").count().collect())
    ids: list[tuple[int, int, int]] = []
    for y in sorted(share):
        drawn = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").select("id").limit(rows).collect()
        ids += [(r.id, y, n) for n, r in enumerate(drawn)]
    if not ids:
        return [], np.zeros(0, np.int64), np.full(values, 1 / values)
    drawn = F.broadcast(docs.sparkSession.createDataFrame(ids, "id long, y int, nth int"))
    texts = text_columns(docs).join(drawn, F.col("doc_id") == F.col("id"))
    sizes = texts.groupBy("id", "y", "nth").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("chars"))).alias("x")).select("id", "y", "nth", "x.*").collect()
    chosen, chars = [], 0
    for r in sorted(sizes, key=lambda r: (r.nth, r.y)):
        chars += r.chars
        if chars > SAMPLE_CHARS and chosen:
            break
        chosen.append((r.id, r.y, r.h))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, y int, h long")) if chosen else drawn.withColumn("h", F.lit(0)).limit(0)
    found = text_columns(docs).join(wanted, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h"))).select("id", "y", "text")
    got = sorted({r.id: (r.id, r.y, r.text) for r in found.toLocalIterator()}.values())
    counts = np.array([share.get(v, 0) for v in range(values)], float)
    return [t for _, _, t in got], np.array([y for _, y, _ in got], np.int64), counts / max(counts.sum(), 1)


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> subword.Model:
    """A model from the labelled rows outside the held-out fold. labels(doc_id, toxic)."""
    texts, y, share = labelled_sample(docs, labels, "toxic", 2, rows)
    model = subword.train(texts, y, 2, subword.Settings(), share)
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: subword.Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score double and toxic_predicted int, in place of columns of these names, row by row. Null and blank texts get the score of no evidence.

    Every word of a text counts; language, source and id play no part.
    """
    docs = without(docs, "score", "toxic_predicted")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = model.posteriors([t or "" for t in b["text"].to_pylist()])[:, 1]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*b.schema.names, "score", "toxic_predicted"])

    return map_batches(docs, run, with_doc_columns(docs, [("score", "double"), ("toxic_predicted", "int")]))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    scored = score_toxicity(text_columns(docs), train_toxicity(docs, labels))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", F.col("toxic_predicted").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with docs' columns; extra ones and their names don't matter."""
    model = train_toxicity(docs, labels)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = model.posteriors([t or "" for t in b["text"].to_pylist()])[:, 1]
        return b.filter(pa.array(p < threshold))

    return map_batches(docs, run, with_doc_columns(docs, []))
