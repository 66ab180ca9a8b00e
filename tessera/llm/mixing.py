"""Mixing documents to target weights of soft domains.

A classifier learnt from a labelled table gives each document a posterior over domains. Nonnegative rates r are then
fitted so that the expected tokens of each domain, S_k = sum_d r_d tokens_d p_dk, match targets T_k, by projected
gradient on the squared misses: each step moves the rates along A' (S - T) in some metric and projects them on the
nonnegative ones, so they stay r = max(0, 1 - A' y) for K numbers y, the steps so far (A has the columns tokens_d p_d).
With the metric of A A' over the rows whose rate isn't 0 this is Newton's method and takes some ten passes; with a fixed
step it takes thousands. The end is, of all rates that meet the targets, those nearest to 1. Targets that no nonnegative
rates reach are met as closely as least squares can. A document's rate follows from its own few numbers and y, so a step is one distributed sum and
rates are never gathered. No rate is held down: a target for a domain that is all but absent repeats the few documents
with a trace of it as often as it takes. A domain of weight 0 has no target and takes no part in the fit.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import subword
from tessera.llm.common import give_back, map_batches, settle, text_columns, with_doc_columns, without
from tessera.llm.toxicity import labelled_sample

DOMAINS = ("low", "high", "toxic")
#: Target shares of tokens by domain.
WEIGHTS = {"low": 0.08, "high": 0.90, "toxic": 0.02}
SAMPLE_ROWS = 1_500
#: Passes after which a fit that goes on is an error, and the relative error at which it ends.
STEPS, EXACT = 100, 1e-9
#: Step lengths that one pass tries.
LENGTHS = 0.5 ** np.arange(10)
#: Weight of y'AA'y beside the totals: nothing where targets can be reached, and what keeps y finite where they can't.
SLACK = 1e-10
_log = logging.getLogger(__name__)


def domains_of(labels: DataFrame) -> DataFrame:
    """The labelled table with its domain as a number: toxic, else high or low quality. Rows with null marks have none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0).alias("domain"))


def train_domains(docs: DataFrame, labelled: DataFrame, classes: int, rows: int = SAMPLE_ROWS) -> subword.Model:
    """A linear softmax over averaged word vectors from at most `rows` labelled documents of each domain."""
    texts, y, share = labelled_sample(docs, labelled, "domain", classes, rows, hold_out=None)
    model = subword.train(texts, y, classes, subword.Settings(buckets=1 << 18, window=0, epochs=6, subwords=False), share)
    give_back()
    return model


def memberships(docs: DataFrame, model: subword.Model) -> DataFrame:
    """docs with n_tokens long and p array<double>: whitespace words and the posterior of each row. Columns of docs that have these names are replaced."""
    docs = without(docs, "n_tokens", "p")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b["text"].to_pylist()]
        p = model.posteriors(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]).astype(np.int32)), pa.array(p.ravel()))
        n = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(n), lists], [*b.schema.names, "n_tokens", "p"])

    return map_batches(docs, run, with_doc_columns(docs, [("n_tokens", "long"), ("p", "array<double>")]))


def _columns(b: pa.RecordBatch, k: int) -> np.ndarray:
    """A' for a batch: tokens times posteriors, in millions of tokens."""
    return b["p"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k) * (b["n_tokens"].to_numpy(zero_copy_only=False) / 1e6)[:, None]


def _rates(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(1.0 - a @ y, 0.0)


def _sums(members: DataFrame, k: int, trials: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each y: sum_d r_d a_d, sum_d a_d a_d' over rows of a positive rate, and half the sum of r_d squared. Few numbers a task."""
    n = k + k * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trials), n))
        for b in batches:
            a = _columns(b, k)
            for t, y in zip(total, trials, strict=True):
                r = _rates(a, y)
                on = a[r > 0]
                t[:k] += r @ a
                t[k:-1] += (on.T @ on).ravel()
                t[-1] += 0.5 * (r @ r)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

    got = dict(members.select("n_tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x")).collect())
    rows = np.array([got.get(i, 0.0) for i in range(len(trials) * n)]).reshape(-1, n)
    return [(x[:k], x[k:-1].reshape(k, k), float(x[-1])) for x in rows]


def fit_rates(members: DataFrame, weights: np.ndarray, tokens: float | None = None, most_steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, which gives the rates, the fitted domain totals and the targets (both in tokens). members must be settled.

    tokens: the mix's size; all there are if not given. Domains without weight, and those without tokens, have y = 0. It
    is an error if the fit hasn't converged after most_steps passes; targets that are missed as none can reach them are logged.
    """
    k = len(weights)
    asked = weights > 0
    y = np.zeros(k)
    s, gram, half = _sums(members, k, [y])[0]
    target = weights / weights.sum() * (s.sum() if tokens is None else tokens / 1e6)
    whole = gram[np.ix_(asked, asked)]
    # What lies in no document's reach, as with equal posteriors throughout, can't be approached by any step.
    aim = whole @ np.linalg.pinv(whole, rcond=1e-10) @ target[asked]

    def slope(y: np.ndarray, s: np.ndarray) -> np.ndarray:
        return s[asked] - aim - SLACK * (whole @ y[asked])

    def height(y: np.ndarray, half: float) -> float:
        return half + aim @ y[asked] + SLACK / 2 * (y[asked] @ whole @ y[asked])

    end = EXACT * max(target.sum(), 1e-12)
    for _ in range(most_steps):
        g = slope(y, s)
        if np.abs(g).sum() <= end:
            break
        step = np.zeros(k)
        step[asked] = np.linalg.pinv(gram[np.ix_(asked, asked)] + SLACK * whole, rcond=1e-14, hermitian=True) @ g
        trials = [y + x * step for x in LENGTHS]
        found = _sums(members, k, trials)
        i = 0 if np.abs(slope(trials[0], found[0][0])).sum() <= np.abs(g).sum() / 2 else int(np.argmin([height(t, f[2]) for t, f in zip(trials, found, strict=True)]))
        y, (s, gram, half) = trials[i], found[i]
    else:
        raise RuntimeError(f"Mixing rates haven't converged after {most_steps} steps: tokens {(s * 1e6).round(1).tolist()}, targets {(target * 1e6).round(1).tolist()}")
    missed = np.abs(s - target)[asked].sum() > 1e-6 * max(target.sum(), 1e-12)
    _log.log(logging.WARNING if missed else logging.INFO, "Mixing: tokens %s, targets %s", (s * 1e6).round(1).tolist(), (target * 1e6).round(1).tolist())
    return y, s * 1e6, target * 1e6


def _copies(y: np.ndarray, seed: int) -> tuple[Column, Column]:
    """The rate of a row of memberships(), and its copies: the rate rounded up or down by a hash of doc_id and seed, so that its mean is the rate."""
    lowered = sum((F.col("p")[i] * (F.col("n_tokens") / 1e6) * float(v) for i, v in enumerate(y)), F.lit(0.0))
    rate = F.greatest(F.lit(1.0) - lowered, F.lit(0.0))
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    return rate, F.floor(rate + draw)


def mixed(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, weights: dict[str, float] = WEIGHTS, tokens: float | None = None, seed: int = 11) -> DataFrame:
    """doc_id, n_tokens, the posterior of each domain (p_<name>), rate double and copies long, for each row of docs.

    copies rounds the rate up or down at random, by a hash of doc_id and seed, so that its mean is the rate. Texts
    without words have no tokens: their rate stays 1. Rows that repeat a doc_id, or have none, share a draw; each has the
    rate of its own text. labelled has doc_id and domain (0..K-1); without any usable label the posteriors are even.
    Jobs run while the plan is made.
    """
    members = settle(memberships(text_columns(docs), train_domains(docs, labelled, len(domains))).drop("text"), "members")
    y, _, _ = fit_rates(members, np.array([weights[d] for d in domains], float), tokens)
    rate, copies = _copies(y, seed)
    return members.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"), copies.alias("copies"))


def mix_documents(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, weights: dict[str, float] = WEIGHTS, tokens: float | None = None, seed: int = 11) -> DataFrame:
    """docs with each row as often as mixed() says; docs' columns only. Rows without a doc_id stay once.

    Texts are settled beside their posteriors, so that rates meet them without a join.
    """
    names = docs.columns
    own = {c: f"__tessera_{c.lower()}" for c in names if c.lower() in ("n_tokens", "p")}  # the caller's columns, kept aside
    members = settle(memberships(docs.withColumnsRenamed(own), train_domains(docs, labelled, len(domains))), "members")
    y, _, _ = fit_rates(members, np.array([weights[d] for d in domains], float), tokens)
    _, copies = _copies(y, seed)
    times = F.when(F.col("doc_id").isNull(), 1).otherwise(copies).cast("int")
    return members.filter(times > 0).withColumn("__tessera_copy", F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in names])
