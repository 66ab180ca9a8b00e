"""Subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its 3- to 5-character n-grams, with one blank on both sides; n-grams are hashed to rows of an
embedding matrix. A bag's vector is the mean over its words of the mean over their n-grams; logits are linear in it.
A text is cut into windows of `window` words, one by default; each class but the first takes the log of the sum of its
windows' odds, so that one window suffices and several add up. window 0 makes the whole text one bag: there a few words
drown in a long text, or a few letters decide a short one. Words never seen share n-gram vectors with seen ones.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np

from tessera.llm import wordnum

SIZES = (3, 4, 5)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass
class Settings:
    buckets: int = 1 << 17
    dims: int = 4
    window: int = 1
    epochs: int = 3
    batch: int = 64
    least_steps: int = 120  # few rows are gone through more often
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7
    subwords: bool = True  # False: each word is one feature, hashed whole


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, each between blanks, and the n + 1 places where texts begin."""
    joined = " " + " ".join(texts) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    raw[(raw >= 9) & (raw <= 13)] = 32
    return raw, np.cumsum([1, *[len(t) + 1 for t in texts]])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ink = raw != 32
    starts = np.flatnonzero(ink[1:] & ~ink[:-1]) + 1
    ends = np.flatnonzero(ink[:-1] & ~ink[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: where n-grams begin (a word's are in [start - 1, end)) and their buckets."""
    buckets = s.buckets
    if not s.subwords:
        whole = wordnum.mix(wordnum.span_sums(raw.astype(np.uint64), starts, ends, wordnum.BASES[0]))
        return [(starts - 1, (whole >> np.uint64(40)) & np.uint64(buckets - 1))]
    n = len(raw)
    room = np.zeros(n, np.int32)  # characters from here to the blank behind the word, that included
    size = (ends - starts + 2).astype(np.int64)
    at = np.repeat(starts - 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    room[at] = (np.repeat(ends + 1, size) - at).astype(np.int32)
    # A blank between two words ends one and begins the next: the later assignment, its beginning, holds.
    room[starts - 1] = (ends - starts + 2).astype(np.int32)
    out = []
    h = raw * _MUL[0]
    for k in range(1, max(SIZES)):
        m = n - k
        h = (h[:m] ^ (h[:m] >> np.uint32(15))) * _MUL[1] + raw[k:] * _MUL[2]
        if k + 1 in SIZES:
            on = np.flatnonzero(room[:m] >= k + 1)
            x = h[on]
            x = (x ^ (x >> np.uint32(13))) * _MUL[0]
            out.append((on, (x >> np.uint32(8)) & np.uint32(buckets - 1)))
    return out


def gram_count(length: np.ndarray, s: Settings) -> np.ndarray:
    return sum(np.maximum(length + 3 - k, 0) for k in SIZES) if s.subwords else np.ones(len(length), np.int64)


@dataclass
class Model:
    settings: Settings
    table: np.ndarray  # (buckets, classes): each n-gram's part in the logits, the embedding times the softmax weights
    bias: np.ndarray

    def logits(self, texts: list[str]) -> np.ndarray:
        """(texts, classes). Texts without words get the bias alone."""
        s, classes = self.settings, self.table.shape[1]
        out = np.tile(self.bias, (len(texts), 1))
        i = 0
        while i < len(texts):  # about a million characters at a time; a longer text stands alone
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= 1_000_000):
                chars += len(texts[j])
                j += 1
            raw, offsets = codes(texts[i:j])
            starts, ends, at = words(raw, offsets)
            if len(starts):
                parts = grams(raw, starts, ends, s)
                count = gram_count(ends - starts, s)
                doc = np.repeat(np.arange(j - i), np.diff(at))
                place = np.arange(len(starts)) - at[doc]
                for c in range(classes):
                    column = np.ascontiguousarray(self.table[:, c])
                    if not column.any():
                        continue
                    part = np.zeros(len(raw), np.float32)
                    for on, bucket in parts:
                        part[on] += column[bucket]
                    word = np.add.reduceat(part, starts - 1) / np.maximum(count, 1)
                    if s.window:
                        first = np.flatnonzero(place % s.window == 0)
                        bag = np.add.reduceat(word, first) / s.window
                        filled = np.flatnonzero(np.diff(at) > 0)
                        edge = np.searchsorted(doc[first], filled)
                        top = np.maximum.reduceat(bag, edge)
                        best = np.zeros(j - i)
                        best[filled] = top + np.log(np.add.reduceat(np.exp(bag - np.repeat(top, np.diff(np.append(edge, len(bag))))), edge))
                    else:
                        best = np.bincount(doc, word, minlength=j - i) / np.maximum(np.diff(at), 1)
                    has = np.diff(at) > 0
                    out[i:j][has, c] += best[has]
            i = j
        return out

    def posteriors(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, classes: int, settings: Settings, priors: np.ndarray | None = None) -> Model:
    """Adam in small batches on embeddings, softmax weights and biases together. Deterministic by the seed.

    priors: the classes' true shares; the biases are moved from the sample's shares to them. With windows there are two
    classes and class 1 is the one that a single window can show. Without rows, or with one class only, nothing is
    learnt and the biases are the priors alone.
    """
    share = np.bincount(labels, minlength=classes) / max(len(labels), 1) if len(labels) else np.full(classes, 1 / classes)
    priors = share if priors is None else priors
    shift = np.log(np.maximum(priors, 1e-6)) - np.log(np.maximum(share, 1e-6))
    rng = np.random.default_rng(settings.seed)
    emb = rng.normal(0, 0.02, (settings.buckets, settings.dims)).astype(np.float32)
    w = rng.normal(0, 1, (settings.dims, classes)).astype(np.float32)
    bias = np.log(np.maximum(share, 1e-6))
    if len(np.unique(labels)) < 2:
        return Model(settings, np.zeros((settings.buckets, classes), np.float32), np.log(np.maximum(priors, 1e-6)))
    # Texts are kept as numbers of their distinct words, and n-grams are made of those words alone.
    vocabulary: dict[str, int] = {}
    of, at = array("i"), np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        of.extend(vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(t.translate(_LOWER)))
        at[i + 1] = len(of)
    of = np.frombuffer(of, np.int32) if len(of) else np.zeros(0, np.int32)
    g_word, g_bucket, counts = [], [], []
    distinct = list(vocabulary)
    for i in range(0, len(distinct), 50_000):
        raw, offsets = codes(distinct[i : i + 50_000])
        starts, ends, _ = words(raw, offsets)
        word_at = np.zeros(len(raw), np.int32)
        word_at[starts - 1] = 1
        word_at = np.cumsum(word_at, dtype=np.int32) - 1 + i
        counts.append(np.maximum(gram_count(ends - starts, settings), 1))
        for on, bucket in grams(raw, starts, ends, settings):
            g_word.append(word_at[on])
            g_bucket.append(bucket.astype(np.int32))
    if not distinct:
        return Model(settings, np.zeros((settings.buckets, classes), np.float32), np.log(np.maximum(priors, 1e-6)))
    g_word, g_bucket = np.concatenate(g_word), np.concatenate(g_bucket)
    g_weight = (1.0 / np.concatenate(counts)).astype(np.float32)[g_word]
    used = np.unique(g_bucket)
    by = np.argsort(g_word, kind="stable").astype(np.int32)
    g_bucket, g_weight = np.searchsorted(used, g_bucket[by]).astype(np.int32), g_weight[by]
    g_from = np.searchsorted(g_word[by], np.arange(len(distinct) + 1))
    filled = np.flatnonzero(np.diff(at) > 0)
    even = 1.0 / np.maximum(np.bincount(labels[filled], minlength=classes), 1)
    even *= len(filled) / max(1, np.count_nonzero(np.bincount(labels[filled], minlength=classes)))
    bias, sub, w = np.zeros(classes), emb[used].astype(np.float64), w.astype(np.float64)
    m = [np.zeros_like(x) for x in (sub, w, bias)]
    v = [np.zeros_like(x) for x in (sub, w, bias)]
    step, shown = 0, 1 if settings.window else 0  # with windows, the first class is what none shows
    w[:, :shown] = 0
    for _ in range(max(settings.epochs, -(-settings.least_steps * settings.batch // len(filled)))):
        shuffled = rng.permutation(filled)
        for lot in range(0, len(shuffled), settings.batch):
            docs = np.sort(shuffled[lot : lot + settings.batch])
            size = np.diff(at)[docs]
            upto = np.cumsum(size) - size
            token = np.repeat(at[docs] - upto, size) + np.arange(int(size.sum()))
            word, tok = np.unique(of[token], return_inverse=True)
            grams_of = (g_from[1:] - g_from[:-1])[word]
            begin = np.cumsum(grams_of) - grams_of
            gram = np.repeat(g_from[word] - begin, grams_of) + np.arange(int(grams_of.sum()))
            bucket, weight = g_bucket[gram], g_weight[gram]
            g_of = np.repeat(np.arange(len(word)), grams_of)
            doc = np.repeat(np.arange(len(docs)), size)
            place = np.arange(len(token)) - upto[doc]
            bag_first = np.flatnonzero(place % settings.window == 0) if settings.window else upto
            bags = np.bincount(doc[bag_first], minlength=len(docs))
            edge = np.cumsum(bags) - bags
            bag_size = np.full(len(bag_first), settings.window) if settings.window else size
            bag_of = np.repeat(np.arange(len(bag_first)), np.diff(np.append(bag_first, len(token))))
            vectors = np.stack([np.bincount(g_of, sub[bucket, d] * weight, minlength=len(word)) for d in range(sub.shape[1])], 1)
            bag = np.add.reduceat(vectors[tok], bag_first, axis=0) / bag_size[:, None]
            z = bag @ w
            part = np.ones_like(z)
            if settings.window:
                top = np.maximum.reduceat(z, edge)
                odds = np.exp(z - np.repeat(top, bags, axis=0))
                total = np.add.reduceat(odds, edge)
                part = odds / np.repeat(total, bags, axis=0)
                z = top + np.log(total)
                z[:, 0] = 0
            logit = bias + z
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            p *= (even[labels[docs]] / len(docs))[:, None]
            on_bag = np.repeat(p, bags, axis=0) * part
            on_bag[:, :shown] = 0
            g_w = bag.T @ on_bag
            toward = (on_bag @ w.T) / bag_size[:, None]
            on_word = np.stack([np.bincount(tok, toward[bag_of, d], minlength=len(word)) for d in range(sub.shape[1])], 1)
            g_sub = np.stack([np.bincount(bucket, on_word[g_of, d] * weight, minlength=len(used)) for d in range(sub.shape[1])], 1)
            step += 1
            for x, g, mm, vv in zip((sub, w, bias), (g_sub, g_w, p.sum(0)), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                x -= settings.rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
            sub *= 1 - settings.decay
    if settings.window:
        w[:, 0] = 0
    table = np.zeros((settings.buckets, classes), np.float32)
    table[used] = sub @ w
    # Classes were weighted evenly, so the biases move from even shares to the true ones.
    return Model(settings, table, bias + np.log(np.maximum(priors, 1e-6)) - np.log(1 / classes) if priors is not None else bias + shift)
