"""Byte-level BPE by the tiktoken library with a local rank file."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from tessera.llm import wordnum
from tessera.llm.common import int_lists, map_batches, parts, strings, text_columns, with_doc_columns, without

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Runs without a safe boundary that are longer than this are cut into matches here, not by the library's pattern engine.
LONG = 20_000
#: Distinct segments whose ids a worker remembers; beyond it starts anew.
REMEMBERED = 600_000
#: Bytes of segments that the library gets at once.
PIECE = 400_000

# White space as the library's pattern engine has it (the Unicode property), not as Python's \s (which adds 1C-1F).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def safe_cuts(raw: np.ndarray) -> np.ndarray:
    """Byte places where ASCII white space follows something else than white space.

    Each match that holds a character other than white space ends before the next white space, and no match looks
    behind: so a text cut at such places has the same matches as the whole text.
    """
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    wide = at[raw[at - 1] >= 0x80]
    if len(wide):
        one, two = raw[wide - 1], raw[np.maximum(wide - 2, 0)]
        three = raw[np.maximum(wide - 3, 0)]
        blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        blank |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
        blank |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
        blank |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
        blank |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
        if blank.any():
            at = at[~np.isin(at, wide[blank])]
    return at


class Codec:
    """Encodes and decodes as tiktoken.Encoding(pat_str=PATTERN, special_tokens={}) does, in bounded memory on any text."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.names = [str(i) for i in range(self.library.n_vocab)]
        self.sizes = np.zeros(self.library.n_vocab, np.int64)
        self.sizes[list(ranks.values())] = [len(k) for k in ranks]
        self.forget()

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0]

    def encode_all(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's offsets in them. Equal segments are encoded once and remembered."""
        cuts = safe_cuts(raw)
        bounds = np.sort(np.concatenate((cuts, offsets)), kind="stable")
        bounds = bounds[np.concatenate(([True], bounds[1:] != bounds[:-1]))]
        if len(bounds) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start, end = bounds[:-1], bounds[1:]
        key = wordnum.mix(wordnum.span_sums(raw.astype(np.uint64) + np.uint64(1), start, end, wordnum.BASES[0]))
        check = (end - start) << 16 | raw[(start + end) >> 1].astype(np.int64) << 8 | raw[end - 1]
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        first, of = order[new], np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        u = ranked[new]
        if not np.array_equal(check[first[of]], check):  # two segments share a hash: this batch is encoded one by one
            each = [self.library.encode_ordinary(raw[a:b].tobytes().decode()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            upto = np.concatenate(([0], np.cumsum([len(x) for x in each])))
            return np.array([i for x in each for i in x], np.int32), upto[np.searchsorted(bounds, offsets)]
        at = np.minimum(np.searchsorted(self.key, u), max(0, len(self.key) - 1))
        hit = (self.key[at] == u) & (self.check[at] == check[first]) if len(self.key) else np.zeros(len(u), bool)
        begin, size = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        begin[hit], size[hit] = self.begin[at[hit]], self.size[at[hit]]
        miss = np.flatnonzero(~hit)
        ids, size[miss] = self._encode_each(raw, start[first[miss]], end[first[miss]], cuts)
        begin[miss] = len(self.ids) + np.cumsum(size[miss]) - size[miss]
        table = np.concatenate((self.ids, ids))
        n = size[of]
        upto = np.concatenate(([0], np.cumsum(n)))
        out = table[np.repeat(begin[of] - upto[:-1], n) + np.arange(upto[-1])]
        if len(self.key) + len(miss) <= REMEMBERED:
            keys = np.concatenate((self.key, u[miss]))
            by = np.argsort(keys, kind="stable")
            self.key, self.ids = keys[by], table
            self.check = np.concatenate((self.check, check[first[miss]]))[by]
            self.begin, self.size = np.concatenate((self.begin, begin[miss]))[by], np.concatenate((self.size, size[miss]))[by]
        else:
            self.forget()
        return out, upto[np.searchsorted(bounds, offsets)]

    def forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encode_each(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments end to end, and how many each has. Those between two safe cuts can stand in a row for the library."""
        blank = (raw[s] == 32) | ((raw[s] >= 9) & (raw[s] <= 13)) if len(s) else np.zeros(0, bool)
        plain = blank & (e - s <= LONG)
        plain[plain] = cuts[np.minimum(np.searchsorted(cuts, e[plain]), max(0, len(cuts) - 1))] == e[plain] if len(cuts) else False
        counts = np.zeros(len(s), np.int64)
        lists: list[np.ndarray] = []
        row, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        size = np.cumsum(e[row] - s[row])
        i = 0
        while i < len(row):
            done = int(size[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(size, done + PIECE, "right")))
            at = np.repeat(s[row[i:j]] - np.concatenate(([0], size[i : j - 1] - done)), e[row[i:j]] - s[row[i:j]]) + np.arange(int(size[j - 1]) - done)
            ids = self.library.encode_to_numpy(raw[at].tobytes().decode()).astype(np.int32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), size[i:j] - done) + 1
            counts[row[i:j]] = np.diff(ends, prepend=0)
            lists.append(ids)
            i = j
        for k in odd.tolist():
            ids = np.array(self._segment(raw[s[k] : e[k]].tobytes().decode()), np.int32)
            counts[k] = len(ids)
            lists.append(ids)
        if not lists:
            return np.zeros(0, np.int32), counts
        flat = np.concatenate(lists)
        n = np.concatenate((counts[row], counts[odd]))
        begin = np.zeros(len(s), np.int64)
        begin[np.concatenate((row, odd))] = np.cumsum(n) - n
        upto = np.cumsum(counts) - counts
        return flat[np.repeat(begin - upto, counts) + np.arange(len(flat))], counts

    def _segment(self, segment: str) -> list[int]:
        if len(segment) <= LONG:
            return self.library.encode_ordinary(segment)
        ids: list[int] = []
        for m in regex.finditer(self.library._pat_str.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]").replace(rf"[^[{_SPACE}]", f"[^{_SPACE}"), segment):
            ids += self.library._encode_single_piece(m.group().encode("utf-8", "surrogatepass"))
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The exact bytes; they needn't be whole characters."""
        return self.library.decode_bytes(ids.tolist())

    def joined(self, ids: np.ndarray) -> str:
        return ",".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each Python worker and rank file."""
    return Codec(path)


def rank_file(name: str = RANKS) -> str:
    return public_tokenizers.path(name)


def encode_column(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of an Arrow column of texts, some megabytes at a time."""
    raw, offsets = strings(col)
    ids, upto = [], [np.zeros(1, np.int64)]
    for i, j in parts(offsets, 12_000_000):
        got, at = codec(path).encode_all(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ids.append(got)
        upto.append(at[1:] + upto[-1][-1])
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(upto)


def encode_docs(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs plus token_ids array<int> and n_tokens long, in place of columns of these names. Null and empty texts have no tokens; rows come one for one."""
    path, docs = path or rank_file(), without(docs, "token_ids", "n_tokens")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encode_column(b["text"], path)
        return pa.RecordBatch.from_arrays([*b.columns, int_lists(ids, offsets, pa.int32()), pa.array(np.diff(offsets))], [*b.schema.names, "token_ids", "n_tokens"])

    return map_batches(docs, run, with_doc_columns(docs, [("token_ids", "array<int>"), ("n_tokens", "long")]))


def decode_docs(encoded: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """encoded plus decoded binary, in place of a column of this name: the raw bytes of each row's ids. Null ids give no bytes; unknown ids raise."""
    path, encoded = path or rank_file(), without(encoded, "decoded")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        at = b.schema.get_field_index(ids)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([c.library.decode_bytes(x or []) for x in b.column(at).to_pylist()], pa.binary())], [*b.schema.names, "decoded"])

    return map_batches(encoded, run, with_doc_columns(encoded, [("decoded", "binary")]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes), n_bytes.

    Encoding and decoding are one pass, so that no id list leaves its worker. One row for each row of docs.
    """
    path = path or rank_file()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, ids_sha, text_sha, size = [], [], [], []
        flat, at = encode_column(b["text"], path)
        for i in range(b.num_rows):
            ids = flat[at[i] : at[i + 1]]
            raw = c.decode(ids)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(c.joined(ids).encode()).hexdigest())
            text_sha.append(hashlib.sha256(raw).hexdigest())
            size.append(len(raw))
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return map_batches(text_columns(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encode_docs() that decodes each batch again and raises if it doesn't give the very bytes of the texts."""
    path, docs = path or rank_file(), without(docs, "token_ids", "n_tokens")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encode_column(b["text"], path)
        raw, _ = strings(b["text"])
        if codec(path).library.decode_bytes(ids.tolist()) != raw.tobytes():
            raise ValueError("token ids don't decode to their texts")
        return pa.RecordBatch.from_arrays([*b.columns, int_lists(ids, offsets, pa.int32()), pa.array(np.diff(offsets))], [*b.schema.names, "token_ids", "n_tokens"])

    return map_batches(docs, run, with_doc_columns(docs, [("token_ids", "array<int>"), ("n_tokens", "long")]))
