"""Scalar helpers: glob patterns, index ranges, ordered bounds, subsequences and digests. Columns in, columns out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: * ? [set] [^set] [a-z] and backslash escapes."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and (close := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : close]
            negated, body = body[:1] == "^", body.removeprefix("^")
            out.append(("[^" if negated else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + "$"


def glob(col: Column | str, pattern: str) -> Column:
    """Whether col matches; a bare prefix* becomes a startswith that scans can prune by."""
    col = F.col(col) if isinstance(col, str) else col
    if re.fullmatch(r"[^*?\[\\]*\*", pattern):
        return col.startswith(pattern[:-1])
    if not re.search(r"[*?\[\\]", pattern):
        return col == pattern
    return col.rlike(glob_regex(pattern))


def from_end(i: int, n: Column) -> Column:
    """An index that may count from the end (-1: the last), as a zero-based one; it may fall outside."""
    return F.lit(i) if i >= 0 else n + i


def within_indexes(pos: Column, n: Column, start: int, stop: int) -> Column:
    """Whether zero-based pos lies in the inclusive range of possibly negative indexes."""
    return (pos >= F.greatest(from_end(start, n), F.lit(0))) & (pos <= from_end(stop, n))


def byte_slice(value: Column, start: int, stop: int) -> Column:
    """Bytes start..stop, inclusive, clamped; empty where the range is."""
    n = F.octet_length(value)
    lo = F.greatest(from_end(start, n), F.lit(0))
    hi = F.least(from_end(stop, n), n - 1)
    return F.when((lo > hi) | (n == 0), F.lit("")).otherwise(F.substring(value.cast("binary"), lo + 1, hi - lo + 1).cast("string"))


def score_bound(col: Column, bound: str, lower: bool) -> Column:
    """A score bound: a number, -inf or +inf, after ( exclusive."""
    open_, text = bound.startswith("("), bound.removeprefix("(")
    value = F.lit(float(text))
    if lower:
        return col > value if open_ else col >= value
    return col < value if open_ else col <= value


def lex_bound(col: Column, bound: str, lower: bool) -> Column:
    """A member bound: - or + for no bound, [x inclusive, (x exclusive."""
    if bound in "-+":
        return F.lit((bound == "-") == lower)
    value = F.lit(bound[1:])
    if lower:
        return col > value if bound[0] == "(" else col >= value
    return col < value if bound[0] == "(" else col <= value


def lcs(a: Column | str, b: Column | str) -> Column:
    """Longest common subsequence, by dynamic programming; no built-in has it."""
    return F.pandas_udf(_lcs_text, "string")(a, b)


def lcs_ranges(a: Column | str, b: Column | str) -> Column:
    """The runs of the longest common subsequence, last first."""
    return F.pandas_udf(_lcs_runs, "array<struct<a_start:int,a_end:int,b_start:int,b_end:int,len:int>>")(a, b)


def xxh3_hex(value: Column | str) -> Column:
    """16 hex digits of XXH3-64 of the UTF-8 bytes; the built-in xxhash64 is another function."""
    return F.pandas_udf(_xxh3, "string")(value)


def _lcs_text(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _lcs(x, y)[0] for x, y in zip(a, b, strict=True)])


def _lcs_runs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _lcs(x, y)[1] for x, y in zip(a, b, strict=True)])


def _xxh3(values: pd.Series) -> pd.Series:
    import xxhash

    return values.map(lambda v: None if v is None else xxhash.xxh3_64_hexdigest(v.encode()))


def _lcs(a: str, b: str) -> tuple[str, list[dict[str, int]]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    i, j, out, runs = len(a), len(b), [], []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(a[i])
            if runs and runs[-1]["a_start"] == i + 1 and runs[-1]["b_start"] == j + 1:
                runs[-1].update(a_start=i, b_start=j, len=runs[-1]["len"] + 1)
            else:
                runs.append({"a_start": i, "a_end": i, "b_start": j, "b_end": j, "len": 1})
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out)), runs
