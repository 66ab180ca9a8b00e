"""Binary records by a format text: pack columns into bytes, take bytes apart again, sizes.

A format is a row of codes: > < = set the byte order (big, little, the machine's), ! followed by a number the greatest
alignment (8 without one; 1 at first, which is none), x is a zero byte, b h l q are signed and B H L Q T unsigned integers
of 1, 2, 8, 8 (T: 8) bytes, i and I followed by a number such of that many bytes (4 without one, 8 at most), f and d
floats, s a text ended by a zero byte, c followed by a number a text of just so many bytes (1 without one). c0 packs a
whole text; unpacked, its length is the number before it, which isn't returned itself. Blanks mean nothing.
Integers too large for their code lose their upper bits. A null among the values, or null bytes, give null.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = re.compile(r"([><=xbBhHlLqQTfds])|([!iIc])(\d*)|(\s+)")
#: Bytes of the codes; fixed values of the format.
_BYTES = {"b": 1, "B": 1, "h": 2, "H": 2, "l": 8, "L": 8, "q": 8, "Q": 8, "T": 8, "f": 4, "d": 8}
_SIGNED = frozenset("bhlqi")


def items(form: str) -> Iterator[tuple[str, int, str, int]]:
    """(code, bytes, byte order, alignment) of the format's fields. s has 0 bytes, as has c0."""
    order, most, at = sys.byteorder, 1, 0
    while at < len(form):
        m = _ITEM.match(form, at)
        if m is None:
            raise ValueError(f"invalid format option '{form[at]}'")
        at = m.end()
        code, number = m.group(1) or m.group(2), m.group(3)
        if code in (">", "<", "="):
            order = {">": "big", "<": "little", "=": sys.byteorder}[code]
        elif code == "!":
            most = int(number or 8)
            if most < 1 or most & (most - 1):
                raise ValueError("an alignment is a power of two")
        elif code:
            size = int(number or {"c": 1}.get(code, 4)) if m.group(2) else _BYTES.get(code, 1 if code == "x" else 0)
            if code in ("i", "I") and not 1 <= size <= 8:
                raise ValueError(f"integral size {size} is out of limits [1, 8]")
            aligned = min(size, most) if code not in "xsc" else 1
            yield code, size, order, aligned if aligned and not aligned & (aligned - 1) else 1


def size(form: str) -> int:
    """Bytes of what the format packs; a format with s or c0 has none."""
    n = 0
    for code, width, _, align in items(form):
        if not width:
            raise ValueError("variable-size format")
        n += -n % align + width
    return n


def pack_values(form: str, values: tuple[Any, ...]) -> bytes:
    out, left = bytearray(), iter(values)
    try:
        for code, width, order, align in items(form):
            out += b"\0" * (-len(out) % align)
            if code == "x":
                out += b"\0"
            elif code in "fd":
                out += struct.pack((">" if order == "big" else "<") + code, float(next(left)))
            elif code in "sc":
                v = next(left)
                v = v.encode() if isinstance(v, str) else bytes(v)
                if code == "c" and len(v) < width:
                    raise ValueError("string too short")
                out += v + b"\0" if code == "s" else v[: width or None]
            else:
                out += (int(next(left)) & ((1 << 8 * width) - 1)).to_bytes(width, order)
    except StopIteration:
        raise ValueError("fewer values than the format has fields") from None
    return bytes(out)


def unpack_values(form: str, data: bytes, start: int = 1) -> tuple[list[Any], int]:
    """The values from byte `start`, the first being 1, and where the next one would be."""
    at, out = start - 1, []
    for code, width, order, align in items(form):
        at += -at % align
        if code == "s":
            end = data.find(b"\0", at)
            if end < 0:
                raise ValueError("unfinished string in data")
            out.append(data[at:end])
            at = end + 1
            continue
        if code == "c" and not width:
            if not out or not isinstance(out[-1], int):
                raise ValueError("c0 needs a number before it")
            width = out.pop()
        part = data[at : at + width]
        if width < 0 or len(part) < width:
            raise ValueError("data string too short")
        at += width
        if code == "c":
            out.append(part)
        elif code in "fd":
            out.append(struct.unpack((">" if order == "big" else "<") + code, part)[0])
        elif code != "x":
            v = int.from_bytes(part, order, signed=code in _SIGNED)
            out.append(v - (1 << 64) if v >= 1 << 63 else v)  # a long column holds it by its bits
    return out, at + 1


def _kinds(form: str) -> list[str]:
    kinds: list[str] = []
    for code, width, _, _ in items(form):
        if code == "c" and not width:
            kinds = kinds[:-1]
        if code != "x":
            kinds.append("binary" if code in "sc" else "double" if code in "fd" else "long")
    return kinds


def pack(form: str, *cols: Column) -> Column:
    """Bytes of each row's values."""
    list(items(form))

    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        rows = zip(first, *rest, strict=True)
        return pd.Series([None if any(v is None or v is pd.NA for v in r) else pack_values(form, r) for r in rows], dtype=object)

    # Whole numbers travel as text: a column with nulls would reach pandas as doubles, which hold 53 bits of them.
    kinds = _kinds(form.replace("c0", "s"))
    if len(kinds) != len(cols):
        raise ValueError(f"{len(kinds)} fields, {len(cols)} columns")
    sent = [c if k == "binary" else (c.cast("long") if k == "long" else c.cast("double")).cast("string") for c, k in zip(cols, kinds, strict=True)]
    return F.pandas_udf(run, "binary")(*sent) if sent else F.lit(pack_values(form, ()))


def unpack(form: str, data: Column) -> Column:
    """A struct of the fields v1, v2 ... of each row's bytes, and next, the place behind them. Bytes that are too short are an error."""
    kinds = _kinds(form)
    names = [f"v{i + 1}" for i in range(len(kinds))]

    def run(rows: pd.Series) -> pd.DataFrame:
        got = [None if r is None else unpack_values(form, bytes(r)) for r in rows]
        cols = {n: pd.Series([None if g is None else g[0][i] for g in got], dtype="Int64" if k == "long" else object) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
        return pd.DataFrame({**cols, "next": pd.Series([None if g is None else g[1] for g in got], dtype="Int64")})

    schema = ", ".join([*[f"{n} {k}" for n, k in zip(names, kinds, strict=True)], "next long"])
    return F.when(data.isNotNull(), F.pandas_udf(run, f"struct<{schema.replace(' ', ':')}>".replace(",:", ","))(data))
