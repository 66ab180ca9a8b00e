"""JSON documents as strings: a path evaluator and edits, run in Arrow batches.

Paths: $, .name, ['name'], [n] (negative from the end), *, [a:b:s], unions, .. and filters [?(@.a > 1 && @.b == 'x')].
A path without $ is of the old form: it reports its first match alone.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+(?:[eE][+-]?\d+)?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|=~|&&|\|\||[<>()!])|(true|false|null)\b|([@$](?:\.\.?[\w*]+|\[(?:'[^']*'|\"[^\"]*\"|[^\]\[]*)\])*))")
_COMPARE: dict[str, Callable[[Any, Any], bool]] = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


class PathError(ValueError):
    pass


@lru_cache(maxsize=1024)
def parse(path: str) -> tuple[bool, tuple[tuple[str, Any], ...]]:
    """(whether the path is of the $ form, its steps)."""
    modern = path.startswith("$")
    text = path[1:] if modern else path if path.startswith((".", "[")) else "." + path
    if text == ".":
        text = ""
    steps: list[tuple[str, Any]] = []
    i = 0
    while i < len(text):
        if text.startswith("..", i):
            steps.append(("deep", None))
            i += 2
            if not text.startswith("[", i):
                name = re.match(r"\*|[^.\[\]]+", text[i:])
                if not name:
                    raise PathError(path)
                steps.append(("all", None) if name.group() == "*" else ("names", (name.group(),)))
                i += name.end()
        elif text[i] == ".":
            name = re.match(r"\*|[^.\[\]]+", text[i + 1 :])
            if not name:
                raise PathError(path)
            steps.append(("all", None) if name.group() == "*" else ("names", (name.group(),)))
            i += 1 + name.end()
        elif text[i] == "[":
            end = _closing(text, i)
            steps.append(_bracket(text[i + 1 : end].strip(), path))
            i = end + 1
        else:
            raise PathError(path)
    return modern, tuple(steps)


def _closing(text: str, i: int) -> int:
    depth, quote = 0, ""
    for j in range(i, len(text)):
        c = text[j]
        if quote:
            quote = "" if c == quote and text[j - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        else:
            depth += (c in "[(") - (c in "])")
            if depth == 0:
                return j
    raise PathError(text)


def _bracket(body: str, path: str) -> tuple[str, Any]:
    if body == "*":
        return "all", None
    if body.startswith("?"):
        return "filter", body[1:].strip()
    if re.fullmatch(r"-?\d*:-?\d*(:-?\d*)?", body):
        return "slice", tuple(int(x) if x else None for x in (body + "::").split(":")[:3])
    parts = re.findall(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(-?\d+)", body)
    if not parts:
        raise PathError(path)
    if parts[0][2]:
        return "indexes", tuple(int(p[2]) for p in parts)
    return "names", tuple(p[0] or p[1] for p in parts)


def find(doc: Any, steps: tuple[tuple[str, Any], ...]) -> list[tuple[Any, Any]]:
    """(parent, key) of each match in document order; the root is (None, None)."""
    places: list[tuple[Any, Any, Any]] = [(None, None, doc)]
    for kind, arg in steps:
        out: list[tuple[Any, Any, Any]] = []
        for p, k, v in places:
            out += [(p, k, v), *_below(v)] if kind == "deep" else _step(v, kind, arg, doc)
        places = out
    return [(p, k) for p, k, _ in places]


def _children(v: Any) -> list[tuple[Any, Any, Any]]:
    if isinstance(v, dict):
        return [(v, k, x) for k, x in v.items()]
    return [(v, i, x) for i, x in enumerate(v)] if isinstance(v, list) else []


def _below(v: Any) -> Iterator[tuple[Any, Any, Any]]:
    for c in _children(v):
        yield c
        yield from _below(c[2])


def _step(v: Any, kind: str, arg: Any, root: Any) -> list[tuple[Any, Any, Any]]:
    if kind == "all":
        return _children(v)
    if kind == "names":
        return [(v, n, v[n]) for n in arg if isinstance(v, dict) and n in v]
    if kind == "filter":
        return [c for c in _children(v) if _Filter(arg, c[2], root).value()]
    if not isinstance(v, list):
        return []
    if kind == "slice":
        return [(v, i, v[i]) for i in range(len(v))[slice(*arg)]]
    return [(v, i % len(v), v[i]) for i in arg if -len(v) <= i < len(v)]


class _Filter:
    def __init__(self, text: str, at: Any, root: Any) -> None:
        self.tokens, i = [], 0
        while i < len(text.rstrip()):
            m = _TOKEN.match(text, i)
            if not m or m.end() == i:
                raise PathError(text)
            self.tokens.append((m.lastindex, m.group(m.lastindex)))
            i = m.end()
        self.at, self.root, self.i = at, root, 0

    def value(self) -> bool:
        got = self._or()
        if self.i != len(self.tokens):
            raise PathError("filter")
        return got

    def _peek(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else ""

    def _or(self) -> bool:
        got = self._and()
        while self._peek() == "||":
            self.i += 1
            got = self._and() or got
        return got

    def _and(self) -> bool:
        got = self._one()
        while self._peek() == "&&":
            self.i += 1
            got = self._one() and got
        return got

    def _one(self) -> bool:
        if self._peek() == "!":
            self.i += 1
            return not self._one()
        if self._peek() == "(":
            self.i += 1
            got = self._or()
            self.i += 1
            return got
        left = self._operand()
        op = self._peek()
        if op not in ("==", "!=", "=~", *_COMPARE):
            return bool(left)  # existence
        self.i += 1
        right = self._operand()
        if not left or not right:
            return False
        a, b = left[0], right[0]
        if op in ("==", "!="):
            return (a == b and isinstance(a, bool) == isinstance(b, bool)) == (op == "==")
        if op == "=~":
            return isinstance(a, str) and isinstance(b, str) and re.search(b, a) is not None
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        return (number(a) and number(b) or isinstance(a, str) and isinstance(b, str)) and _COMPARE[op](a, b)

    def _operand(self) -> list[Any]:
        kind, text = self.tokens[self.i]
        self.i += 1
        if kind == 1:
            return [json.loads(text)]
        if kind == 2:
            return [re.sub(r"\\(.)", r"\1", text[1:-1])]
        if kind == 4:
            return [json.loads(text)]
        base = self.at if text[0] == "@" else self.root
        found = find(base, parse("$" + text[1:])[1])
        return [base if p is None else p[k] for p, k in found]


def _dump(v: Any) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _type(v: Any) -> str:
    if v is None:
        return "null"
    return {bool: "boolean", int: "integer", float: "number", str: "string", list: "array"}.get(type(v), "object")


def _each(doc: Any, path: str, fn: Callable[[Any], Any]) -> str | None:
    """fn of every match: a list for $ paths, else that of the first match; null without one."""
    modern, steps = parse(path)
    got = [fn(doc if p is None else p[k]) for p, k in find(doc, steps)]
    if modern:
        return _dump(got)
    return _dump(got[0]) if got else None


def merge_patch(doc: Any, patch: Any) -> Any:
    if not isinstance(patch, dict):
        return patch
    out = dict(doc) if isinstance(doc, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def _wrap(n: int | float) -> int | float:
    """Integers stay within 64 bits by wrapping, as counters of the document type do."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63) if isinstance(n, int) else n


def read(doc: Any, op: str, path: str, args: tuple[Any, ...]) -> str | None:
    """What a reading command replies, as JSON."""
    size = lambda kind: lambda v: len(v) if isinstance(v, kind) else None
    if op == "get":
        return _each(doc, path, lambda v: v)
    if op == "type":
        return _each(doc, path, _type)
    if op in ("arrlen", "strlen", "objlen"):
        return _each(doc, path, size({"arrlen": list, "strlen": str, "objlen": dict}[op]))
    if op == "objkeys":
        return _each(doc, path, lambda v: list(v) if isinstance(v, dict) else None)
    if op == "arrindex":
        value, start, stop = args

        def index(v: Any) -> int | None:
            if not isinstance(v, list):
                return None
            span = range(len(v))[start : stop or None]
            return next((i for i in span if v[i] == value and isinstance(v[i], bool) == isinstance(value, bool)), -1)

        return _each(doc, path, index)
    if op == "memory":
        return _each(doc, path, lambda v: len(_dump(v).encode()))
    if op == "resp":

        def tree(v: Any) -> Any:
            if isinstance(v, dict):
                return ["{", *[x for k, y in v.items() for x in (k, tree(y))]]
            return ["[", *map(tree, v)] if isinstance(v, list) else v

        return _each(doc, path, tree)
    raise ValueError(op)


def write(doc: Any, op: str, path: str, args: tuple[Any, ...]) -> tuple[Any, str | None]:
    """The document after an editing command, and its reply as JSON."""
    modern, steps = parse(path)
    places = find(doc, steps)
    if op == "set":
        value, condition = args
        if places:
            if condition == "NX":
                return doc, None
            for p, k in places:
                if p is None:
                    return value, '"OK"'
                p[k] = value
            return doc, '"OK"'
        if condition == "XX" or not steps or steps[-1][0] != "names" or len(steps[-1][1]) != 1:
            return doc, None
        for p, k in find(doc, steps[:-1]):
            parent = doc if p is None else p[k]
            if isinstance(parent, dict):
                parent[steps[-1][1][0]] = value
                return doc, '"OK"'
        return doc, None
    if op == "merge":
        if not places:
            return write(doc, "set", path, (merge_patch(None, args[0]), None))
        for p, k in places:
            if p is None:
                return merge_patch(doc, args[0]), '"OK"'
            p[k] = merge_patch(p[k], args[0])
        return doc, '"OK"'
    if op == "del":
        if any(p is None for p, _ in places):
            return None, "1"
        done = 0
        for p, k in reversed(places):  # later places first, so that list indexes hold
            if isinstance(p, dict) and k in p or isinstance(p, list) and k < len(p):
                del p[k]
                done += 1
        return doc, str(done)
    replies: list[Any] = []
    for p, k in places:
        v = doc if p is None else p[k]
        new, reply = _edit(v, op, args)
        replies.append(reply)
        if p is None:
            doc = new
        else:
            p[k] = new
    if op == "clear":
        return doc, str(sum(r for r in replies if r))
    return doc, _dump(replies) if modern else (_dump(replies[0]) if replies else None)


def _edit(v: Any, op: str, args: tuple[Any, ...]) -> tuple[Any, Any]:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if op in ("numincrby", "nummultby", "numpowby"):
        if not number:
            return v, None
        f = {"numincrby": operator.add, "nummultby": operator.mul, "numpowby": operator.pow}[op]
        new = _wrap(f(v, args[0]))
        return new, new
    if op == "toggle":
        return (not v, not v) if isinstance(v, bool) else (v, None)
    if op == "strappend":
        return (v + args[0], len(v + args[0])) if isinstance(v, str) else (v, None)
    if op == "clear":
        if isinstance(v, (dict, list)):
            return type(v)(), int(bool(v))
        return (0, int(v != 0)) if number else (v, 0)
    if not isinstance(v, list):
        return v, None
    if op == "arrappend":
        return v + list(args), len(v) + len(args)
    if op == "arrinsert":
        at, *new = args
        at = at + len(v) if at < 0 else at
        if not 0 <= at <= len(v):
            raise IndexError(at)
        return v[:at] + new + v[at:], len(v) + len(new)
    if op == "arrpop":
        if not v:
            return v, None
        at = max(-len(v), min(len(v) - 1, args[0]))
        return [x for i, x in enumerate(v) if i != at % len(v)], v[at]
    if op == "arrtrim":
        start, stop = (max(i + len(v), 0) if i < 0 else i for i in args)
        new = v[start : stop + 1]
        return new, len(new)
    raise ValueError(op)


def json_read(doc: Column | str, op: str, path: str = "$", *args: Any) -> Column:
    """The reply of get, type, arrlen, strlen, objlen, objkeys, arrindex, memory or resp for each document; null documents give null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: None if d is None else read(json.loads(d), op, path, args))

    return run(doc)


def json_write(doc: Column | str, op: str, path: str = "$", *args: Any) -> Column:
    """struct<doc, reply> of set, merge, del, clear, num*, str*, arr* or toggle for each document."""

    @F.pandas_udf("doc string, reply string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for d in s:
            if d is None:
                out.append((None, None))
                continue
            new, reply = write(json.loads(d), op, path, args)
            out.append((None if new is None and op == "del" else _dump(new), reply))
        return pd.DataFrame(out, columns=["doc", "reply"])

    return run(doc)
