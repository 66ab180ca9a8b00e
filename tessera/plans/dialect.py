"""SQL text of the other dialect made ready for Spark: casts by :: are dropped (they were never applied there), GLOB becomes
a regular expression, == an equals sign, functions that Spark lacks become expressions, SHOW and SET are stubs. Literals
and quoted names are left alone."""

from __future__ import annotations

import re

from tessera.functions.text import glob_regex

_PIECE = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)
_CAST = re.compile(r"\s*::\s*[A-Za-z_]\w*(?:\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\))?(?:\s*\[\s*\])*")
_GLOB = re.compile(r"\b(NOT\s+)?GLOB\s*$", re.I)


def strip_casts(sql: str) -> str:
    pieces = _PIECE.split(sql)
    return "".join(p if i % 2 else _CAST.sub("", p) for i, p in enumerate(pieces))


#: Codes of strftime and the patterns that stand for them.
_DATES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def _strftime(form: str, at: str = "current_timestamp()") -> str:
    pattern = "".join(_DATES.get(x, x) if x in _DATES else re.sub(r"([A-Za-z]+)", r"''\1''", x) for x in re.findall(r"%.|[^%]+", form.strip()[1:-1]))
    return f"date_format(CAST({at} AS TIMESTAMP), '{pattern}')"


def _group_concat(value: str, separator: str = "','") -> str:
    """Values in their order, as the other dialect's order isn't defined."""
    m = re.match(r"\s*DISTINCT\s+(.+)$", value, re.I | re.S)
    return f"array_join(sort_array({'collect_set' if m else 'collect_list'}(CAST({m.group(1) if m else value} AS STRING))), {separator})"


_FUNCTIONS = {
    "total": lambda x: f"CAST(coalesce(sum({x}), 0) AS DOUBLE)",
    "group_concat": _group_concat,
    "string_agg": _group_concat,
    "strftime": _strftime,
    "julianday": lambda x: f"(CAST(unix_micros(CAST({x} AS TIMESTAMP)) AS DOUBLE) / 86400000000 + 2440587.5)",
    "unixepoch": lambda x: f"unix_seconds(CAST({x} AS TIMESTAMP))",
    "iif": lambda test, yes, no="NULL": f"IF({test}, {yes}, {no})",
    "typeof": lambda x: f"CASE WHEN ({x}) IS NULL THEN 'null' ELSE CASE regexp_replace(typeof({x}), '[(].*', '') WHEN 'string' THEN 'text' WHEN 'binary' THEN 'blob' WHEN 'float' THEN 'real' WHEN 'double' THEN 'real' WHEN 'decimal' THEN 'real' WHEN 'date' THEN 'text' WHEN 'timestamp' THEN 'text' ELSE 'integer' END END",
    "json_group_array": lambda x: f"to_json(sort_array(collect_list({x})))",
    "json_extract": lambda doc, path: f"get_json_object({doc}, {path})",
}
_CALL = re.compile(rf"(?<![\w.])({'|'.join(_FUNCTIONS)})\s*\(", re.I)


def calls(sql: str) -> str:
    """sql with the calls of _FUNCTIONS written out, inner ones first."""
    at = len(sql)
    quoted = [(m.start(), m.end()) for m in _PIECE.finditer(sql)]
    for m in reversed([m for m in _CALL.finditer(sql) if not any(a <= m.start() < b for a, b in quoted)]):
        depth, quote, parts, last = 1, "", [], m.end()
        for at in range(m.end(), len(sql)):
            c = sql[at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c in "()":
                depth += 1 if c == "(" else -1
                if not depth:
                    break
            elif c == "," and depth == 1:
                parts.append(sql[last:at])
                last = at + 1
        args = [x.strip() for x in (*parts, sql[last:at])]
        try:
            sql = sql[: m.start()] + _FUNCTIONS[m.group(1).lower()](*args) + sql[at + 1 :]
        except TypeError as e:
            raise ValueError(f"{m.group(1)} takes other arguments") from e
    return sql


def translate(sql: str) -> str:
    pieces = _PIECE.split(calls(strip_casts(sql)))
    for i in range(0, len(pieces), 2):
        pieces[i] = re.sub(r"(?<![<>=!])==(?!=)", "=", pieces[i])
        if i + 1 < len(pieces) and (m := _GLOB.search(pieces[i])):
            pattern = glob_regex(pieces[i + 1][1:-1].replace("''", "'"))
            pieces[i] = pieces[i][: m.start()] + (m.group(1) or "") + "RLIKE "
            pieces[i + 1] = "r'" + pattern.replace("'", "\\x27") + "'"
        elif i + 1 < len(pieces) and pieces[i + 1].startswith('"'):
            pieces[i + 1] = "`" + pieces[i + 1][1:-1].replace('""', '"').replace("`", "``") + "`"
    return "".join(pieces)


def affinity(declared: str) -> str:
    """The Spark type of a declared column type, by the public substring rules."""
    t = declared.upper()
    if "INT" in t:
        return "bigint"
    if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in t or not t.strip():
        return "binary"
    if any(x in t for x in ("REAL", "FLOA", "DOUB")):
        return "double"
    return "double"
