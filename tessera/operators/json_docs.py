"""JSON documents d(key, doc): commands over all documents at once. Concrete reads stay in the JVM; general paths and edits
run in Arrow batches through functions.jsonpath."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.jsonpath import json_read, json_write
from tessera.operators.effects import upsert


def get(d: DataFrame, *paths: str) -> DataFrame:
    """One path: its reply. Several: an object of the replies by path."""
    if len(paths) <= 1:
        return d.select("key", json_read("doc", "get", *(paths or ("$",))).alias("value"))
    fields = [F.concat(F.lit(json.dumps(p) + ":"), F.coalesce(json_read("doc", "get", p), F.lit("null"))) for p in paths]
    return d.select("key", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("value"))


def get_concrete(d: DataFrame, path: str) -> DataFrame:
    """The text of one concrete path ($.a.b[0]): no Python, and pruned by Catalyst like any expression."""
    if not re.fullmatch(r"\$(\.\w+|\[\d+\]|\['[^']+'\])*", path):
        raise ValueError(path)
    return d.select("key", F.get_json_object("doc", path).alias("value"))


def mget(d: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    return asked.join(d, "key", "left").select("key", json_read("doc", "get", path).alias("value"))


def inspect(d: DataFrame, op: str, path: str = "$", *args: Any) -> DataFrame:
    """type, arrlen, strlen, objlen, objkeys, arrindex, memory, resp."""
    return d.select("key", json_read("doc", op, path, *args).alias("reply"))


def edit(d: DataFrame, op: str, path: str = "$", *args: Any) -> DataFrame:
    """key, doc, reply after set, merge, del, clear, numincrby, nummultby, numpowby, strappend, toggle, arrappend,
    arrinsert, arrpop or arrtrim. A deleted root has a null doc."""
    return d.select("key", json_write("doc", op, path, *args).alias("x")).select("key", "x.doc", "x.reply")


def mset(d: DataFrame, writes: DataFrame) -> DataFrame:
    """writes(pos, key, doc): whole documents, the last of a key wins."""
    return upsert(d, writes.groupBy("key").agg(F.max_by("doc", "pos").alias("doc")), ["key"])
