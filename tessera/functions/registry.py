"""The scripting surface: programs over (frames, args) in Python, addressed by SHA-1 or by library name, read-only or not.

A program is a function (keys: dict[str, DataFrame], args: list) -> DataFrame | dict[str, DataFrame]; a read-only call may
return rows but no new frames.
"""

from __future__ import annotations

import hashlib
import inspect
import textwrap
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Program = Callable[[dict[str, DataFrame], list[Any]], Any]


class ScriptError(ValueError):
    pass


class Registry:
    def __init__(self) -> None:
        self.scripts: dict[str, Program] = {}
        self.libraries: dict[str, dict[str, tuple[Program, bool]]] = {}

    # SCRIPT LOAD | EXISTS | FLUSH, EVAL, EVALSHA
    def load(self, program: Program) -> str:
        sha = hashlib.sha1(textwrap.dedent(inspect.getsource(program)).encode()).hexdigest()  # noqa: S324
        self.scripts[sha] = program
        return sha

    def exists(self, *shas: str) -> list[int]:
        return [int(s in self.scripts) for s in shas]

    def flush(self) -> None:
        self.scripts.clear()

    def eval(self, program: Program, keys: dict[str, DataFrame], args: list[Any], read_only: bool = False) -> Any:
        return self.evalsha(self.load(program), keys, args, read_only)

    def evalsha(self, sha: str, keys: dict[str, DataFrame], args: list[Any], read_only: bool = False) -> Any:
        if sha not in self.scripts:
            raise ScriptError("no matching script")
        return self._run(self.scripts[sha], keys, args, read_only)

    # FUNCTION LOAD [REPLACE] | DELETE | LIST | FLUSH, FCALL
    def load_library(self, name: str, functions: dict[str, Program], no_writes: frozenset[str] = frozenset(), replace: bool = False) -> None:
        if name in self.libraries and not replace:
            raise ScriptError(f"library {name} already exists")
        taken = {f for lib, fs in self.libraries.items() if lib != name for f in fs}
        if clash := taken & set(functions):
            raise ScriptError(f"functions already exist: {sorted(clash)}")
        self.libraries[name] = {f: (p, f in no_writes) for f, p in functions.items()}

    def delete_library(self, name: str) -> None:
        if self.libraries.pop(name, None) is None:
            raise ScriptError(f"no library {name}")

    def list_libraries(self) -> dict[str, list[str]]:
        return {k: sorted(v) for k, v in sorted(self.libraries.items())}

    def fcall(self, name: str, keys: dict[str, DataFrame], args: list[Any], read_only: bool = False) -> Any:
        for fs in self.libraries.values():
            if name in fs:
                program, pure = fs[name]
                if read_only and not pure:
                    raise ScriptError("a function that may write")
                return self._run(program, keys, args, read_only)
        raise ScriptError(f"no function {name}")

    @staticmethod
    def _run(program: Program, keys: dict[str, DataFrame], args: list[Any], read_only: bool) -> Any:
        out = program(dict(keys), list(args))
        if read_only and isinstance(out, dict):
            raise ScriptError("write from a read-only script")
        return out


def limited(spark: SparkSession, seconds: float, fn: Callable[[], Any]) -> Any:
    """fn(), whose jobs on this thread are cancelled once `seconds` are over, those that it would start later as well.

    A frame that fn returns hasn't run yet: to limit it too, fn must act on it. Python code between jobs isn't interrupted.
    """
    group, late = f"limited-{uuid.uuid4().hex[:12]}", threading.Event()

    def kill() -> None:
        late.set()
        spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)

    timer = threading.Timer(seconds, kill)
    before = {k: spark.sparkContext.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    spark.sparkContext.setJobGroup(group, "a program with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return fn()
    except Exception as e:
        if late.is_set():
            raise ScriptError(f"stopped after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        for k, v in before.items():
            spark.sparkContext.setLocalProperty(k, v)


def register_sql(spark: SparkSession, name: str, fn: Callable[..., Any], returns: str, vectorised: bool = True) -> None:
    """A function for SQL text: in Arrow batches unless asked otherwise."""
    from pyspark.sql import functions as F

    spark.udf.register(name, F.pandas_udf(fn, returns) if vectorised else F.udf(fn, returns))
