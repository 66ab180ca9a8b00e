"""A SQL session: tables as versioned DataFrames, DDL, DML and transactions over immutable states, SELECT by Spark.

Every write is a plan over the state before it; ROLLBACK and savepoints only forget plans. For long chains of writes,
checkpoint() settles a table in the shared folder.

Sessions may share a Database. A transaction sees the state it began with; each statement notes what it read (a table and
a predicate) and the rows it wrote: INSERT and UPDATE the new row, DELETE the old one. COMMIT fails if a row that another
session has committed since meets one of the predicates; otherwise the transaction's rows go on top of what is there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import affinity, translate


class SqlError(ValueError):
    pass


class SerializationError(SqlError):
    """Another transaction has committed rows that this one's reads depend on; the statements can be run again."""


@dataclass(frozen=True)
class Table:
    columns: tuple[tuple[str, str], ...]
    pk: tuple[str, ...]
    rows: DataFrame
    defaults: dict[str, object] = field(default_factory=dict)
    required: frozenset[str] = frozenset()
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)


_NAME = r'(?:"((?:[^"]|"")+)"|([A-Za-z_]\w*))'


def _name(m: re.Match[str], i: int) -> str:
    return (m.group(i) or "").replace('""', '"') or m.group(i + 1)


def _split(text: str) -> list[str]:
    """Parts between top-level commas."""
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            parts.append(text[last:i].strip())
            last = i + 1
    return [*parts, text[last:].strip()]


@dataclass(frozen=True)
class Write:
    """Rows of one statement: as they are now (INSERT, UPDATE) or were (DELETE). None stands for the table's definition."""

    table: str
    kind: str
    rows: DataFrame | None


class Database:
    """What sessions share: the committed tables and views, and the writes of each commit."""

    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.log: list[list[Write]] = []


@dataclass
class Transaction:
    """The state before it, the commits it knows, and what it has read and written."""

    tables: dict[str, Table]
    views: dict[str, str]
    seen: int
    reads: list[tuple[str, str]] = field(default_factory=list)
    writes: list[Write] = field(default_factory=list)


class Session:
    def __init__(self, spark: SparkSession, database: Database | None = None) -> None:
        self.spark = spark
        self.database = database or Database()
        self.tables: dict[str, Table] = dict(self.database.tables)
        self.views: dict[str, str] = dict(self.database.views)
        self._open: Transaction | None = None
        self._marks: list[tuple[str, dict[str, Table], dict[str, str], int]] = []
        self._rowid = 0

    # --- statements ---

    def sql(self, text: str) -> DataFrame | None:
        """Run one statement; rows of a query, else None."""
        t = text.strip().rstrip(";").strip()
        word = re.match(r"\w+", t)
        head = word.group().upper() if word else ""
        if self._open is None:
            self.tables, self.views = dict(self.database.tables), dict(self.database.views)
        handler = getattr(self, f"_{head.lower()}", None) if head in _HANDLED else None
        if handler is None:
            self._observe(t)
            return self._query(t)
        written = Transaction(dict(self.tables), dict(self.views), len(self.database.log))
        if self._open is None and head in _WRITING:  # a statement alone is a transaction of its own
            self._open = written
            try:
                out = handler(t)
                self._commit("COMMIT")
                return out
            finally:
                self._open = None
        return handler(t)

    def retry(self, *statements: str, times: int = 16) -> None:
        """The statements as one transaction, begun anew after a serialization failure."""
        for left in reversed(range(times)):
            self.sql("BEGIN")
            try:
                for t in statements:
                    self.sql(t)
                self.sql("COMMIT")
                return
            except SerializationError:
                if not left:
                    raise
            finally:
                self._rollback("ROLLBACK")

    def _observe(self, t: str) -> None:
        """What a query reads: a single table's WHERE, or all rows of every table it names."""
        if self._open is None:
            return
        m = re.match(rf"SELECT\s.+?\sFROM\s+{_NAME}(?:\s+WHERE\s+(.+?))?(?:\s+(?:ORDER\s+BY|GROUP\s+BY|LIMIT)\s.*)?$", t, re.I | re.S)
        if m and _name(m, 1) in self.tables and not re.search(r"\b(SELECT|JOIN|UNION|HAVING|OVER)\b|,", (m.group(3) or "") + t[m.end(2) if m.group(2) else m.end(1) :].split("WHERE")[0], re.I):
            self._open.reads.append((_name(m, 1), m.group(3) or "TRUE"))
            return
        known = {**{n: t for n in self.views for t in [self.views[n]]}, t: t}
        text = " ".join(known.values())
        self._open.reads += [(n, "TRUE") for n in self.tables if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.I)]

    def _wrote(self, table: str, kind: str, rows: DataFrame | None) -> None:
        if self._open is not None:
            self._open.writes.append(Write(table, kind, rows))

    def _query(self, t: str) -> DataFrame:
        self._register()
        return self.spark.sql(translate(t))

    def _register(self) -> None:
        for n, tab in self.tables.items():
            tab.rows.select(*[F.col(f"`{c}`") for c, _ in tab.columns]).createOrReplaceTempView(f"`{n}`")
        for n, q in self.views.items():
            self.spark.sql(translate(q)).createOrReplaceTempView(f"`{n}`")

    @staticmethod
    def _match(pattern: str, t: str) -> re.Match[str]:
        m = re.match(pattern, t, re.I | re.S)
        if not m:
            raise SqlError(f"not understood: {t}")
        return m

    def _show(self, t: str) -> DataFrame:
        value = "serializable" if "isolation" in t.lower() else ""
        return self.spark.createDataFrame([(value,)], "setting string")

    def _set(self, t: str) -> None:
        return None

    # --- definitions ---

    def _create(self, t: str) -> None:
        if re.match(r"CREATE\s+(TEMP(ORARY)?\s+)?VIEW", t, re.I):
            m = re.match(rf"CREATE\s+(?:TEMP(?:ORARY)?\s+)?VIEW\s+(IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*(\([^)]*\))?\s*AS\s+(.+)", t, re.I | re.S)
            if not m:
                raise SqlError(f"not understood: {t}")
            name = _name(m, 2)
            if name in self.views or name in self.tables:
                if m.group(1):
                    return
                raise SqlError(f"{name} already exists")
            query = m.group(5)
            if m.group(4):
                query = f"SELECT * FROM ({query}) AS v{m.group(4)}"
            self.views[name] = query
            return
        m = re.match(rf"CREATE\s+(UNIQUE\s+)?INDEX\s+{_NAME}\s+ON\s+{_NAME}\s*\((.+)\)$", t, re.I | re.S)
        if m:
            table, cols = self._table(_name(m, 4)), tuple(c.strip('" ') for c in _split(m.group(6)))
            if any(c not in dict(table.columns) for c in cols):
                raise SqlError("an index takes plain columns")
            if any(_name(m, 2) in x.indexes for x in self.tables.values()):
                raise SqlError(f"index {_name(m, 2)} already exists")
            unique = {**table.unique, _name(m, 2): cols} if m.group(1) else table.unique
            new = replace(table, indexes={**table.indexes, _name(m, 2): cols}, unique=unique)
            self._check(new, table.rows)
            self.tables[_name(m, 4)] = new
            self._wrote(_name(m, 4), "DEFINE", None)
            return
        m = re.match(rf"CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+{_NAME}\s*\((.+)\)$", t, re.I | re.S)
        if not m:
            raise SqlError(f"not understood: {t}")
        name = _name(m, 1)
        if name in self.tables or name in self.views:
            raise SqlError(f"table {name} already exists")
        columns, pk, required, defaults, unique = [], (), set(), {}, {}
        for part in _split(m.group(3)):
            if k := re.match(r"(PRIMARY\s+KEY|UNIQUE)\s*\((.+)\)$", part, re.I):
                cols = tuple(c.strip('" ') for c in _split(k.group(2)))
                if k.group(1).upper() == "UNIQUE":
                    unique[f"unique {', '.join(cols)}"] = cols
                else:
                    pk = cols
                continue
            c = re.match(rf"{_NAME}\s*(.*)", part, re.S)
            if re.match(r"(CHECK|FOREIGN|CONSTRAINT)\b", part, re.I) or not c or re.search(r"\b(CHECK|REFERENCES|GENERATED|COLLATE)\b", c.group(3), re.I):
                raise SqlError(f"constraint not supported: {part}")
            rest, column = c.group(3), _name(c, 1)
            kind = re.match(r"[\w ]*?(?=\s*(?:PRIMARY|NOT|NULL|DEFAULT|UNIQUE|$|\())", rest, re.I)
            columns.append((column, affinity(kind.group() if kind else rest)))
            if d := re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\((?:[^()]|\([^()]*\))*\)|[-+]?[\w.]+)", rest, re.I):
                defaults[column] = d.group(1)
            plain = re.sub(r"'(?:[^']|'')*'", "", rest)
            if re.search(r"PRIMARY\s+KEY", plain, re.I):
                pk = (column,)
            if re.search(r"NOT\s+NULL", plain, re.I):
                required.add(column)
            if re.search(r"\bUNIQUE\b", plain, re.I):
                unique[f"unique {column}"] = (column,)
        if lost := {c for cols in (pk, *unique.values()) for c in cols} - {c for c, _ in columns}:
            raise SqlError(f"no such columns: {sorted(lost)}")
        if not pk:  # a row id of our own, hidden from queries
            columns_ddl = [("__rowid", "bigint"), *columns]
            pk = ("__rowid",)
        else:
            columns_ddl = columns
        rows = self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in columns_ddl))
        self.tables[name] = Table(tuple(columns), pk, rows, defaults, frozenset(required), unique)
        self._wrote(name, "DEFINE", None)

    def _drop(self, t: str) -> None:
        m = self._match(rf"DROP\s+(TABLE|VIEW|INDEX)\s+(IF\s+EXISTS\s+)?{_NAME}$", t)
        kind, name = m.group(1).upper(), _name(m, 3)
        if kind == "INDEX":
            for n, tab in self.tables.items():
                if name in tab.indexes:
                    self.tables[n] = replace(tab, indexes={k: v for k, v in tab.indexes.items() if k != name}, unique={k: v for k, v in tab.unique.items() if k != name})
                    self._wrote(n, "DEFINE", None)
                    return
            known = False
        else:
            known = (self.tables if kind == "TABLE" else self.views).pop(name, None) is not None
            if known:
                self.spark.catalog.dropTempView(name)
                self._wrote(name, "DEFINE", None)
        if not known and not m.group(2):
            raise SqlError(f"no such {kind.lower()}: {name}")

    def _alter(self, t: str) -> None:
        m = self._match(rf"ALTER\s+TABLE\s+{_NAME}\s+(.+)$", t)
        name, action = _name(m, 1), m.group(3)
        tab = self._table(name)
        self._wrote(name, "DEFINE", None)
        if r := re.match(rf"RENAME\s+TO\s+{_NAME}$", action, re.I):
            if _name(r, 1) in self.tables:
                raise SqlError(f"{_name(r, 1)} already exists")
            self.tables[_name(r, 1)] = self.tables.pop(name)
            self._wrote(_name(r, 1), "DEFINE", None)
            self.spark.catalog.dropTempView(name)
        elif r := re.match(rf"RENAME\s+(?:COLUMN\s+)?{_NAME}\s+TO\s+{_NAME}$", action, re.I):
            a, b = _name(r, 1), _name(r, 3)
            self._known(tab, a)
            re_ = lambda cols: tuple(b if c == a else c for c in cols)
            self.tables[name] = Table(
                tuple((b if c == a else c, k) for c, k in tab.columns), re_(tab.pk), tab.rows.withColumnRenamed(a, b), {b if c == a else c: v for c, v in tab.defaults.items()},
                frozenset(re_(tab.required)), {k: re_(v) for k, v in tab.unique.items()}, {k: re_(v) for k, v in tab.indexes.items()},
            )
        elif r := re.match(rf"DROP\s+(?:COLUMN\s+)?{_NAME}$", action, re.I):
            c = _name(r, 1)
            self._known(tab, c)
            if c in tab.pk:
                raise SqlError("a primary key column stays")
            without = lambda d: {k: v for k, v in d.items() if c not in v}
            self.tables[name] = replace(tab, columns=tuple(x for x in tab.columns if x[0] != c), rows=tab.rows.drop(c), unique=without(tab.unique), indexes=without(tab.indexes), required=tab.required - {c})
        elif r := re.match(rf"ADD\s+(?:COLUMN\s+)?{_NAME}\s+(\w+)\s*(NOT\s+NULL)?\s*(?:DEFAULT\s+(.+?))?\s*(NOT\s+NULL)?$", action, re.I | re.S):
            c, kind, needed, default = _name(r, 1), affinity(r.group(3)), r.group(4) or r.group(6), r.group(5)
            if c in dict(tab.columns):
                raise SqlError(f"column {c} already exists")
            if needed and default is None:
                raise SqlError("NOT NULL needs a DEFAULT")
            rows = tab.rows.withColumn(c, F.expr(default or "NULL").cast(kind))
            self.tables[name] = replace(tab, columns=(*tab.columns, (c, kind)), rows=rows, defaults={**tab.defaults, c: default}, required=tab.required | ({c} if needed else set()))
        else:
            raise SqlError(f"not understood: {t}")

    # --- rows ---

    def _insert(self, t: str) -> None:
        m = self._match(rf"INSERT\s+INTO\s+{_NAME}\s*(\([^()]*\))?\s*(VALUES\s*.+?|SELECT\s.+?|WITH\s.+?)(?:\s+ON\s+CONFLICT\b(.*))?$", t)
        name = _name(m, 1)
        tab = self._table(name)
        given = [c.strip('" ') for c in _split(m.group(3)[1:-1])] if m.group(3) else [c for c, _ in tab.columns]
        for c in given:
            self._known(tab, c)
        source = m.group(4) if not m.group(4).upper().startswith("VALUES") else f"SELECT * FROM {m.group(4)}"
        if not m.group(4).upper().startswith("VALUES"):
            self._observe(source)
        new = self._query(source)
        if len(new.columns) != len(given):
            raise SqlError(f"{len(given)} columns, {len(new.columns)} values")
        new = new.toDF(*given)
        cols = [(F.col(f"`{c}`") if c in given else F.expr(translate(str(tab.defaults.get(c) or "NULL")))).cast(k).alias(c) for c, k in tab.columns]
        new = new.select(*cols)
        if tab.pk == ("__rowid",):
            new = new.withColumn("__rowid", F.monotonically_increasing_id() + F.lit(self._rowid << 40))
            self._rowid += 1
        if m.group(5) is not None:
            new = self._conflicting(tab, new, m.group(5).strip())
        self._write(name, tab, new, "INSERT")

    def _conflicting(self, tab: Table, new: DataFrame, clause: str) -> DataFrame:
        """The rows to write of an INSERT ... ON CONFLICT: those without a match on the target, and the matches as SET makes them."""
        m = self._match(r"(?:\(([^()]*)\))?\s*DO\s+(NOTHING|UPDATE\s+SET\s+(.+?)(?:\s+WHERE\s+(.+))?)$", clause)
        on = tuple(c.strip('" ') for c in _split(m.group(1))) if m.group(1) else tab.pk
        if on != tab.pk and on not in tab.unique.values():
            raise SqlError("ON CONFLICT names no key")
        fresh = new.join(tab.rows.select(*on), list(on), "left_anti").select(*new.columns)
        if m.group(2).upper() == "NOTHING":
            return fresh
        sets = self._sets(tab, m.group(3))
        # The existing row under its own names, the new one as the struct `excluded`.
        last = self._last(new, on).select(F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("excluded"))
        met = tab.rows.join(last, [F.col(f"`{c}`") == F.col(f"excluded.`{c}`") for c in on])
        met = met.filter(translate(m.group(4))) if m.group(4) else met
        return fresh.unionByName(met.select(*[(F.expr(sets[c]).cast(k) if c in sets else F.col(f"`{c}`")).alias(c) for c, k in tab.rows.dtypes]))

    def _sets(self, tab: Table, text: str) -> dict[str, str]:
        sets = {}
        for part in _split(text):
            c, _, value = part.partition("=")
            self._known(tab, c.strip('" '))
            sets[c.strip('" ')] = translate(value.strip())
        return sets

    @staticmethod
    def _last(new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """Of rows with a repeated key the last in order."""
        rest = [c for c in new.columns if c not in keys]
        numbered = new.withColumn("__at", F.monotonically_increasing_id())
        if not rest:
            return new.distinct()
        return numbered.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__at").alias("__x")).select(*keys, *[F.col(f"__x.`{c}`").alias(c) for c in rest])

    def _write(self, name: str, tab: Table, new: DataFrame, kind: str) -> None:
        """Rows in place of those with their keys: a repeated key merges, the last write staying."""
        bad = [c for c in tab.required | (set(tab.pk) - {"__rowid"})]
        if bad and new.filter(" OR ".join(f"`{c}` IS NULL" for c in bad)).limit(1).count():
            raise SqlError("NOT NULL constraint failed")
        last = self._last(new.select(*tab.rows.columns), tab.pk).select(*tab.rows.columns)
        rows = tab.rows.join(last.select(*tab.pk), list(tab.pk), "left_anti").select(*tab.rows.columns).unionByName(last)
        self._check(tab, rows)
        self.tables[name] = replace(tab, rows=rows)
        self._wrote(name, kind, last)

    def _check(self, tab: Table, rows: DataFrame) -> None:
        for cols in tab.unique.values():
            known = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
            if known.groupBy(*cols).count().filter("count > 1").limit(1).count():
                raise SqlError("UNIQUE constraint failed")

    def _update(self, t: str) -> None:
        m = self._match(rf"UPDATE\s+{_NAME}\s+SET\s+(.+?)(?:\s+WHERE\s+(.+))?$", t)
        name = _name(m, 1)
        tab = self._table(name)
        sets = self._sets(tab, m.group(3))
        self._read(name, m.group(4))
        hit = tab.rows.filter(translate(m.group(4))) if m.group(4) else tab.rows
        new = hit.select(*[(F.expr(sets[c]).cast(k) if c in sets else F.col(f"`{c}`")).alias(c) for c, k in tab.rows.dtypes])
        if set(sets) & set(tab.pk):  # the key changes: the old rows go, the new come
            tab = replace(tab, rows=tab.rows.join(hit.select(*tab.pk), list(tab.pk), "left_anti").select(*tab.rows.columns))
            self._wrote(name, "DELETE", hit)
        self._write(name, tab, new, "UPDATE")

    def _delete(self, t: str) -> None:
        m = self._match(rf"DELETE\s+FROM\s+{_NAME}(?:\s+WHERE\s+(.+))?$", t)
        name = _name(m, 1)
        tab = self._table(name)
        self._read(name, m.group(3))
        gone = F.coalesce(F.expr(translate(m.group(3))), F.lit(False)) if m.group(3) else F.lit(True)
        self._wrote(name, "DELETE", tab.rows.filter(gone))
        self.tables[name] = replace(tab, rows=tab.rows.filter(~gone))

    def _read(self, table: str, where: str | None) -> None:
        """A subquery in WHERE reads other tables whole; what it says of this one isn't a predicate of single rows."""
        if self._open is not None:
            nested = bool(where and re.search(r"\bSELECT\b", where, re.I))
            self._open.reads.append((table, "TRUE" if nested or not where else where))
            if nested:
                self._observe(where)

    # --- transactions ---

    def _begin(self, t: str) -> None:
        if self._open is not None:
            raise SqlError("a transaction is open")
        self._open = Transaction(dict(self.tables), dict(self.views), len(self.database.log))

    _start = _begin

    def _commit(self, t: str) -> None:
        tx, self._open, self._marks = self._open, None, []
        if tx is None:
            return
        others = [w for commit in self.database.log[tx.seen :] for w in commit]
        for w in others if tx.writes else []:
            if self._conflict(w, tx):
                self.tables, self.views = dict(self.database.tables), dict(self.database.views)
                raise SerializationError(f"serialization failure: {w.table} has changed")
        if not others:
            self.database.tables, self.database.views = dict(self.tables), dict(self.views)
        else:
            defined = {w.table for w in tx.writes if w.rows is None}
            for name in defined:
                self._adopt(name)
            for w in tx.writes:
                if w.table not in defined and w.table in self.database.tables:
                    self.database.tables[w.table] = self._replay(self.database.tables[w.table], w)
            for w in tx.writes:
                if w.table in self.database.tables:
                    self._check(self.database.tables[w.table], self.database.tables[w.table].rows)
            self.database.views = {**self.database.views, **self.views}
        if tx.writes:
            self.database.log.append(tx.writes)

    def _conflict(self, w: Write, tx: Transaction) -> bool:
        mine = {x.table for x in tx.writes}
        if w.rows is None or any(x.rows is None and x.table == w.table for x in tx.writes):
            return w.table in mine or any(table == w.table for table, _ in tx.reads)
        conditions = [p for table, p in tx.reads if table == w.table]
        if not conditions:
            return False
        if "TRUE" in conditions:
            return bool(w.rows.limit(1).count())
        met = F.lit(False)
        for p in dict.fromkeys(conditions):
            met = met | F.coalesce(F.expr(translate(p)), F.lit(False))
        return bool(w.rows.filter(met).limit(1).count())

    def _adopt(self, name: str) -> None:
        if name in self.tables:
            self.database.tables[name] = self.tables[name]
        else:
            self.database.tables.pop(name, None)

    @staticmethod
    def _replay(tab: Table, w: Write) -> Table:
        rest = tab.rows.join(w.rows.select(*tab.pk), list(tab.pk), "left_anti").select(*tab.rows.columns)
        return replace(tab, rows=rest if w.kind == "DELETE" else rest.unionByName(w.rows.select(*tab.rows.columns)))

    _end = _commit

    def _rollback(self, t: str) -> None:
        m = re.match(r"ROLLBACK\s+(?:TRANSACTION\s+)?TO\s+(?:SAVEPOINT\s+)?(\w+)$", t, re.I)
        if m:
            at = self._mark(m.group(1))
            self.tables, self.views = dict(self._marks[at][1]), dict(self._marks[at][2])
            if self._open is not None:
                del self._open.writes[self._marks[at][3] :]
            del self._marks[at + 1 :]
        elif self._open is not None:
            self.tables, self.views, self._open, self._marks = self._open.tables, self._open.views, None, []

    _abort = _rollback

    def _savepoint(self, t: str) -> None:
        if self._open is None:
            self._begin("BEGIN")
        self._marks.append((t.split()[1].lower(), dict(self.tables), dict(self.views), len(self._open.writes)))

    def _release(self, t: str) -> None:
        del self._marks[self._mark(t.split()[-1]) :]

    def _mark(self, name: str) -> int:
        at = [i for i, x in enumerate(self._marks) if x[0] == name.lower()]
        if not at:
            raise SqlError(f"no such savepoint: {name}")
        return at[-1]

    # --- helpers ---

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise SqlError(f"no such table: {name}")
        return self.tables[name]

    @staticmethod
    def _known(tab: Table, column: str) -> None:
        if column not in dict(tab.columns):
            raise SqlError(f"no such column: {column}")

    def checkpoint(self, name: str, path: str) -> None:
        """Settle a table's rows as Parquet at path, in a folder that all executors see."""
        tab = self._table(name)
        tab.rows.write.mode("errorifexists").parquet(path)
        settled = replace(tab, rows=self.spark.read.schema(tab.rows.schema).parquet(path))
        self.tables[name] = settled
        if self._open is None:
            self.database.tables[name] = settled


_HANDLED = {"CREATE", "DROP", "ALTER", "INSERT", "UPDATE", "DELETE", "BEGIN", "START", "COMMIT", "END", "ROLLBACK", "ABORT", "SAVEPOINT", "RELEASE", "SHOW", "SET"}
_WRITING = {"CREATE", "DROP", "ALTER", "INSERT", "UPDATE", "DELETE"}
