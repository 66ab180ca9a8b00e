"""Pure functions: globs, paths, dialect, predicates. No Spark."""

import json
import re

import pytest

from tessera.functions.jsonpath import PathError, find, merge_patch, parse, read, write
from tessera.functions.text import _lcs, glob_regex
from tessera.operators.streams import parse_id
from tessera.plans import predicates as P
from tessera.plans.dialect import affinity, strip_casts, translate

DOC = {"a": {"b": [1, 2, {"c": 3}], "s": "x"}, "l": [{"p": 5, "n": "k"}, {"p": 15, "n": "m"}], "c": None}


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [("*", "", True), ("h?llo", "hello", True), ("h?llo", "hllo", False), ("h[ae]llo", "hallo", True), ("h[^e]llo", "hello", False), ("h[a-b]llo", "hbllo", True), ("a\\*", "a*", True), ("a\\*", "ab", False), ("a.c", "abc", False), ("*\n", "x\n", True)],
)
def test_glob(pattern, text, hit):
    assert bool(re.search(glob_regex(pattern), text)) is hit


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$", [DOC]), ("$.a.s", ["x"]), ("$['a']['s']", ["x"]), ("$.a.b[-1].c", [3]), ("$.a.b[0:2]", [1, 2]), ("$.a.b[0,1]", [1, 2]), ("$..c", [None, 3]), ("$.l[*].p", [5, 15]),
        ("$.l[?(@.p > 10)].n", ["m"]), ("$.l[?(@.p > 1 && @.n == 'k')].p", [5]), ("$.l[?(@.p == 5 || @.n =~ '^m')].p", [5, 15]), ("$.l[?(@.zz)]", []), ("$.none", []), ("$.l[?(!(@.p > 10))].n", ["k"]),
    ],
)
def test_paths(path, want):
    got = json.loads(read(json.loads(json.dumps(DOC)), "get", path, ()))
    assert got == want if path != "$..c" else sorted(map(str, got)) == sorted(map(str, want))


def test_old_paths_and_errors():
    assert read(DOC, "get", ".a.s", ()) == '"x"' and read(DOC, "get", "a.s", ()) == '"x"' and read(DOC, "get", "zz", ()) is None
    with pytest.raises(PathError):
        parse("$.[")
    assert find(DOC, parse("$")[1]) == [(None, None)]


def test_edits():
    fresh = lambda: json.loads(json.dumps(DOC))
    assert write(fresh(), "numincrby", "$..p", (1,))[1] == "[6,16]"
    assert write(fresh(), "del", "$.a.b[0,1]", ())[0]["a"]["b"] == [{"c": 3}]
    assert write(fresh(), "set", "$.new", (1, None))[0]["new"] == 1 and write(fresh(), "set", "$.x.y", (1, None))[1] is None
    assert write(fresh(), "set", "$.a", (1, "NX"))[1] is None and write(fresh(), "set", "$.zz", (1, "XX"))[1] is None
    assert write(fresh(), "arrpop", "$.a.b", (-1,))[1] == '[{"c":3}]' and write(fresh(), "arrtrim", "$.a.b", (1, 1))[0]["a"]["b"] == [2]
    assert write({"n": (1 << 63) - 1}, "numincrby", "$.n", (1,))[1] == f"[{-(1 << 63)}]"
    assert merge_patch({"a": 1, "b": {"c": 2}}, {"a": None, "b": {"d": 3}}) == {"b": {"c": 2, "d": 3}}


def test_lcs():
    assert _lcs("ohmytext", "mynewtext")[0] == "mytext"
    assert [r["len"] for r in _lcs("ohmytext", "mynewtext")[1]] == [4, 2]


def test_stream_ids():
    assert parse_id("5-3") == (5, 3, False) and parse_id("(5-3") == (5, 3, True) and parse_id("5", upper=True)[1] > 1 << 60 and parse_id("-")[:2] == (0, 0)


def test_dialect():
    assert strip_casts("SELECT a::int, 'x::y', b :: varchar(10) FROM t") == "SELECT a, 'x::y', b FROM t"
    assert translate("SELECT * FROM t WHERE a GLOB 'x*' AND b == 1") == "SELECT * FROM t WHERE a RLIKE r'(?s)^x.*$' AND b = 1"
    assert translate('SELECT "My Col" FROM "My Table"') == "SELECT `My Col` FROM `My Table`"
    assert [affinity(x) for x in ("INTEGER", "VARCHAR(3)", "", "REAL", "NUMERIC")] == ["bigint", "string", "binary", "double", "double"]


def test_predicate_text_round_trip():
    p = P.either(P.both(P.cmp("a", "=", 1), P.negate(P.is_null("b"))), P.between("c", "x", "y"), P.colcmp("a", "<", "d"), P.TRUE)
    assert P.Predicate.loads(p.dumps()) == p


def test_digest_is_xxh3(spark):
    import xxhash

    from tessera.operators import strings

    values = ["", "a", "Hello world", "é日本", "x" * 1_000]
    kv = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "key string, value string")
    got = {r[0]: r[1] for r in strings.digest(kv).collect()}
    assert got == {f"k{i}": xxhash.xxh3_64_hexdigest(v.encode()) for i, v in enumerate(values)}


def plain_geohash(lon, lat):
    """Eleven characters by halving intervals over the whole globe, longitude first; the last has two bits only."""
    alphabet, lons, lats, bits = "0123456789bcdefghjkmnpqrstuvwxyz", [-180.0, 180.0], [-90.0, 90.0], []
    for i in range(55):
        side, x = (lats, lat) if i % 2 else (lons, lon)
        middle = sum(side) / 2
        bits.append(int(x >= middle))
        side[1 - bits[-1]] = middle
    return "".join(alphabet[int("".join(map(str, bits[i : i + 5])), 2)] for i in range(0, 55, 5))


def test_geohash(spark):
    from tessera.operators import geo

    points = [("a", 13.361389, 38.115556), ("b", 15.087269, 37.502669), ("c", -0.1, 51.5), ("d", 179.99, -84.9)]
    g = geo.geoadd(spark.createDataFrame([("k", m, x, y) for m, x, y in points], "key string, member string, lon double, lat double"))
    got = {r.member: r.geohash for r in geo.geohash(g).collect()}
    assert got["a"][:10] == "sqc8b49rny" and got["b"][:10] == "sqdtr74hyu"
    assert all(got[m][:9] == plain_geohash(x, y)[:9] for m, x, y in points)


def test_file_formats_round_trip(spark, tmp_path):
    from tessera.sources import tables

    df = spark.createDataFrame([(1, "a", 1.5), (2, None, -2.0), (3, "c,\"x", 0.0)], "id long, s string, v double")
    for form in ("parquet", "json", "orc", "csv"):
        tables.write(df, f"{tmp_path}/{form}", form, sort_by=("id",))
        back = tables.read(spark, f"{tmp_path}/{form}", form, "id long, s string, v double")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())), form


def test_struct():
    import struct

    from tessera.functions import structs

    assert structs.pack_values(">bHi3d", (-1, 65537, -2, 0.5)) == struct.pack(">bH", -1, 1) + b"\xff\xff\xfe" + struct.pack(">d", 0.5)
    assert structs.pack_values("<!4 b i4 x c2 s", (1, 2, "abc", "z")) == b"\x01\0\0\0\x02\0\0\0\0abz\0"
    assert structs.unpack_values("<!4 b i4 x c2 s", b"\x01\0\0\0\x02\0\0\0\0abz\0") == ([1, 2, b"ab", b"z"], 14)
    assert structs.unpack_values(">Hc0B", b"\0\x02hi\xff") == ([b"hi", 255], 6)
    assert structs.size("!8 b d h") == 18 and structs.size("bd") == 9
    for form, data in (("i9", b""), ("?", b""), ("d", b"1234"), ("s", b"ab"), ("c0", b"")):
        with pytest.raises(ValueError, match=r"."):
            structs.unpack_values(form, data)
    with pytest.raises(ValueError, match="variable"):
        structs.size("s")


def test_struct_nulls(spark):
    from pyspark.sql import functions as F

    from tessera.functions import structs

    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "x"), (None, "y")], "n long, s string").select(structs.pack("<qs", F.col("n"), F.col("s")).alias("p"))
    got = [r.u for r in df.select(structs.unpack("<qs", F.col("p")).alias("u")).collect()]
    assert sorted(str(g) for g in got) == sorted(["None", str(got[0] or got[1])]) and {g.v1 for g in got if g} == {big}


def test_time_limit(spark):
    import time

    from tessera.functions.registry import ScriptError, limited

    assert limited(spark, 60, lambda: spark.range(5).count()) == 5
    began = time.time()
    with pytest.raises(ScriptError, match="stopped"):
        limited(spark, 1, lambda: spark.range(200_000_000_000).selectExpr("sum(hash(id))").collect())
    assert time.time() - began < 30 and spark.range(5).count() == 5
