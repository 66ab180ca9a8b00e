"""Geospatial members: g(key, member, hash), a 52-bit interleaved geohash as in sorted-set scores. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the public encoding: metres of the earth's radius, the latitude limit of the projection, the base-32
# alphabet and the units' metres.
RADIUS = 6372797.560856
LAT_MAX = 85.05112878
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
BITS = 26


def _let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of x with x evaluated once: written out, each step below would double the expression."""
    return F.transform(F.array(x), fn)[0]


def _step(shift: Callable[[Column, int], Column], by: int, mask: int) -> Callable[[Column], Column]:
    return lambda v: v.bitwiseOR(shift(v, by)).bitwiseAND(F.lit(mask))


def _spread(x: Column) -> Column:
    """Bits of a 26-bit number moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = _let(x, _step(F.shiftleft, shift, mask))
    return x


def _squash(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = _let(x, _step(F.shiftright, shift, mask))
    return x


def encode(lon: Column, lat: Column, lat_max: float = LAT_MAX) -> Column:
    """Longitude in the odd bits, latitude in the even ones, each in 2**26 steps."""
    cell = lambda v, lo, hi: F.least(F.floor((v - lo) / (hi - lo) * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    return _spread(cell(lat, -lat_max, lat_max)).bitwiseOR(F.shiftleft(_spread(cell(lon, -180.0, 180.0)), 1))


def decode(h: Column, lat_max: float = LAT_MAX) -> tuple[Column, Column]:
    """The cell's centre (lon, lat)."""
    mid = lambda c, lo, hi: lo + (c.cast("double") + 0.5) / float(1 << BITS) * (hi - lo)
    return mid(_squash(F.shiftright(h, 1)), -180.0, 180.0), mid(_squash(h), -lat_max, lat_max)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * RADIUS * F.asin(F.least(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v), F.lit(1.0)))


def geoadd(points: DataFrame) -> DataFrame:
    """points(key, member, lon, lat) encoded; those outside the projection are left out."""
    ok = F.col("lon").between(-180.0, 180.0) & F.col("lat").between(-LAT_MAX, LAT_MAX)
    return points.filter(ok).select("key", "member", encode(F.col("lon"), F.col("lat")).alias("hash"))


def geopos(g: DataFrame) -> DataFrame:
    lon, lat = decode(F.col("hash"))
    return g.withColumns({"lon": lon, "lat": lat})


def geohash(g: DataFrame) -> DataFrame:
    """The 11-character text form, on the full latitude range; its last character stands for the missing bits."""
    lon, lat = decode(F.col("hash"))
    text = lambda h: F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(h, 47 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10)], F.lit("0"))
    return g.select("key", "member", _let(encode(lon, lat, 90.0), text).alias("geohash"))


def geodist(g: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """pairs(key, a, b) with the distance between the cells' centres; null where a member is missing."""
    p = geopos(g)
    a = p.select("key", F.col("member").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = p.select("key", F.col("member").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    j = pairs.join(a, ["key", "a"], "left").join(b, ["key", "b"], "left")
    return j.select("key", "a", "b", (haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")) / UNITS[unit]).alias("dist"))


def _found(p: DataFrame, lon: Column, lat: Column, radius_m: float | None, box_m: tuple[float, float] | None) -> DataFrame:
    d = p.withColumn("dist_m", haversine(lon, lat, F.col("lon"), F.col("lat")))
    if radius_m is not None:
        # A latitude band first: a plain comparison that drops most rows before the trigonometry.
        band = radius_m / RADIUS * 57.29577951308232 + 1e-9
        return d.filter((F.abs(F.col("lat") - lat) <= band) & (F.col("dist_m") <= radius_m))
    width, height = box_m
    dy = haversine(F.col("lon"), lat, F.col("lon"), F.col("lat"))
    dx = haversine(lon, F.col("lat"), F.col("lon"), F.col("lat"))
    return d.filter((dy <= height / 2) & (dx <= width / 2))


def geosearch(g: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, desc: bool = False, any_: bool = False) -> DataFrame:
    """Members within a radius or a box (width, height) around a point, for every key: member, dist in unit, lon, lat, hash, pos.
    count keeps the nearest (or, with any_, whichever come first by member)."""
    m = UNITS[unit]
    f = _found(geopos(g), F.lit(lon), F.lit(lat), None if radius is None else radius * m, None if box is None else (box[0] * m, box[1] * m))
    order = F.col("dist_m").desc() if desc else F.col("dist_m")
    by = [F.col("member")] if any_ else [order, F.col("member")]
    r = f.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*by)) - 1)
    return (r if count is None else r.filter(F.col("pos") < count)).select("key", "member", (F.col("dist_m") / m).alias("dist"), "lon", "lat", "hash", "pos")


def geosearch_around_members(g: DataFrame, centres: DataFrame, radius: float, unit: str = "m") -> DataFrame:
    """centres(key, centre): all members within radius of each centre member. An equi-join on latitude bands as wide as
    the radius (a centre meets its own and both neighbours), then the exact distance: never all pairs of a key."""
    m = radius * UNITS[unit]
    band = max(m / RADIUS * 57.29577951308232, 1e-6)
    p = geopos(g).withColumn("band", F.floor(F.col("lat") / band))
    c = p.join(centres.select("key", F.col("centre").alias("member")), ["key", "member"], "left_semi")
    c = c.select("key", F.col("member").alias("centre"), F.col("lon").alias("clon"), F.col("lat").alias("clat"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    j = p.join(c, ["key", "band"]).withColumn("dist", haversine(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")) / UNITS[unit])
    return j.filter(F.col("dist") <= radius).select("key", "centre", "member", "dist")


def geosearchstore(found: DataFrame, key: str, store_dist: bool = False) -> DataFrame:
    """A sorted set of the result, scored by hash or distance."""
    return found.select(F.lit(key).alias("key"), "member", (F.col("dist") if store_dist else F.col("hash").cast("double")).alias("score"))
