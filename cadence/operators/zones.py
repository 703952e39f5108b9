"""The zone of a coordinate: points against polygons by an equi-join on tiles; rays are cast in border tiles only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(polygons: DataFrame, zone: str = "zone", ring: str = "ring") -> DataFrame:
    """(zone, x1, y1, x2, y2) of the rings' edges, longitude as x; the last corner is joined to the first. Level edges count for no ray and are left out of rows later, not here.

    A ring is an array of (lat, lon); rows of one zone are rings of its polygon,
    of which those inside others are holes (even-odd).
    """
    corners = polygons.where(F.size(ring) >= 3).select(F.col(zone).alias("zone"), F.col(ring).alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))
    pairs = corners.select("zone", F.explode(F.arrays_zip("a", "b")).alias("e"))
    named = {"x1": F.col("e.a.lon"), "y1": F.col("e.a.lat"), "x2": F.col("e.b.lon"), "y2": F.col("e.b.lat")}
    return pairs.select("zone", *(v.cast("double").alias(k) for k, v in named.items())).dropna()


def _tile(x: Column, side: float) -> Column:
    return F.floor(x / side).cast("int")


def _x_at(y: Column, e: Column | None = None) -> Column:
    """Where an edge, not level, meets the height y."""
    c = (lambda n: F.col(n)) if e is None else (lambda n: e[n])
    return c("x1") + (y - c("y1")) / (c("y2") - c("y1")) * (c("x2") - c("x1"))


def _y_at(x: Column, e: Column) -> Column:
    return e["y1"] + (x - e["x1"]) / (e["x2"] - e["x1"]) * (e["y2"] - e["y1"])


def tiles(polygons: DataFrame, side: float = 1.0, zone: str = "zone", ring: str = "ring") -> DataFrame:
    """(ty, tx, zone, center_in, edges) of the tiles that a zone covers or whose area its edges may touch.

    ``center_in`` tells whether the middle of the tile is inside; a tile without
    edges is inside or outside as a whole, and those outside have no row. Of a
    row of tiles the middles inside lie between every other crossing of their
    height. The edges of a tile are those that pass through it, with what they
    reach of the tiles beside it for the sake of rounding: their number is that
    of the polygon's detail within one tile, whatever the number of points.
    """
    all_edges = edges(polygons, zone, ring)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = all_edges.withColumn("ty", F.explode(F.sequence(_tile(low, side), _tile(high, side))))
    # the part of the edge within the row of tiles, a little wider than it is
    margin = side * 1e-6
    bottom, top = F.greatest(low, F.col("ty") * side - margin), F.least(high, (F.col("ty") + 1) * side + margin)
    level = F.col("y1") == F.col("y2")
    reach = [F.when(level, F.col(c)).otherwise(_x_at(y)) for c, y in (("x1", bottom), ("x2", top))]
    spans = rows.withColumn("tx", F.explode(F.sequence(_tile(F.least(*reach) - margin, side), _tile(F.greatest(*reach) + margin, side))))
    border = spans.groupBy("ty", "tx", "zone").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))

    middle = (F.col("ty") + 0.5) * side
    crossed = rows.where((F.col("y1") > middle) != (F.col("y2") > middle)).groupBy("zone", "ty").agg(F.sort_array(F.collect_list(_x_at(middle))).alias("xs"))
    runs = crossed.select("zone", "ty", F.explode(F.transform(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int")), lambda k: F.struct(F.get("xs", 2 * k).alias("a"), F.get("xs", 2 * k + 1).alias("b")))).alias("run"))
    # middles within [a, b): the first at or after a, the last before b
    first, last = F.ceil(F.col("run.a") / side - 0.5).cast("int"), (F.ceil(F.col("run.b") / side - 0.5) - 1).cast("int")
    inside = runs.where(first <= last).select("zone", "ty", F.explode(F.sequence(first, last)).alias("tx"), F.lit(True).alias("center_in"))
    found = inside.join(border, ["ty", "tx", "zone"], "full")
    return found.select("ty", "tx", "zone", F.coalesce("center_in", F.lit(False)).alias("center_in"), "edges")


def _inside(lat: Column, lon: Column, side: float) -> Column:
    """Whether a point lies on the same side as its tile's middle: the way there, first up or down, then level, crosses edges an even number of times."""
    x, y = (F.col("tx") + 0.5) * side, (F.col("ty") + 0.5) * side
    upright = lambda e: ((e["x1"] > lon) != (e["x2"] > lon)) & ((_y_at(lon, e) > lat) != (_y_at(lon, e) > y))
    level = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & ((_x_at(y, e) > lon) != (_x_at(y, e) > x))
    crossings = F.size(F.filter("edges", lambda e: F.coalesce(upright(e), F.lit(False)) != F.coalesce(level(e), F.lit(False))))
    return F.when(F.col("edges").isNull(), F.col("center_in")).otherwise(F.col("center_in") != (crossings % 2 == 1))


def with_zone(points: DataFrame, polygons: DataFrame, side: float = 1.0, zone: str = "zone", ring: str = "ring", lat: str = "lat", lon: str = "lon", otherwise: str | None = None) -> DataFrame:
    """``points`` with zone: the one whose polygon holds the point, the first by name where several do, ``otherwise`` where none does.

    Distinct coordinates are looked up once each, by an equi-join on the tile;
    only those in tiles with edges meet edges, and only the edges of that tile.
    Points without a coordinate get ``otherwise``; what lies exactly on an edge
    belongs to one of its sides. Longitudes do not wrap around; rings that cross
    the date line have to be cut there.
    """
    places = points.select(F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon")).dropna().distinct()
    tiled = places.withColumns({"ty": _tile(F.col("__lat"), side), "tx": _tile(F.col("__lon"), side)})
    met = tiled.join(tiles(polygons, side, zone, ring), ["ty", "tx"]).where(_inside(F.col("__lat"), F.col("__lon"), side))
    found = met.groupBy("__lat", "__lon").agg(F.min("zone").alias("__zone"))
    joined = points.join(found, (F.col(lat).cast("double") == F.col("__lat")) & (F.col(lon).cast("double") == F.col("__lon")), "left")
    return joined.select(*points.columns, F.coalesce("__zone", F.lit(otherwise).cast("string")).alias("zone"))
