"""Administrative regions: polygons as tiles of edges, point in polygon, snapping, and two-level labels.

A polygon row is (ord, name, rings) with rings as array<array<struct<lon,lat>>>; outer rings and holes are
alike, since an even number of crossings means outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
SNAP_DEG = 0.05
TILE_DEG = 1.0
ASSIGN_DEG = 0.5  # side of the tiles in which points look for their polygon
CLEAR_DEG = 1e-6  # a covered tile keeps this far from every edge


def edges(polygons: DataFrame) -> DataFrame:
    """One row per edge: ord, name, ring, edge, x1, y1, x2, y2."""
    rings = polygons.select("ord", "name", F.posexplode("rings").alias("ring", "pts"))
    sides = rings.select("ord", "name", "ring", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("pts") - 1),
        lambda i: F.struct(F.element_at("pts", i).alias("a"), F.element_at("pts", i + 1).alias("b"))))
        .alias("edge", "s"))
    return sides.select("ord", "name", "ring", "edge",
                        F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"),
                        F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2"))


def bounds(polygons: DataFrame) -> DataFrame:
    return edges(polygons).groupBy("ord", "name").agg(
        F.min(F.least("x1", "x2")).alias("west"), F.min(F.least("y1", "y2")).alias("south"),
        F.max(F.greatest("x1", "x2")).alias("east"), F.max(F.greatest("y1", "y2")).alias("north"))


def tiles(polygons: DataFrame, margin: float = SNAP_DEG, tile_deg: float = TILE_DEG) -> DataFrame:
    """One row per polygon and tile its box touches, with the edges that matter there.

    For a crossing count only edges beside or to the right of the tile count; for snapping, edges within
    the margin. Each row carries only those, so a long coastline is split over its tiles.
    """
    cut = lambda v: F.floor(v / tile_deg)
    box = bounds(polygons)
    span = box.select("ord", "name", "west", "south", "east", "north",
                      F.explode(F.sequence(cut(F.col("south") - margin), cut(F.col("north") + margin))).alias("ty"))
    span = span.withColumn("tx", F.explode(
        F.sequence(cut(F.col("west") - margin), cut(F.col("east") + margin))))
    sides = edges(polygons)
    low, high = F.least("y1", "y2") - margin, F.greatest("y1", "y2") + margin
    banded = sides.withColumn("ty", F.explode(F.sequence(cut(low), cut(high))))
    near = span.join(banded.drop("name"), ["ord", "ty"]).where(
        F.greatest("x1", "x2") >= F.col("tx") * tile_deg - margin)
    return (near.groupBy("ord", "name", "tx", "ty", "west", "south", "east", "north")
            .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("sides")))


def deciding_tiles(polygons: DataFrame, margin: float = SNAP_DEG) -> DataFrame:
    """tiles() of side ASSIGN_DEG without the polygons that no point of their tile can get.

    A polygon covers a tile that none of its edges meets and whose middle it holds. Every point there then goes to it or
    to a polygon before it in order, so polygons behind the first cover are left out: what a point meets does not grow
    with the number of polygons that overlap.
    """
    found = tiles(polygons, margin, ASSIGN_DEG)
    west, south = F.col("tx") * ASSIGN_DEG - CLEAR_DEG, F.col("ty") * ASSIGN_DEG - CLEAR_DEG
    east, north = west + ASSIGN_DEG + 2 * CLEAR_DEG, south + ASSIGN_DEG + 2 * CLEAR_DEG

    def meets(e):
        boxed = ((F.least(e["x1"], e["x2"]) <= east) & (F.greatest(e["x1"], e["x2"]) >= west)
                 & (F.least(e["y1"], e["y2"]) <= north) & (F.greatest(e["y1"], e["y2"]) >= south))
        side = [(e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) for x in (west, east) for y in (south, north)]
        return boxed & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

    covers = ~F.exists("sides", meets) & is_inside((west + east) / 2, (south + north) / 2, F.col("sides"))
    marked = found.withColumn("_cover", F.when(covers, F.col("ord")))
    first = marked.groupBy("tx", "ty").agg(F.min("_cover").alias("_first"))
    return (marked.join(first, ["tx", "ty"]).where(F.col("_first").isNull() | (F.col("ord") <= F.col("_first")))
            .drop("_cover", "_first"))


def is_inside(x: Column, y: Column, sides: Column) -> Column:
    """Even-odd rule: does a ray to the right cross an odd number of edges?"""
    def crosses(e):
        meets = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(meets, e["y2"] - e["y1"]).otherwise(1.0)
        return meets & (x < at)
    return F.size(F.filter(sides, crosses)) % 2 == 1


def edge_distance(x: Column, y: Column, sides: Column) -> Column:
    """Degrees to the nearest of the edges."""
    def gap(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = dx * dx + dy * dy
        t = ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.when(length == 0, 1.0).otherwise(length)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        ox, oy = x - e["x1"] - t * dx, y - e["y1"] - t * dy
        return F.sqrt(ox * ox + oy * oy)
    return F.array_min(F.transform(sides, gap))


def assign(points: DataFrame, polygons: DataFrame, key: str, lon: str = "lon", lat: str = "lat",
           label: str = "region", snap: bool = True) -> DataFrame:
    """Adds the region of each point: the first polygon that holds it, else the nearest edge in reach.

    Points meet only the polygons of their own tile, up to the first that covers it. The test against a polygon needs no
    shuffle, and the choice among polygons is a combining aggregate, so crowded tiles split freely.
    """
    margin = SNAP_DEG if snap else 0.0
    x, y = F.col(lon), F.col(lat)
    spots = points.select(key, lon, lat, F.floor(x / ASSIGN_DEG).alias("tx"), F.floor(y / ASSIGN_DEG).alias("ty"))
    near = spots.join(deciding_tiles(polygons, margin), ["tx", "ty"]).where(
        x.between(F.col("west") - margin, F.col("east") + margin)
        & y.between(F.col("south") - margin, F.col("north") + margin))
    judged = near.withColumn("inside", is_inside(x, y, F.col("sides"))).withColumn(
        "gap", edge_distance(x, y, F.col("sides")) if snap else F.lit(None).cast("double"))
    held = F.min(F.when(F.col("inside"), F.struct("ord", "name")))
    close = F.min(F.when(~F.col("inside") & (F.col("gap") <= SNAP_DEG), F.struct("gap", "ord", "name")))
    found = judged.groupBy(key).agg(held.alias("held"), close.alias("close")).select(
        key, F.when(F.col("held").isNotNull(), F.col("held.name")).otherwise(F.col("close.name")).alias(label))
    return points.join(found, key, "left")


def geolocate(locations: DataFrame, states: DataFrame, districts: DataFrame, key: str) -> DataFrame:
    """State and district of each location; locations outside every state are dropped, district may be NULL."""
    box = bounds(states).agg(
        (F.min("west") - SNAP_DEG).alias("west"), (F.min("south") - SNAP_DEG).alias("south"),
        (F.max("east") + SNAP_DEG).alias("east"), (F.max("north") + SNAP_DEG).alias("north"))
    limits = box.select(F.struct("*").alias("b")).scalar()
    inside = locations.withColumn("_b", limits).where(
        F.col("lon").between(F.col("_b.west"), F.col("_b.east"))
        & F.col("lat").between(F.col("_b.south"), F.col("_b.north"))).drop("_b")
    known = assign(inside, states, key, label="state").where("state IS NOT NULL")
    return assign(known, districts, key, label="city")


def relevant_locations(locations: DataFrame, years: list[int]) -> DataFrame:
    """Locations with a position whose listed years meet the wanted ones."""
    wanted = F.array(*[F.lit(y) for y in years])
    return locations.where(F.col("lat").isNotNull() & F.arrays_overlap("years", wanted))


def only_states(rows: DataFrame, names: list[str], column: str = "state") -> DataFrame:
    """Rows of the named states, compared without case, accents or punctuation."""
    from skyhive.functions.columns import match_key
    wanted = [match_key(F.lit(n)) for n in names]
    return rows.where(match_key(column).isin(*wanted))
