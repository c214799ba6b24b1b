"""Places within a distance of centres, by cells of space.

Points of the globe become points in space, in kilometres from its centre, and fall into cubes. A straight line is never
longer than the way over the ground, so whatever lies within a radius lies in the cube of the centre or in one of the 26
around it if cubes are as wide as the radius: places and centres meet by an equal join on cubes, at the poles and at the
date line as anywhere, and the way over the ground decides. Cubes come in several widths, a centre takes the least one
that its radius allows.

Centres of one spot and radius ask once, and a place that stands there several times under one name answers once, so
copies of either make no pairs; answers go out to all ids at the end.

Rows with a null or impossible latitude or longitude meet nothing. A radius is held to 1 to 100 km, null counts as the
usual one. Of equal names of a centre one stays; names that are null or empty are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Radius where none is given, and its bounds.
USUAL_KM, LEAST_KM, MOST_KM = 20, 1, 100
#: Widths of cubes in kilometres, halved down to near the least radius.
WIDTHS_KM = tuple(MOST_KM / 2**i for i in range(7))
# Kinds of places that count
KINDS = ("city", "town")
ON_GLOBE = "lat BETWEEN -90 AND 90 AND lon BETWEEN -360 AND 360"


def _cube(lat: Column, lon: Column, width: Column) -> list[Column]:
    """The cube of a point."""
    up, round_ = F.radians(lat), F.radians(lon)
    at = (F.cos(up) * F.cos(round_), F.cos(up) * F.sin(round_), F.sin(up))
    return [F.floor(F.lit(EARTH_KM) / width * v).cast("int").alias(name) for v, name in zip(at, ("_x", "_y", "_z"), strict=True)]


def ground_km(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """The way over the ground between two points."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat, other_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(other_lat)) * half(lon, other_lon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _asked(centres: DataFrame) -> DataFrame:
    """id, spot and radius of the centres on the globe."""
    radius = F.greatest(F.lit(LEAST_KM), F.least(F.lit(MOST_KM), F.coalesce("radius_km", F.lit(USUAL_KM))))
    return centres.filter(ON_GLOBE).select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), radius.alias("_km"))


def candidates(asked: DataFrame, places: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """_lat, _lon, _km, lat, lon, name: each distinct spot and radius with the distinct places in the cubes around it."""
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    widths = F.array(*map(F.lit, WIDTHS_KM))
    own = F.array_min(F.filter(widths, lambda w: w >= F.col("_km")))
    around = asked.select("_lat", "_lon", "_km").distinct().withColumn("_width", own)
    around = around.select("*", *_cube(F.col("_lat"), F.col("_lon"), F.col("_width")))
    for axis in ("_x", "_y", "_z"):
        around = around.withColumn("_step", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("_step")).drop("_step")
    name = F.coalesce(F.nullif("name_de", F.lit("")), F.nullif("name", F.lit("")))
    known = places.filter(ON_GLOBE).filter(F.col("kind").isin(*kinds)).select("lat", "lon", name.alias("name")).filter("name is not null").distinct()
    known = known.withColumn("_width", F.explode(widths))
    return around.join(known.select("*", *_cube(F.col("lat"), F.col("lon"), F.col("_width"))), ["_width", "_x", "_y", "_z"]).select("_lat", "_lon", "_km", "lat", "lon", "name")


def nearby(centres: DataFrame, places: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """id and name of the places (lat, lon, kind, name, name_de) around each centre (id, lat, lon, radius_km); the German
    name goes first."""
    asked = _asked(centres)
    met = candidates(asked, places, kinds).filter(ground_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= F.col("_km"))
    answers = met.groupBy("_lat", "_lon", "_km").agg(F.collect_set("name").alias("names"))
    return asked.distinct().join(answers, ["_lat", "_lon", "_km"]).select("id", F.explode("names").alias("name")).distinct()


def nearby_lists(centres: DataFrame, places: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """id, locations (sorted) and found of every centre."""
    listed = nearby(centres, places, kinds).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("locations"))
    return centres.select("id").join(listed, "id", "left").select("id", F.coalesce("locations", F.array().cast("array<string>")).alias("locations"), F.col("locations").isNotNull().alias("found"))
