"""Great-circle distance, range joins on a grid and nearest points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613
#: Points of a place in one list.
LIST = 1000


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box(lat: Column, radius: float) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of a box around a circle, half a percent wider; all longitudes where the circle holds a pole."""
    angle = radius / EARTH_MILES
    high = math.degrees(angle) * 1.005
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians(lat))))) * 1.005
    return F.lit(high), F.when(F.abs(lat) + high >= 90, 180.0).otherwise(F.least(F.lit(180.0), half))


def _places(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of different rows (lat, lng), (lat2, lng2) of the two tables of places at most ``radius`` miles apart: lat, lng, lat2, lng2, miles.

    Both sides meet in grid cells as high as the radius. Each left place enters the cells that its box
    touches, so the join is an equi-join on cells; a box crossing the date line wraps.
    """
    step = radius / (EARTH_MILES * math.pi / 180) * 1.005
    columns = max(1, int(360 / step))

    def cell(lng: Column) -> Column:
        return F.floor((lng + 180) / 360 * columns).cast("long")

    row = F.floor(F.col("lat") / step).cast("long")
    _, half = box(F.col("lat"), radius)
    spark = left.sparkSession
    left = left.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "lat", "lng")  # few rows, of which each is much work
    r = right.select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), row.alias("_r"), F.pmod(cell(F.col("lng")), F.lit(columns)).alias("_c"))
    lo, hi = cell(F.col("lng") - half), cell(F.col("lng") + half)
    cells = F.sequence(lo, F.least(hi, lo + columns - 1))
    l = left.select("lat", "lng", F.explode(F.sequence(row - 1, row + 1)).alias("_r"), cells.alias("_cs"))
    l = l.select("lat", "lng", "_r", F.explode("_cs").alias("_c")).withColumn("_c", F.pmod("_c", F.lit(columns)))
    pairs = l.join(r, ["_r", "_c"]).withColumn("miles", miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")))
    return pairs.where(F.col("miles") <= radius).select("lat", "lng", "lat2", "lng2", "miles")


def _moved(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))


def _listed(points: DataFrame, lat: str, lng: str, own: str) -> DataFrame:
    """The points of each place as lists of at most LIST of them: lat, lng and the list ``own``; points without id stay."""
    part = F.floor((F.row_number().over(Window.partitionBy(lat, lng).orderBy(own)) - 1) / LIST)
    rows = points.withColumn("_part", part).groupBy(lat, lng, "_part").agg(F.collect_list(F.struct(own)).alias("_ids"))
    return rows.select(lat, lng, F.transform("_ids", lambda x: x[own]).alias(own))


def within(left: DataFrame, right: DataFrame, radius: float, digits: int | None = None) -> DataFrame:
    """Pairs of points (id, lat, lng) at most ``radius`` miles apart: id, other, miles, rounded to ``digits`` if given.

    Distances are of places: points at one place share them, and only the pairs of places
    found near are expanded to their points.
    """
    near = _places(left.select("lat", "lng").distinct(), right.select("lat", "lng").distinct(), radius)
    if digits is not None:
        near = near.withColumn("miles", F.round("miles", digits))
    met = near.join(_listed(left, "lat", "lng", "id"), ["lat", "lng"]).join(_listed(_moved(right), "lat2", "lng2", "other"), ["lat2", "lng2"])
    return met.select(F.explode("id").alias("id"), "other", "miles").select("id", F.explode("other").alias("other"), "miles")


def nearest(left: DataFrame, right: DataFrame, n: int, radius: float) -> DataFrame:
    """The n nearest other points within ``radius`` miles: id, other, miles, rank; ties by other. An id of ``right`` is at one place.

    A place has one list of nearest points, of which each of its points leaves itself out, and no list
    takes more than the n + 1 smallest ids of a place: the work grows with the pairs of places and n.
    """
    here = Window.partitionBy("lat2", "lng2").orderBy("other")
    few = _moved(right).where("other is not null").groupBy("lat2", "lng2", "other").agg(F.count("*").alias("_n"))
    few = few.withColumn("_k", F.row_number().over(here)).where(F.col("_k") <= n + 1).drop("_k")
    held = few.groupBy("lat2", "lng2").agg(F.count("*").alias("_c"))
    near = _places(left.select("lat", "lng").distinct(), held.select(F.col("lat2").alias("lat"), F.col("lng2").alias("lng")), radius)
    near = near.withColumn("_m", F.round(F.round("miles", 9) * 1e9).cast("long")).join(held, ["lat2", "lng2"])
    there = Window.partitionBy("lat", "lng").orderBy("_m")
    closer = F.coalesce(F.sum("_c").over(there.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ids at nearer places
    listed = near.withColumn("_closer", closer).where(F.col("_closer") <= n).join(few, ["lat2", "lng2"])
    listed = listed.withColumn("_k", F.row_number().over(there.orderBy("_m", "other"))).where(F.col("_k") <= n + 1)
    own = left.select("id", "lat", "lng").join(listed.select("lat", "lng", "other", "miles", "_m", "_n"), ["lat", "lng"]).where("id != other")
    own = own.select("id", "other", "miles", "_m", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(n)))))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("_m", "other"))
    return own.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "other", "miles", "rank")
