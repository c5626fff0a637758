"""Places: lookup keys, great-circle distance and remote wording."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ColumnLike, col, strip

# Earth radius in miles; remote wordings; places that have no coordinates.
EARTH_RADIUS_MILES = 3958.8
REMOTE_WORDS = ("remote", "work from home", "wfh", "fully remote", "home based")
NOT_A_PLACE = ("", "remote", "uk-wide", "nationwide", "flexible")
LOCATION_KEY_CHARS = 80


def is_remote(location: ColumnLike) -> Column:
    return F.lower(F.coalesce(col(location), F.lit(""))).rlike("|".join(REMOTE_WORDS))


def non_geocodable(location: ColumnLike) -> Column:
    """The location, or NULL when it names no place."""
    location = col(location)
    return F.when(~F.lower(location).isin(*NOT_A_PLACE), location)


def location_key(location: ColumnLike) -> Column:
    """Lookup key: anything but letters, digits, space, ``_`` and ``-`` becomes ``_``."""
    safe = F.regexp_replace(col(location), r"[^\p{L}\p{N} _-]", "_")
    return F.substring(strip(safe), 1, LOCATION_KEY_CHARS)


def haversine_miles(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(EARTH_RADIUS_MILES * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_miles(
    lat: ColumnLike, lon: ColumnLike, home_lat: float, home_lon: float, radius: float
) -> Column:
    """Distance test with a latitude band first, which a column-store scan can prune on."""
    reach = math.degrees(radius / EARTH_RADIUS_MILES) * 1.000001
    band = col(lat).between(home_lat - reach, home_lat + reach)
    return band & (haversine_miles(F.lit(home_lat), F.lit(home_lon), lat, lon) <= radius)


def geocode(df: DataFrame, locations: DataFrame, location: str = "location") -> DataFrame:
    """Add ``lat`` and ``lon`` from a ``locations(location_key, lat, lon)`` dimension.

    A plain left join: adaptive execution broadcasts the dimension when it measures it small
    and splits a skewed place otherwise.
    """
    place = locations.select(
        F.col("location_key").alias("_place_key"), F.col("lat"), F.col("lon")
    )
    keyed = df.withColumn("_place", location_key(non_geocodable(location)))
    return keyed.join(place, keyed["_place"] == place["_place_key"], "left").drop("_place", "_place_key")
