"""Keyed state and edited feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.symbols import described
from .filters import need
from .spatial import crosses_itself, ring_area_m2


def latest(events: DataFrame, key: str, value: Column, *order: str) -> DataFrame:
    """(key, value) of the last event of each key (STA-1, SNK-6); works on streams in update mode too."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("value"))


def state_json(events: DataFrame, owner: str, key: str, value: Column, *order: str) -> DataFrame:
    """(owner, state): the last value of every key as a JSON object with sorted keys (SNK-5)."""
    last = events.groupBy(owner, key).agg(F.max_by(value, F.struct(*order)).alias("value__"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col("value__").alias("value"))))
    return last.groupBy(owner).agg(F.to_json(F.map_from_entries(entries)).alias("state"))


def read_state(c: Column, value: str = "string") -> Column:
    """A saved JSON object as a map; blank, null and broken text are empty (SRC-7)."""
    return F.coalesce(F.from_json(F.nullif(F.trim(c), F.lit("")), f"map<string,{value}>"), F.create_map().cast(f"map<string,{value}>"))


def positions(c: Column) -> Column:
    """All {lat, lng} of a saved object (SCL-26)."""
    return F.map_values(read_state(c, "struct<lat:double,lng:double>"))


def position_or(saved: Column, index: Column, marker: Column, centre: Column) -> Column:
    """The saved value at index, else the marker's own, else the centre (SCL-23)."""
    return F.coalesce(F.try_element_at(saved, index), marker, centre)


def drawn_shapes(shapes: DataFrame) -> DataFrame:
    """Drawn shapes as features (SRC-8): id, kind, type, coordinates (JSON), area_m2, is_valid, name.

    shapes: id, kind (marker, circlemarker, circle, polyline, polygon or rectangle), points
    (array of (lon, lat): the centre, the line or the open ring), name. Rings are closed;
    only they have an area, and are valid if no two edges cross. A shape of another kind,
    or with too few points for its kind, has no type and is not valid. The name is the
    description or the words for none.
    """
    kind, points = F.lower(F.trim("kind")), F.coalesce(F.col("points"), F.array().cast("array<array<double>>"))
    ring, n = kind.isin("polygon", "rectangle"), F.size(points)
    kind_of = F.when(kind.isin("marker", "circlemarker", "circle") & (n >= 1), "Point").when((kind == "polyline") & (n >= 2), "LineString").when(ring & (n >= 3), "Polygon")
    closed = F.array(F.concat(points, F.slice(points, 1, 1)))
    coordinates = F.when(kind_of == "Point", F.to_json(F.get(points, 0))).when(kind_of == "LineString", F.to_json(points)).when(kind_of == "Polygon", F.to_json(closed))
    valid = kind_of.isNotNull() & ~(ring & crosses_itself(points))
    return need(shapes, "id", "kind", "points", "name").select(
        "id", kind.alias("kind"), kind_of.alias("type"), coordinates.alias("coordinates"), F.when(kind_of == "Polygon", ring_area_m2(points)).alias("area_m2"), F.coalesce(valid, F.lit(False)).alias("is_valid"), described(F.col("name")).alias("name")
    )


def upsert(features: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Features after adds and edits (DRAW-1)."""
    return features.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(features: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return features.join(gone.select(key), key, "left_anti")
