"""Grouping and measuring points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import fixed6
from .filters import need

EARTH_M = 6_371_000.0


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (SCL-17)."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def group_by_place(df: DataFrame, lat: str, lon: str, order: str, total: Column, kind: Column, rows: Column | None = None) -> DataFrame:
    """One row for each coordinate rounded to six decimals (AGG-1).

    The first row's coordinates, the sum of total (1 where null), the sorted set of kinds
    but unknown, the number of rows and, if asked for, the rows in order. Without rows all
    aggregates are combined before the shuffle; with them a group is as large as its rows.
    """
    keyed = df.withColumns({"klat__": fixed6(F.col(lat)), "klon__": fixed6(F.col(lon)), "n__": F.coalesce(total, F.lit(1)), "kind__": F.when(kind != "unknown", kind)})
    aggs = [
        F.min_by(F.col(lat), F.col(order)).alias("lat"),
        F.min_by(F.col(lon), F.col(order)).alias("lon"),
        F.sum("n__").alias("total"),
        F.array_sort(F.collect_set("kind__")).alias("types"),
        F.count("*").alias("n_rows"),
    ]
    if rows is not None:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), rows.alias("row"))))
        aggs.append(F.transform(ordered, lambda x: x["row"]).alias("rows"))
    return keyed.groupBy("klat__", "klon__").agg(*aggs).drop("klat__", "klon__")


def joined_popups(html: Column, order: Column) -> Column:
    """An aggregate: the popups of a group in order, blank ones left out, between rules (AGG-7)."""
    items = F.array_sort(F.collect_list(F.when(F.coalesce(html, F.lit("")) != "", F.struct(order.alias("ord"), html.alias("html")))))
    return F.array_join(F.transform(items, lambda x: x["html"]), "<hr/>")


def assign_greedily(points: Iterator[tuple[float, float]], reach: float) -> list[int]:
    """Cluster number of each point in order: the first cluster whose current centre is within reach, else a new one.

    A grid over the centres leaves only near clusters to be measured; the first one in
    order among them is taken, as a scan over all would.
    """
    centres: list[list[float]] = []
    grid: dict[tuple[int, int], set[int]] = {}
    step_lat = math.degrees(reach / EARTH_M) * 1.01

    def step_lon(lat: float) -> float:
        return step_lat / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + step_lat))))

    def cell(lat: float, lon: float) -> tuple[int, int]:
        return math.floor(lat / step_lat), math.floor(lon / step_lat)

    out = []
    for lat, lon in points:
        i, _ = cell(lat, lon)
        wide = math.ceil(step_lon(lat) / step_lat)
        j = math.floor(lon / step_lat)
        near = sorted(c for a in (i - 1, i, i + 1) for b in range(j - wide, j + wide + 1) for c in grid.get((a, b), ()))
        for c in near:
            y, x, n = centres[c]
            h = math.sin(math.radians(lat - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - x) / 2) ** 2
            if 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h))) <= reach:
                grid[cell(y, x)].discard(c)
                n += 1
                centres[c] = [(y * (n - 1) + lat) / n, (x * (n - 1) + lon) / n, n]
                grid.setdefault(cell(*centres[c][:2]), set()).add(c)
                out.append(c)
                break
        else:
            centres.append([lat, lon, 1])
            grid.setdefault(cell(lat, lon), set()).add(len(centres) - 1)
            out.append(len(centres) - 1)
    return out


def cluster_greedily(df: DataFrame, lat: str, lon: str, order: str, reach: float = 100.0, within: tuple[str, ...] = ()) -> DataFrame:
    """df with a column cluster (AGG-3): one ordered pass, since membership depends on every earlier point.

    The exact form takes all rows in one task. Columns named in within split the pass by
    their values; that is another result, meant for large inputs. Distance to the antimeridian
    is not wrapped.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(cluster=assign_greedily(zip(pdf[lat].astype(float), pdf[lon].astype(float)), reach))

    return df.groupBy(*within).applyInPandas(run, _with(df, "cluster bigint"))


def _with(df: DataFrame, column: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), column])


def grid_cell(lat: Column, lon: Column, zoom: int, pixels: int = 64) -> tuple[Column, Column]:
    """Column and row of the Web-Mercator grid at a zoom (AGG-4)."""
    scale = 256.0 * 2**zoom / pixels
    s = F.sin(F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))))
    x = (lon + F.lit(180.0)) / F.lit(360.0)
    y = F.lit(0.5) - F.log((1 + s) / (1 - s)) / F.lit(4 * math.pi)
    return F.floor(x * F.lit(scale)), F.floor(y * F.lit(scale))


def grid_clusters(df: DataFrame, lat: str, lon: str, zoom: int, pixels: int = 64) -> DataFrame:
    """Count and mean coordinates of each grid cell."""
    x, y = grid_cell(F.col(lat), F.col(lon), zoom, pixels)
    return df.groupBy(x.alias("cell_x"), y.alias("cell_y")).agg(F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def bounds(df: DataFrame, lat: str, lon: str, pad: float = 0.2) -> DataFrame:
    """The bounding box with a margin of pad of its size on each side (AGG-6); nulls for no rows."""
    box = df.agg(*(f(c).alias(f"{n}_{c}") for c in (lat, lon) for f, n in ((F.min, "min"), (F.max, "max"))))
    span = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    return box.select(
        (F.col(f"min_{lat}") - pad * span(lat)).alias("south"), (F.col(f"min_{lon}") - pad * span(lon)).alias("west"),
        (F.col(f"max_{lat}") + pad * span(lat)).alias("north"), (F.col(f"max_{lon}") + pad * span(lon)).alias("east"),
    )


def nearest_place(points: DataFrame, gazetteer: DataFrame, id_col: str, reach_m: float = 50_000.0) -> DataFrame:
    """The address of the nearest gazetteer entry in reach of each point, or the no-result text (SRC-9).

    points: id, lat, lon; gazetteer: place, formatted_address, lat, lon. Rows of cells are as
    high as reach_m; each row is cut into as many cells as its circle of latitude, where it
    is shortest, holds reaches. A point meets the entries of its cell and of the neighbouring
    cells, around the globe; a row near a pole is one cell. Of entries at one distance the
    first address in order is taken. A point without coordinates, or with ones that are no
    place on the globe, is a failed lookup.
    """
    if not 0 < reach_m <= EARTH_M * math.pi / 4:
        raise ValueError(f"reach_m must be above 0 and at most an eighth of the globe: {reach_m}")
    need(points, id_col, "lat", "lon"), need(gazetteer, "formatted_address", "lat", "lon")
    step = math.degrees(reach_m / EARTH_M) * 1.001
    valid = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    row = F.floor((F.col("lat") + 90) / F.lit(step))

    def cells(cy: Column) -> Column:
        """How many cells the row has: a reach is never wider than one of them."""
        far = F.least(F.lit(90.0), F.greatest(F.abs(cy * F.lit(step) - 90), F.abs((cy + 1) * F.lit(step) - 90)) + F.lit(step))
        # within reach, longitudes differ by asin(sin(reach) / cos(latitude)) at most
        ratio = F.lit(math.sin(math.radians(step))) / F.cos(F.radians(far))
        return F.when((far >= 90) | (ratio >= 1), 1).otherwise(F.greatest(F.floor(F.lit(360.0) / F.degrees(F.asin(F.least(ratio, F.lit(1.0))))), F.lit(1))).cast("long")

    def column(cy: Column) -> Column:
        return F.pmod(F.floor((F.col("lon") + 180) / 360 * cells(cy)), cells(cy))

    # an entry stands in its own row and in the next ones, in the cell of its longitude there and the cells beside it
    rows = gazetteer.filter(valid).select("formatted_address", F.col("lat").alias("glat"), F.col("lon").alias("glon"), "lon", F.explode(F.array(row - 1, row, row + 1)).alias("cy"))
    beside = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(column(F.col("cy")) + k, cells(F.col("cy")))))
    entries = rows.select("formatted_address", "glat", "glon", "cy", F.explode(beside).alias("cx"))
    keyed = points.filter(valid).select(id_col, "lat", "lon", row.alias("cy")).withColumn("cx", column(F.col("cy")))
    met = keyed.join(entries, ["cy", "cx"]).withColumn("m", distance_m(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon"))).filter(F.col("m") <= reach_m)
    best = met.groupBy(id_col).agg(F.min_by("formatted_address", F.struct("m", "formatted_address")).alias("found"))
    out = points.join(best, id_col, "left")
    return out.withColumn("address", F.when(F.coalesce(valid, F.lit(False)), F.coalesce("found", F.lit("No results found"))).otherwise("Geocoder failed due to: INVALID_REQUEST")).drop("found")


def find_place(queries: DataFrame, gazetteer: DataFrame, column: str = "place") -> DataFrame:
    """Coordinates of a place's name and whether there is one (SRC-10)."""
    known = gazetteer.groupBy(F.lower(F.trim("place")).alias("k__")).agg(F.min(F.struct("lat", "lon")).alias("p__"))
    joined = queries.join(known, F.lower(F.trim(F.col(f"`{column}`"))) == F.col("k__"), "left")
    return joined.select(*(queries[c] for c in queries.columns), F.col("p__.lat").alias("lat"), F.col("p__.lon").alias("lon"), F.col("p__").isNotNull().alias("is_valid"))


def ring_area_m2(ring: Column) -> Column:
    """Area of a ring of (lon, lat) pairs on the sphere (SCL-24)."""
    n = F.size(ring)
    lon = lambda i: F.radians(F.get(F.get(ring, i), F.lit(0)))
    lat = lambda i: F.radians(F.get(F.get(ring, i), F.lit(1)))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (lon((i + 1) % n) - lon(i)) * (2 + F.sin(lat(i)) + F.sin(lat((i + 1) % n))))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(n < 3, 0.0).otherwise(F.abs(total) * F.lit(EARTH_M**2 / 2))


def crosses_itself(ring: Column) -> Column:
    """Whether two edges of an open ring that don't share an end cross (SCL-24)."""
    n = F.size(ring)
    at = lambda i, k: F.get(F.get(ring, i), F.lit(k))
    side = lambda a, b, c: F.signum((at(b, 0) - at(a, 0)) * (at(c, 1) - at(a, 1)) - (at(b, 1) - at(a, 1)) * (at(c, 0) - at(a, 0)))

    def cross(i: Column, j: Column) -> Column:
        a, b, c, d = i, (i + 1) % n, j, (j + 1) % n
        apart = (j > i + 1) & ~((i == 0) & (j == n - 1))
        return apart & (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)

    every = F.sequence(F.lit(0), n - 1)
    return F.when(n < 4, False).otherwise(F.exists(every, lambda i: F.exists(every, lambda j: F.coalesce(cross(i, j), F.lit(False)))))
