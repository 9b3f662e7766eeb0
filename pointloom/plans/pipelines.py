"""Whole maps as functions of a base table and parameters (EVT-1)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import leading_int
from ..functions.symbols import display_count, lookup, provider_type, radius, type_color, type_popup
from ..operators.filters import YearRange, by_role, in_years, need, not_blank, split_by_flag, with_flags, with_geometry, with_place
from ..operators.search import fuzzy_match, fuzzy_top, having_ids_of
from ..operators.spatial import cluster_greedily, group_by_place


@dataclass(frozen=True)
class ProviderQuery:
    flags: tuple[str, ...] = ()
    clinics: bool = False
    prescriber: bool = False
    therapist: bool = False
    search: str = ""
    search_column: str = "NEIGHBORHOODS"


def select_providers(providers: DataFrame, query: ProviderQuery) -> DataFrame:
    """The rows that a query shows; search looks at all rows and keeps by ID."""
    base = not_blank(providers, "ID", "NAME")
    rows = by_role(with_flags(split_by_flag(base, "CDPH", query.clinics), *query.flags), "ID", query.prescriber, query.therapist)
    if query.search.strip():
        rows = having_ids_of(rows, fuzzy_match(base, query.search_column, query.search), "ID")
    return rows


def provider_map(providers: DataFrame, query: ProviderQuery = ProviderQuery(), order: str = "ord") -> DataFrame:
    """A symbol for each coordinate: lat, lon, count, types, color, radius, label (SNK-1, SNK-2)."""
    placed = with_place(select_providers(providers, query), "LATITUDE", "LONGITUDE")
    groups = group_by_place(placed, "lat", "lon", order, leading_int(F.col("NUM_PROVIDERS")), provider_type(F.col("AGENCY_INDIVIDUAL")))
    n = display_count(F.col("total"), F.col("n_rows"))
    return groups.select("lat", "lon", n.alias("count"), "types", type_color(F.col("types")).alias("color"), radius(n).alias("radius"), n.cast("string").alias("label"))


def cluster_map(providers: DataFrame, query: ProviderQuery = ProviderQuery(), order: str = "ord", reach: float = 100.0, floor: float = 8, scale: float = 10) -> DataFrame:
    """A symbol for each greedy cluster, sized by its rows (AGG-5)."""
    placed = with_place(select_providers(providers, query), "LATITUDE", "LONGITUDE").select(order, "lat", "lon")
    clusters = cluster_greedily(placed, "lat", "lon", order, reach)
    return clusters.groupBy("cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("count")).withColumn("radius", radius(F.col("count"), floor, scale))


def row_markers(df: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
    """A marker for each row (SNK-3): lat, lon, name; nothing is grouped or dropped."""
    return need(df, lat, lon, name).select(F.col(f"`{lat}`").alias("lat"), F.col(f"`{lon}`").alias("lon"), F.col(f"`{name}`").alias("name"))


Rule = Column | Callable[[DataFrame], Column]


def feature_layer(rows: DataFrame, keep: Rule | None = None, **columns: Rule) -> DataFrame:
    """The rows that keep holds for, as the named columns (UDF-1).

    What a map takes as callbacks (filter, point to layer, on each feature, show result) is
    a column here, or a function that gets the rows and returns one.
    """
    value = lambda rule: rule(rows) if callable(rule) and not isinstance(rule, Column) else rule
    kept = rows if keep is None else rows.filter(value(keep))
    return kept.select(*(value(rule).alias(name) for name, rule in columns.items()))


def timeline_map(features: DataFrame, years: YearRange, colors: dict[str, str], default: str = "gray") -> DataFrame:
    """Point features of a range of years with their color and popup (FLT-6, SCL-13, PRJ-3)."""
    flat = with_geometry(features).select("properties.*", F.from_json("geometry.coordinates", "array<double>").alias("at"))
    return feature_layer(
        in_years(flat, "year", years), lat=F.get("at", F.lit(1)), lon=F.get("at", F.lit(0)), name=F.col("name"), year=F.col("year"), color=lookup(F.col("type"), colors, default), popup=type_popup(F.col("name"), F.col("type"))
    )


def migration_search(lines: DataFrame, surname: str, result: Column, limit: int = 10) -> DataFrame:
    """The best matches of a surname with their result text (SRCH-2, PRJ-4)."""
    return fuzzy_top(lines, "LNAME", surname, "ID", limit).select("ID", "score", result.alias("result"))


@dataclass(frozen=True)
class Layer:
    """A named feature set that can be shown or not (LYR-1)."""

    name: str
    rows: DataFrame
    visible: bool = True


def visible_rows(layers: list[Layer]) -> DataFrame | None:
    shown = [layer.rows.withColumn("layer", F.lit(layer.name)) for layer in layers if layer.visible]
    out = None
    for rows in shown:
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
