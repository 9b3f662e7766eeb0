"""Readers and writers of CSV, GeoJSON and script literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.coerce import encode_component

FEATURE = "struct<type:string,properties:string,geometry:string>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, infer: bool = False) -> DataFrame:
    """CSV with a header; all strings, or typed by schema or inference (SRC-1, SRC-2). Broken files fail as a whole."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)


def _features(text: DataFrame, items: Column, properties: str) -> DataFrame:
    row = F.explode(items).alias("f")
    out = text.select(row).select(F.from_json("f.properties", properties).alias("properties"), F.from_json("f.geometry", "struct<type:string,coordinates:string>").alias("geometry"))
    return out


def _literal(c: Column) -> Column:
    """The value of a script's assignment."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\x{FEFF}]*(?:(?:var|let|const)\s+)?[A-Za-z_$][\w$]*\s*=\s*", ""), r";\s*$", "")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties, geometry) of a FeatureCollection, also as a script literal (SRC-3, SRC-4)."""
    text = spark.read.text(path, wholetext=True).select(_literal(F.col("value")).alias("v"))
    return _features(text, F.from_json("v", f"struct<features:array<{FEATURE}>>")["features"], properties)


def read_feature_array(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The same for a bare array of features in a script literal (SRC-5)."""
    text = spark.read.text(path, wholetext=True).select(_literal(F.col("value")).alias("v"))
    return _features(text, F.from_json("v", f"array<{FEATURE}>"), properties)


def coordinates(geometry: Column) -> Column:
    """Points as one-point, lines as they are, multi-lines as their joined lines: array of (lon, lat) (SRC-6)."""
    raw = geometry["coordinates"]
    return (
        F.when(geometry["type"] == "Point", F.array(F.from_json(raw, "array<double>")))
        .when(geometry["type"] == "LineString", F.from_json(raw, "array<array<double>>"))
        .when(geometry["type"] == "MultiLineString", F.flatten(F.from_json(raw, "array<array<array<double>>>")))
    )


def feature_json(properties: Column, lon: Column, lat: Column) -> Column:
    """A point feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))


def collection_json(features: DataFrame, feature: str, order: str) -> DataFrame:
    """All features as one FeatureCollection text (SNK-4): as large as its features, so for exports of bounded size."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(feature).alias("f")))), lambda x: x["f"])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(items, ","), F.lit("]}")).alias("geojson"))


def data_uri(c: Column) -> Column:
    """A text in the form of a data URI, without the comma that a reader of such URIs asks for: files of this form exist."""
    return F.concat(F.lit("data:text/json;charset=utf-8"), encode_component(c))


def legend(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    """Color and label rows (SNK-7)."""
    return spark.createDataFrame([(color, label) for label, color in entries.items()], "color string, label string")
