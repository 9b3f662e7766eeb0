"""Approximate substring search and the joins that go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filters import need


def allowed_errors(query: str, tenths: int) -> int:
    """The greatest e with 10 * e <= tenths * len(query)."""
    return tenths * len(query) // 10


def substring_errors(field: Column, query: str, most: int) -> Column:
    """The least edit distance between query and any substring of field up to most; null if greater.

    Pieces first: with most errors, one of most + 1 pieces of the query is in the field
    unchanged, so fields without any are told apart by plain containment.
    """
    m = len(query)
    value = F.lower(F.coalesce(field, F.lit("")))
    cuts = [m * i // (most + 1) for i in range(most + 2)]
    pieces = [query[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    maybe = F.lit(False)
    for piece in pieces:
        maybe = maybe | F.contains(value, F.lit(piece))
    starts = F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)))
    widths = F.array(*(F.lit(w) for w in range(max(1, m - most), m + most + 1)))
    near = lambda i: F.transform(widths, lambda w: F.levenshtein(F.substring(value, i, w), F.lit(query), most))  # -1 beyond most
    best = F.array_min(F.filter(F.flatten(F.transform(starts, near)), lambda e: e >= 0))
    return F.when(maybe & (F.length(value) > 0), best)


def fuzzy_match(df: DataFrame, column: str, query: str | None, tenths: int = 4, score: str = "score") -> DataFrame:
    """Rows whose column holds the query with few enough errors (SRCH-1), with e / len(query) as score.

    A blank query is no filter (score 0). Distinct texts are searched once and joined back.
    """
    query = (query or "").strip().lower()
    if not query:
        return df.withColumn(score, F.lit(0.0))
    most = allowed_errors(query, tenths)
    key = f"{column}__key"
    texts = need(df, column).select(F.col(f"`{column}`").alias(key)).filter(f"`{key}` is not null").distinct()
    hits = texts.withColumn("e__", substring_errors(F.col(key), query, most)).filter("e__ is not null")
    hits = hits.select(key, (F.col("e__") / F.lit(len(query))).alias(score))
    return df.join(hits, df[column] == hits[key]).drop(key)


def fuzzy_top(df: DataFrame, column: str, query: str, id_col: str, limit: int = 10, tenths: int = 5) -> DataFrame:
    """The limit best rows, ties by id (SRCH-2)."""
    return fuzzy_match(df, column, query, tenths).orderBy("score", id_col).limit(limit)


def having_ids_of(df: DataFrame, matched: DataFrame, column: str, other: str | None = None) -> DataFrame:
    """Rows whose id is among the matched ids; nulls match nulls (JOIN-1)."""
    ids = matched.select(F.col(f"`{other or column}`").alias("id__")).distinct()
    return df.join(ids, df[column].eqNullSafe(ids["id__"]), "left_semi")


def pair_layers(origins: DataFrame, ends: DataFrame, key: str = "ID") -> DataFrame:
    """Origin and destination of each key as a two-point line (JOIN-3); both layers have lon and lat."""
    a = origins.select(key, F.array("lon", "lat").alias("from__"))
    b = ends.select(key, F.array("lon", "lat").alias("to__"))
    return a.join(b, key).select(key, F.array("from__", "to__").alias("line"))
