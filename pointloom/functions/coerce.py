"""Scalar columns with lenient parsing and null handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING = ""


def text(c: Column) -> Column:
    """Trimmed text; null is blank."""
    return F.trim(F.coalesce(c.cast("string"), F.lit(MISSING)))


def leading_double(c: Column) -> Column:
    """The number that the text begins with (SCL-1); null where there is none."""
    return _prefix(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", "double")


def leading_int(c: Column) -> Column:
    """The integer that the text begins with (SCL-2)."""
    return _prefix(c, r"^\s*([+-]?\d+)", "int")


def _prefix(c: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), pattern, 1), F.lit("")).try_cast(kind)


def is_number(c: Column) -> Column:
    """Neither null nor NaN (SCL-3)."""
    return c.isNotNull() & ~F.isnan(c)


def fixed6(c: Column) -> Column:
    """The value rounded to six decimals as an integer key (SCL-4)."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5))


def flag_on(c: Column) -> Column:
    """True for y or Y only; null, missing and padded values are off. Never null."""
    return F.upper(c.cast("string")).eqNullSafe(F.lit("Y"))


def yes_no(c: Column) -> Column:
    """Y and N, trimmed and in either case, as Yes and No; other values stay (SCL-9)."""
    value = F.upper(text(c))
    return F.when(value == "Y", "Yes").when(value == "N", "No").otherwise(text(c))


def spaced(c: Column) -> Column:
    """Underscores as spaces (SCL-7)."""
    return F.translate(c, "_", " ")


def link(c: Column, scheme: str = "http") -> Column:
    """A URL with a scheme; blank stays blank (SCL-15). scheme='https' prepends to http: URLs too."""
    value = text(c)
    return F.when(value == "", value).when(value.startswith(scheme), value).otherwise(F.concat(F.lit(scheme + "://"), value))


def either(c: Column, default) -> Column:
    """The value, or default where it is null or blank (SCL-16)."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def encode_component(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) (SCL-20)."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(ch), F.lit(name))
    return out


def merged(*maps: Column) -> Column:
    """Maps merged key by key, the later one wins (SCL-22), whatever the session's key policy."""
    out = maps[0]
    for later in maps[1:]:
        out = F.map_concat(F.map_filter(out, _absent_from(later)), later)
    return out


def _absent_from(later: Column):
    return lambda k, _: ~F.map_contains_key(later, k)
