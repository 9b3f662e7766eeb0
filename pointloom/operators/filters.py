"""Row filters: parameters in, predicates out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import flag_on, is_number, leading_double, leading_int, text


@dataclass(frozen=True)
class YearRange:
    """An inclusive range within a domain, in whole steps from its least (PAR-1); ends are clamped, start must not be after end."""

    start: int
    end: int
    least: int = 1931
    most: int = 2023
    step: int = 1

    def __post_init__(self):
        if self.step < 1:
            raise ValueError(f"no step: {self.step}")
        whole = lambda x: self.least + (min(max(x, self.least), self.most) - self.least) // self.step * self.step
        object.__setattr__(self, "start", whole(self.start))
        object.__setattr__(self, "end", whole(self.end))
        if self.start > self.end:
            raise ValueError(f"the range {self.start}-{self.end} is empty")


def full_range(df: DataFrame, column: str, step: int = 1) -> YearRange:
    """The range of all years of a column (PAR-1); an error if none parses."""
    year = leading_int(F.col(f"`{column}`"))
    least, most = need(df, column).agg(F.min(year), F.max(year)).first()
    if least is None:
        raise ValueError(f"no year in {column}")
    return YearRange(least, most, least, most, step)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks (VAL-1)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def not_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where any of the columns is not blank (FLT-1)."""
    return need(df, *columns).filter(reduce(lambda a, b: a | b, (text(F.col(f"`{c}`")) != "" for c in columns)))


def with_flags(df: DataFrame, *flags: str) -> DataFrame:
    """Rows that have all enabled flags on (FLT-2); no flag, no filter. A missing column is off."""
    return reduce(lambda d, c: d.filter(flag_on(column_or_null(d, c))), flags, df)


def split_by_flag(df: DataFrame, flag: str, on: bool) -> DataFrame:
    """The rows with the flag, or all others, nulls included (FLT-3)."""
    hit = flag_on(column_or_null(df, flag))
    return df.filter(hit if on else ~hit)


def by_role(df: DataFrame, id_col: str, prescriber: bool, therapist: bool, prefix: str = "2") -> DataFrame:
    """Prescribers have ids that start with prefix; filters only if exactly one role is on (FLT-4)."""
    if prescriber == therapist:
        return df
    hit = text(F.col(f"`{id_col}`")).startswith(prefix)
    return need(df, id_col).filter(hit if prescriber else ~hit)


def with_place(df: DataFrame, lat: str, lon: str, out: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """Rows whose coordinates parse, with these as doubles (FLT-5)."""
    parsed = need(df, lat, lon).withColumns({out[0]: leading_double(F.col(f"`{lat}`")), out[1]: leading_double(F.col(f"`{lon}`"))})
    return parsed.filter(is_number(F.col(out[0])) & is_number(F.col(out[1])))


def in_years(df: DataFrame, column: str, years: YearRange) -> DataFrame:
    """Rows of the inclusive range; a year that doesn't parse drops (FLT-6)."""
    return need(df, column).filter(leading_int(F.col(f"`{column}`")).between(years.start, years.end))


def with_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Features that have a geometry (FLT-8)."""
    return need(df, column).filter(F.col(f"`{column}`").isNotNull())


def one_draggable(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """(key, n, is_single): how many markers of the key are draggable, and whether it is one (FLT-9)."""
    return df.groupBy(key).agg(F.count_if(flag).alias("n")).withColumn("is_single", F.col("n") == 1)
