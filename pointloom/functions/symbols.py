"""Map symbols: categories, colors, sizes, labels, popups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .coerce import either, escape_html, leading_int, link, spaced, text, yes_no

# Spellings of provider types, and the colors of symbols.
AGENCY = ("A", "AGENCY", "AGENCIES")
INDIVIDUAL = ("I", "INDIVIDUAL", "INDIVIDUALS")
MIXED = ("BOTH", "MIXED")
#: Columns whose Y and N are shown as Yes and No.
YES_NO = ("VIRTUAL", "MEDICAID", "PMH_C", "CDPH")
#: What a drawn object without a description is shown as, and the prompt that counts as none.
UNDESCRIBED, PROMPT = "-- no description provided --", "geometry description"
COLORS = {"both": "violet", "agency": "blue", "individual": "red", "other": "gray"}


def lookup(key: Column, table: dict[str, str], default) -> Column:
    """A dictionary constant with a default (JOIN-2)."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default) if isinstance(default, str) else default)


def provider_type(c: Column) -> Column:
    """agency, individual, mixed or unknown (SCL-11)."""
    value = F.upper(text(c))
    return F.when(value.isin(*AGENCY), "agency").when(value.isin(*INDIVIDUAL), "individual").when(value.isin(*MIXED), "mixed").otherwise("unknown")


def type_color(types: Column) -> Column:
    """The color of a set of types (SCL-12); mixed alone is gray."""
    agency, individual = F.array_contains(types, "agency"), F.array_contains(types, "individual")
    return F.when(agency & individual, COLORS["both"]).when(agency, COLORS["agency"]).when(individual, COLORS["individual"]).otherwise(COLORS["other"])


def radius(n: Column, floor: float = 6, scale: float = 3) -> Column:
    """A radius that grows with the root of n (SCL-14)."""
    return F.greatest(F.lit(float(floor)), F.sqrt(n) * F.lit(float(scale)))


def icon(c: Column) -> Column:
    """agency for its spellings, individual for all else (PRJ-5)."""
    return F.when(F.upper(text(c)).isin(*AGENCY), "agency").otherwise("individual")


def count_label(c: Column) -> Column:
    """The count where it parses to more than 0, else null (PRJ-6)."""
    n = leading_int(c)
    return F.when(n > 0, n)


def display_count(total: Column, rows: Column) -> Column:
    """The total, or the number of rows if it is 0 or missing (AGG-2)."""
    return F.when(F.coalesce(total, F.lit(0)) != 0, total).otherwise(rows)


def details(columns: list[str], hidden: tuple[str, ...] = (), labels: dict[str, str] | None = None, answers: tuple[str, ...] = YES_NO) -> Column:
    """Label and value of the shown columns that are not blank (FLT-7, PRJ-1, SCL-10); Y and N as words in answers only."""
    shown = [c for c in columns if c not in hidden and not c.startswith("Unnamed")]
    pairs = [F.struct(F.lit((labels or {}).get(c, c.replace("_", " "))).alias("label"), (yes_no if c in answers else text)(F.col(f"`{c}`")).alias("value")) for c in shown]
    return F.filter(F.array(*pairs), lambda x: x["value"] != "") if pairs else F.array().cast("array<struct<label:string,value:string>>")


def popup(title: Column, pairs: Column, url: Column | None = None) -> Column:
    """Escaped HTML of a title, an optional link and a detail table (PRJ-2)."""
    rows = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("<tr><th>"), escape_html(x["label"]), F.lit("</th><td>"), escape_html(x["value"]), F.lit("</td></tr>"))), "")
    head = F.concat(F.lit("<b>"), escape_html(either(title, "Provider")), F.lit("</b>"))
    if url is not None:
        target = escape_html(link(url))
        head = F.when(text(url) == "", head).otherwise(F.concat(F.lit('<a href="'), target, F.lit('">'), head, F.lit("</a>")))
    return F.concat(head, F.lit("<table>"), rows, F.lit("</table>"))


def caption(label: Column, title: Column, index: Column, own: Column | None = None) -> Column:
    """A marker's caption: the label of its field, else its title, else "Marker " and its own label or index (PRJ-7)."""
    number = index.cast("string")
    if own is not None:
        number = F.coalesce(F.nullif(own.cast("string"), F.lit("")), number)
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(title, F.lit("")), F.concat(F.lit("Marker "), number))


def type_popup(name: Column, kind: Column) -> Column:
    """A feature's name and type as escaped HTML (PRJ-3)."""
    return F.concat(F.lit("<h3>"), escape_html(name), F.lit("</h3>Type: "), escape_html(kind), F.lit(" "))


def person_popup(first: Column, last: Column, birthplace: Column, station: Column, note: str = "") -> Column:
    """A person, where they were born and recruited, and a note, as escaped HTML (PRJ-3)."""
    head = F.concat(F.lit("<h3>"), escape_html(first), F.lit(" "), escape_html(last), F.lit("</h3>"))
    places = F.concat(F.lit("<strong>Birthplace: </strong>"), escape_html(birthplace), F.lit("<br><strong>Rec Station: </strong>"), escape_html(station))
    return F.concat(head, places, F.lit("<br><br><i>"), escape_html(F.lit(note)), F.lit("</i>"))


def result_text(last: Column, first: Column, city: Column) -> Column:
    """A search hit: last name, then the first name or, without a last name, the city (PRJ-4)."""
    return F.trim(F.concat_ws(" ", F.nullif(last, F.lit("")), F.when(text(last) != "", first).otherwise(city)))


def described(c: Column) -> Column:
    """A description, or the words for none where it is null, blank or the prompt itself (SCL-25)."""
    return F.when(text(c).isin("", PROMPT), UNDESCRIBED).otherwise(text(c))


def key_label(c: Column, labels: dict[str, str]) -> Column:
    return lookup(c, labels, spaced(c))
