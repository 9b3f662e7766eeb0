"""Removal of boilerplate lines by the number of distinct sites that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import free_name, stored


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    """The line without spaces, tabs and returns at its ends, as a digest; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def site_spread(lines: DataFrame, sites: int, lg_k: int = 12, margin: float = 0.1) -> DataFrame:
    """Keys (column key) of the lines that sites distinct sites or more show; lines has key and site.

    HyperLogLog sketches of the sites are merged for each key, before and after the
    shuffle. An estimate further than margin from the threshold decides (margin is six
    standard errors at lg_k = 12); the keys in between are counted exactly.
    """
    estimates = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    estimates = stored(estimates.filter(F.col("estimate") >= (1 - margin) * sites), "estimates")
    sure = estimates.filter(F.col("estimate") > (1 + margin) * sites).select("key")
    near = estimates.filter(F.col("estimate") <= (1 + margin) * sites).select("key")
    pairs = lines.join(near, "key", "left_semi").select("key", "site").distinct()
    exact = pairs.groupBy("key").agg(F.count("site").alias("n")).filter(F.col("n") >= sites).select("key")
    return sure.unionByName(exact)


def whole_copies(rows: DataFrame, sites: int) -> DataFrame:
    """One row (column row) of each text that sites distinct sites or more show as a whole: that of least id.

    rows has row, id, whole (a digest of the text) and site. Rows without id count as sites
    do, and are taken only where no row has an id.
    """
    first = [F.min_by("first", "id").alias("first"), F.min("any").alias("any"), F.min("id").alias("id")]
    each = rows.filter("whole is not null").withColumn("first", F.col("row")).withColumn("any", F.col("row")).groupBy("whole", "site").agg(*first)
    return each.groupBy("whole").agg(*first, F.count("site").alias("n")).filter(F.col("n") >= sites).select(F.coalesce("first", "any").alias("row"))


def remove_boilerplate(
    docs: DataFrame,
    sites: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    out: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and the two counts named by out.

    A line (between line feeds; spaces, tabs and returns at its ends don't count) is
    boilerplate if at least sites distinct sites show it. Every occurrence goes, whatever
    its share of the document, which may be left empty. Only of a text that as a whole is
    on that many sites does one copy, that of least id, stay as it is (rows that repeat
    both id and text stay together). Blank lines stay. A null site is no site. Null and
    empty texts stay as they are and have 0 lines and 1 line; rows with null ids and
    repeated rows are treated like others. Columns of any other name pass through.

    Rows are matched by 128 bits of their id and text.
    """
    id_, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    row_col, gone_col = free_name(docs, "row"), free_name(docs, "gone")
    row = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.length(id_).cast("string"), F.lit(":"), id_), F.lit("null:")), text)))
    exploded = docs.select(row.alias("row"), F.col(f"`{site_col}`").cast("string").alias("site"), F.posexplode(F.transform(_lines(text), _key)).alias("at", "key")).filter("key is not null")
    keys = stored(site_spread(exploded.select("key", "site"), sites), "boilerplate")
    marked = exploded.join(keys, "key").groupBy("row").agg(F.collect_set("at").alias("gone"))
    wholes = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text)).alias("whole"), F.col(f"`{site_col}`").cast("string").alias("site"))
    marked = marked.join(whole_copies(wholes, sites), "row", "left_anti").select(F.col("row").alias(row_col), F.col("gone").alias(gone_col))
    joined = docs.withColumn(row_col, row).join(marked, row_col, "left").drop(row_col)
    lines, gone = _lines(text), F.col(gone_col)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    return (
        joined.withColumn(out[0], F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn(out[1], F.when(gone.isNotNull(), F.size(gone)).otherwise(0).cast("long"))
        .withColumn(text_col, F.when(gone.isNotNull(), F.array_join(kept, "\n")).otherwise(text))
        .drop(gone_col)
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = 10) -> DataFrame:
    """A row per input row: id, n_lines, n_removed, n_chars_kept, kept_sha256 (null text: the digest of nothing)."""
    wanted = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), F.col(f"`{site_col}`").alias("site"))
    done = remove_boilerplate(wanted, sites, "id", "body", "site")
    body = F.coalesce("body", F.lit(""))
    return done.select(F.col("id").alias(id_col), "n_lines", "n_removed", F.length(body).cast("long").alias("n_chars_kept"), F.sha2(body, 256).alias("kept_sha256"))


LINE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM {documents}),
l AS (
  SELECT r, source, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT r, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL)),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
b AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {sites}),
m AS (SELECT t.*, b.bare IS NOT NULL AS gone FROM t LEFT JOIN b USING (bare)),
s AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM m GROUP BY r),
w AS (SELECT text AS whole, min(doc_id) AS least FROM d WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) >= {sites}),
f AS (
  SELECT d.*, coalesce(n_lines, 0) AS n_lines, n_gone, kept, coalesce(n_gone, 0) > 0 AND (w.whole IS NULL OR d.doc_id IS DISTINCT FROM w.least) AS worth
  FROM d LEFT JOIN s USING (r) LEFT JOIN w ON d.text = w.whole)
"""

LINE_REPORT_SQL = (
    LINE_SQL
    + """
SELECT doc_id, n_lines, CAST(CASE WHEN worth THEN n_gone ELSE 0 END AS BIGINT) AS n_removed,
       CAST(length(CASE WHEN worth THEN kept ELSE coalesce(text, '') END) AS BIGINT) AS n_chars_kept,
       sha256(CASE WHEN worth THEN kept ELSE coalesce(text, '') END) AS kept_sha256
FROM f
"""
)
