"""Every operator applied to the benchmark tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import coerce, symbols
from ..operators import filters, search, spatial, state
from ..sources import io
from ..session import work_dir
from .pipelines import Layer, ProviderQuery, cluster_map, feature_layer, migration_search, provider_map, row_markers, timeline_map, visible_rows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Deterministic places of customers, as the tables have none.
LAT_SQL = "(41.6::double + (c_custkey % 17)::double * 0.00413::double)"
LON_SQL = "(-87.9::double + ((c_custkey * 31) % 13)::double * 0.0045::double)"
COLORS = {"BUILDING": "blue", "MACHINERY": "red", "FURNITURE": "green"}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.lit(41.6) + (F.col("c_custkey") % 17).cast("double") * F.lit(0.00413)
    lon = F.lit(-87.9) + ((F.col("c_custkey") * 31) % 13).cast("double") * F.lit(0.0045)
    return table(spark, sf_dir, "customer").withColumns({"lat": lat, "lon": lon})


def _provider_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Agency").when(F.col("c_mktsegment") == "MACHINERY", "individuals").when(F.col("c_mktsegment") == "FURNITURE", "Both")
    return places(spark, sf_dir).withColumns({"kind": symbols.provider_type(kind), "n": F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") % 5).cast("int"))})


_KIND_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'agency' WHEN 'MACHINERY' THEN 'individual' WHEN 'FURNITURE' THEN 'mixed' ELSE 'unknown' END"
_GROUP_SQL = f"""
WITH p AS (SELECT *, {LAT_SQL} AS lat, {LON_SQL} AS lon, {_KIND_SQL} AS kind, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 ELSE 1 END AS n FROM customer),
g AS (SELECT arg_min(lat, c_custkey) AS lat, arg_min(lon, c_custkey) AS lon, CAST(sum(n) AS BIGINT) AS total,
             coalesce(list_sort(list(DISTINCT kind) FILTER (kind <> 'unknown')), []) AS types, count(*) AS n_rows
      FROM p GROUP BY floor(lat * 1e6 + 0.5), floor(lon * 1e6 + 0.5))
"""
_COLOR_SQL = "CASE WHEN list_contains(types, 'agency') AND list_contains(types, 'individual') THEN 'violet' WHEN list_contains(types, 'agency') THEN 'blue' WHEN list_contains(types, 'individual') THEN 'red' ELSE 'gray' END"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE upper(l_returnflag) IS NOT DISTINCT FROM 'R' AND upper(l_linestatus) IS NOT DISTINCT FROM 'F'")
def flag_filter(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "y").alias("VIRTUAL"), F.when(F.col("l_linestatus") == "F", "Y").alias("MEDICAID"))
    return filters.with_flags(flags, "VIRTUAL", "MEDICAID").select("l_orderkey", "l_linenumber")


def _clinics(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Y").when(F.col("o_orderstatus") == "O", "N").alias("CDPH"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def partition_on(spark, sf_dir):
    return filters.split_by_flag(_clinics(spark, sf_dir), "CDPH", True).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def partition_off(spark, sf_dir):
    return filters.split_by_flag(_clinics(spark, sf_dir), "CDPH", False).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '2')")
def role_prefix(spark, sf_dir):
    return filters.by_role(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", True, False)


@query("SELECT o_orderkey FROM orders WHERE NOT starts_with(CAST(o_orderkey AS VARCHAR), '2')")
def role_complement(spark, sf_dir):
    return filters.by_role(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", False, True)


@query("SELECT doc_id FROM documents WHERE trim(coalesce(text, ''), ' ') <> '' OR trim(coalesce(source, ''), ' ') <> ''")
def blank_drop(spark, sf_dir):
    return filters.not_blank(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "text", "source").select("doc_id")


@query("SELECT event_id FROM events WHERE upper(json_extract_string(props, '$.hidden')) IS DISTINCT FROM 'Y'")
def json_missing_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.hidden").alias("hidden"))
    return filters.split_by_flag(events, "hidden", False).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def year_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"))
    return filters.in_years(orders, "year", filters.YearRange(1996, 1998)).select("o_orderkey")


@query("SELECT p_partkey, try_cast(nullif(regexp_extract(p_size || 'x cm', '^\\s*([+-]?\\d+)', 1), '') AS INTEGER) AS size, try_cast(nullif(regexp_extract(p_retailprice || ' usd', '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS price, try_cast(nullif(regexp_extract(p_brand, '^\\s*([+-]?\\d+)', 1), '') AS INTEGER) IS NULL AS no_number FROM part")
def prefix_number(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        coerce.leading_int(F.concat(F.col("p_size").cast("string"), F.lit("x cm"))).alias("size"),
        coerce.leading_double(F.concat(F.col("p_retailprice").cast("string"), F.lit(" usd"))).alias("price"),
        coerce.leading_int(F.col("p_brand")).isNull().alias("no_number"),
    )


@query(f"SELECT c_custkey, {_KIND_SQL} AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN 'blue' WHEN 'MACHINERY' THEN 'red' WHEN 'FURNITURE' THEN 'green' ELSE 'gray' END AS color, CASE c_mktsegment WHEN 'BUILDING' THEN 'agency' ELSE 'individual' END AS icon FROM customer")
def classify_color(spark, sf_dir):
    rows = _provider_like(spark, sf_dir)
    raw = F.when(F.col("c_mktsegment") == "BUILDING", " agency ")
    return rows.select("c_custkey", "kind", symbols.lookup(F.col("c_mktsegment"), COLORS, "gray").alias("color"), symbols.icon(raw).alias("icon"))


def _grouped(spark, sf_dir):
    return spatial.group_by_place(_provider_like(spark, sf_dir), "lat", "lon", "c_custkey", F.col("n"), F.col("kind"))


@query(_GROUP_SQL + "SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, total, array_to_string(types, ',') AS types, n_rows FROM g")
def coord_group(spark, sf_dir):
    return _grouped(spark, sf_dir).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "total", F.array_join("types", ",").alias("types"), "n_rows")


@query(_GROUP_SQL + f"SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, {_COLOR_SQL} AS color, round(greatest(6.0::double, sqrt(CASE WHEN total <> 0 THEN total ELSE n_rows END) * 3), 6) AS radius FROM g")
def symbol_radius(spark, sf_dir):
    n = symbols.display_count(F.col("total"), F.col("n_rows"))
    return _grouped(spark, sf_dir).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), symbols.type_color(F.col("types")).alias("color"), F.round(symbols.radius(n), 6).alias("radius"))


@query(f"SELECT c_custkey, round(2 * 6371000.0::double * asin(least(1.0, sqrt(pow(sin(radians(({LAT_SQL}) - 41.63::double) / 2), 2) + cos(radians(41.63::double)) * cos(radians({LAT_SQL})) * pow(sin(radians(({LON_SQL}) - (-87.87::double)) / 2), 2)))), 3) AS metres FROM customer")
def distance_from_center(spark, sf_dir):
    return places(spark, sf_dir).select("c_custkey", F.round(spatial.distance_m(F.lit(41.63), F.lit(-87.87), F.col("lat"), F.col("lon")), 3).alias("metres"))


_FUZZY_SQL = "list_min(flatten(list_transform(range(1, length({f}) + 1), lambda i: list_transform(range({lo}, {hi} + 1), lambda w: levenshtein(substring({f}, i, w), '{q}')))))"


def _fuzzy_sql(field: str, q: str, k: int) -> str:
    return _FUZZY_SQL.format(f=f"lower({field})", lo=max(1, len(q) - k), hi=len(q) + k, q=q)


@query(f"SELECT p_partkey, {_fuzzy_sql('p_name', 'wigdet', 2)} / 6.0::double AS score FROM part WHERE {_fuzzy_sql('p_name', 'wigdet', 2)} <= 2")
def fuzzy_part_name(spark, sf_dir):
    return search.fuzzy_match(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", " Wigdet ").select("p_partkey", "score")


@query(f"SELECT p_partkey, {_fuzzy_sql('p_name', 'gizmoo', 3)} / 6.0::double AS score FROM part WHERE {_fuzzy_sql('p_name', 'gizmoo', 3)} <= 3 ORDER BY score, p_partkey LIMIT 10")
def fuzzy_topk(spark, sf_dir):
    return search.fuzzy_top(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "gizmoo", "p_partkey").select("p_partkey", "score")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def semi_join_ids(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return search.having_ids_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), chosen, "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_0' THEN 'Zero' WHEN 'NATION_1' THEN 'One' ELSE replace(n_name, '_', ' ') END AS label FROM nation")
def lookup_default(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", symbols.key_label(F.col("n_name"), {"NATION_0": "Zero", "NATION_1": "One"}).alias("label"))


@query(f"WITH b AS (SELECT min({LAT_SQL}) AS a, max({LAT_SQL}) AS b, min({LON_SQL}) AS c, max({LON_SQL}) AS d FROM customer) SELECT round(a - 0.2 * (b - a), 6) AS south, round(c - 0.2 * (d - c), 6) AS west, round(b + 0.2 * (b - a), 6) AS north, round(d + 0.2 * (d - c), 6) AS east FROM b")
def bbox_padded(spark, sf_dir):
    box = spatial.bounds(places(spark, sf_dir), "lat", "lon")
    return box.select(*(F.round(c, 6).alias(c) for c in box.columns))


_MERC = "sin(radians(lat))"


@query(f"WITH p AS (SELECT {LAT_SQL} AS lat, {LON_SQL} AS lon FROM customer) SELECT CAST(floor((lon + 180) / 360 * 262144) AS BIGINT) AS cell_x, CAST(floor((0.5 - ln((1 + {_MERC}) / (1 - {_MERC})) / (4 * pi())) * 262144) AS BIGINT) AS cell_y, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM p GROUP BY 1, 2")
def grid_cluster(spark, sf_dir):
    found = spatial.grid_clusters(places(spark, sf_dir), "lat", "lon", zoom=16)
    return found.select("cell_x", "cell_y", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _greedy_sql(points: str, key: str, reach: float) -> str:
    """The clusters (i, key, lat, lon, cluster) of an ordered pass; points has i from 1 on, key, lat, lon."""
    metres = "2 * 6371000.0::double * asin(least(1.0, sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2))))"
    moved = "{'lat': (c.lat * c.n + q.lat) / (c.n + 1), 'lon': (c.lon * c.n + q.lon) / (c.n + 1), 'n': c.n + 1}"
    return f"""
WITH RECURSIVE p AS ({points}),
s AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS {key}, 0::DOUBLE AS lat, 0::DOUBLE AS lon, 0::BIGINT AS cluster, []::STRUCT(lat DOUBLE, lon DOUBLE, n BIGINT)[] AS cs
  UNION ALL
  SELECT q.i, q.{key}, q.lat, q.lon, q.hit - 1,
         CASE WHEN q.hit <= len(q.cs) THEN list_transform(q.cs, lambda c, j: CASE WHEN j = q.hit THEN {moved} ELSE c END) ELSE list_append(q.cs, {{'lat': q.lat, 'lon': q.lon, 'n': 1::BIGINT}}) END
  FROM (SELECT p.i, p.{key}, p.lat, p.lon, s.cs, coalesce(nullif(list_position(list_transform(s.cs, lambda c: {metres} <= {reach}), true), 0), len(s.cs) + 1)::BIGINT AS hit
        FROM s JOIN p ON p.i = s.i + 1) AS q),
clusters AS (SELECT i, {key}, lat, lon, cluster FROM s WHERE i > 0)
"""


@query(_greedy_sql(f"SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey, {LAT_SQL} AS lat, {LON_SQL} AS lon FROM customer", "c_custkey", 500.0) + "SELECT c_custkey, lat, lon, cluster FROM clusters")
def greedy_cluster(spark, sf_dir):
    return spatial.cluster_greedily(places(spark, sf_dir).select("c_custkey", "lat", "lon"), "lat", "lon", "c_custkey", 500.0)


@query("SELECT s_nationkey, string_agg('<b>' || s_name || '</b><table><tr><th>s suppkey</th><td>' || s_suppkey || '</td></tr></table>', '<hr/>' ORDER BY s_suppkey) AS html FROM supplier GROUP BY s_nationkey")
def group_concat_html(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    html = symbols.popup(F.col("s_name"), symbols.details(["s_suppkey", "s_nationkey"], hidden=("s_nationkey",)))
    return supplier.groupBy("s_nationkey").agg(spatial.joined_popups(html, F.col("s_suppkey")).alias("html"))


@query("""SELECT '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","properties":{"name":"' || s_name || '"},"geometry":{"type":"Point","coordinates":[' || s_suppkey || ',' || s_nationkey || ']}}', ',' ORDER BY s_suppkey) || ']}' AS geojson FROM supplier""")
def geojson_export(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    features = supplier.select("s_suppkey", io.feature_json(F.struct(F.col("s_name").alias("name")), F.col("s_suppkey"), F.col("s_nationkey").cast("long")).alias("feature"))
    return io.collection_json(features, "feature", "s_suppkey")


@query("SELECT user_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return state.latest(table(spark, sf_dir, "events"), "user_id", F.col("value"), "ts", "event_id")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n, count(*) FILTER (o_orderstatus = 'F') = 1 AS is_single FROM orders GROUP BY o_custkey")
def draggable_count(spark, sf_dir):
    return filters.one_draggable(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


@query("SELECT user_id, '{' || string_agg('\"' || event_type || '\":\"' || event_id || '\"', ',' ORDER BY event_type) || '}' AS state FROM (SELECT user_id, event_type, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def state_as_json(spark, sf_dir):
    return state.state_json(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("event_id").cast("string"), "ts", "event_id")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size ELSE 0 END AS label, 'http://' || lower(p_brand) AS url, 'Marker ' || p_partkey AS caption, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS answer FROM part")
def display_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        F.coalesce(symbols.count_label(F.when(F.col("p_size") > 20, F.concat(F.col("p_size").cast("string"), F.lit(" staff"))).otherwise("Unknown")), F.lit(0)).alias("label"),
        coerce.link(F.lower("p_brand")).alias("url"),
        symbols.caption(F.lit(""), F.lit(None).cast("string"), F.col("p_partkey")).alias("caption"),
        coerce.yes_no(F.when(F.col("p_size") > 25, " y").otherwise("N")).alias("answer"),
    )


@query("SELECT s_suppkey, 'k%20' || s_suppkey || '~(x)!' AS code, CAST(floor(s_acctbal + 0.5) AS BIGINT) AS rounded FROM supplier")
def encoded(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select("s_suppkey", coerce.encode_component(F.concat(F.lit("k "), F.col("s_suppkey").cast("string"), F.lit("~(x)!"))).alias("code"), coerce.round_half_up(F.col("s_acctbal")).alias("rounded"))


@query("SELECT s_suppkey AS id, s_name || '-new' AS name FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal BETWEEN 0 AND 9000")
def draw_edits(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    named = lambda rows, name: rows.select(F.col("s_suppkey").alias("id"), name.alias("name"))
    edits = named(supplier.filter("s_acctbal < 0"), F.concat("s_name", F.lit("-new")))
    edited = state.upsert(named(supplier, F.col("s_name")), edits)
    return state.delete(edited, named(supplier.filter("s_acctbal > 9000"), F.col("s_name")))


@query("SELECT s_suppkey AS id, s_nationkey AS key, 'suppliers' AS layer FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 'customers' FROM customer")
def layers(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("key"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"))
    return visible_rows([Layer("suppliers", suppliers), Layer("customers", customers), Layer("hidden", suppliers, visible=False)])


@query(f"WITH g AS (SELECT n_name, 41.6::double + (n_nationkey % 5)::double * 0.0137 AS lat, -87.9::double + floor(n_nationkey / 5.0::double) * 0.0113 AS lon FROM nation), p AS (SELECT c_custkey, {LAT_SQL} AS lat, {LON_SQL} AS lon FROM customer), d AS (SELECT p.c_custkey, g.n_name, round(2 * 6371000.0::double * asin(least(1.0, sqrt(pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2)))), 3) AS m FROM p, g) SELECT p.c_custkey, coalesce(arg_min(d.n_name, row(m, d.n_name)) FILTER (m <= 400), 'No results found') AS address FROM p LEFT JOIN d USING (c_custkey) GROUP BY p.c_custkey")
def reverse_geocode(spark, sf_dir):
    points = places(spark, sf_dir).select("c_custkey", "lat", "lon")
    lat = F.lit(41.6) + (F.col("n_nationkey") % 5).cast("double") * F.lit(0.0137)
    lon = F.lit(-87.9) + F.floor(F.col("n_nationkey") / F.lit(5.0)) * F.lit(0.0113)
    entries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("formatted_address"), lat.alias("lat"), lon.alias("lon"))
    return spatial.nearest_place(points, entries, "c_custkey", reach_m=400.0).select("c_custkey", "address")


@query("SELECT n_nationkey, r_regionkey::double AS lat, r_regionkey IS NOT NULL AS is_valid FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def place_lookup(spark, sf_dir):
    gazetteer = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.concat(F.lit(" Region "), F.col("r_regionkey").cast("string")).alias("place"), F.col("r_regionkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("place"))
    return spatial.find_place(asked, gazetteer).select("n_nationkey", "lat", "is_valid")


def providers(spark, sf_dir):
    """Customers as a provider table in which every column is text, with what such tables hold: junk, blanks, units."""
    key = F.col("c_custkey")
    lat = F.when(key % 11 == 0, "abc").when(key % 11 == 1, "").otherwise(F.concat(F.lit(" "), F.col("lat").cast("string"), F.lit("x")))
    return places(spark, sf_dir).select(
        key.alias("ord"),
        key.cast("string").alias("ID"),
        F.when(key % 3 > 0, F.col("c_name")).alias("NAME"),
        lat.alias("LATITUDE"),
        F.col("lon").cast("string").alias("LONGITUDE"),
        F.when(key % 10 == 0, "Y").when(key % 10 < 9, "N").alias("CDPH"),
        F.when(key % 2 == 0, "y").otherwise("N").alias("VIRTUAL"),
        F.when(key % 7 == 0, "Unknown").when(key % 7 == 1, "0").otherwise(F.concat((key % 7).cast("string"), F.lit(" staff"))).alias("NUM_PROVIDERS"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Agency").when(F.col("c_mktsegment") == "MACHINERY", "individuals").when(F.col("c_mktsegment") == "FURNITURE", "Both").alias("AGENCY_INDIVIDUAL"),
        F.col("c_mktsegment").alias("NEIGHBORHOODS"),
    )


def _map_sql(where: str) -> str:
    return f"""
WITH p AS (SELECT *, {LAT_SQL} AS lat, {LON_SQL} AS lon, {_KIND_SQL} AS kind, CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE c_custkey % 7 END AS n
           FROM customer WHERE c_custkey % 11 > 1 AND {where}),
g AS (SELECT arg_min(lat, c_custkey) AS lat, arg_min(lon, c_custkey) AS lon, CAST(sum(n) AS BIGINT) AS total,
             coalesce(list_sort(list(DISTINCT kind) FILTER (kind <> 'unknown')), []) AS types, count(*) AS n_rows
      FROM p GROUP BY floor(lat * 1e6 + 0.5), floor(lon * 1e6 + 0.5)),
c AS (SELECT *, CASE WHEN total <> 0 THEN total ELSE n_rows END AS "count" FROM g)
SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, "count", array_to_string(types, ',') AS types, {_COLOR_SQL} AS color, round(greatest(6.0::double, sqrt("count") * 3), 6) AS radius, CAST("count" AS VARCHAR) AS label FROM c"""


def _map(spark, sf_dir, asked: ProviderQuery):
    found = provider_map(providers(spark, sf_dir), asked)
    return found.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "count", F.array_join("types", ",").alias("types"), "color", F.round("radius", 6).alias("radius"), "label")


@query(_map_sql("c_custkey % 10 > 0"))
def map_default(spark, sf_dir):
    return _map(spark, sf_dir, ProviderQuery())


@query(_map_sql("c_custkey % 10 = 0 AND c_custkey % 2 = 0"))
def map_clinics(spark, sf_dir):
    return _map(spark, sf_dir, ProviderQuery(flags=("VIRTUAL",), clinics=True))


@query(_map_sql(f"c_custkey % 10 > 0 AND NOT starts_with(CAST(c_custkey AS VARCHAR), '2') AND {_fuzzy_sql('c_mktsegment', 'machinry', 3)} <= 3"))
def map_search(spark, sf_dir):
    return _map(spark, sf_dir, ProviderQuery(therapist=True, search=" Machinry"))


@query(_map_sql("false"))
def map_empty(spark, sf_dir):
    return _map(spark, sf_dir, ProviderQuery(search="nothing of this kind"))


@query(
    _greedy_sql(f"SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey, {LAT_SQL} AS lat, {LON_SQL} AS lon FROM customer WHERE c_custkey % 11 > 1 AND c_custkey % 10 > 0", "c_custkey", 500.0)
    + 'SELECT cluster, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS "count", round(greatest(8.0::double, sqrt(count(*)) * 10), 6) AS radius FROM clusters GROUP BY cluster'
)
def map_clusters(spark, sf_dir):
    found = cluster_map(providers(spark, sf_dir), reach=500.0)
    return found.select("cluster", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "count", F.round("radius", 6).alias("radius"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, round({LAT_SQL}, 6) AS lat, round({LON_SQL}, 6) AS lon FROM customer WHERE c_custkey % 11 > 1")
def parsed_places(spark, sf_dir):
    return filters.with_place(providers(spark, sf_dir), "LATITUDE", "LONGITUDE").select(F.col("ID").alias("id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 > 1 THEN CAST(c_custkey % 7 AS INTEGER) ELSE -1 END AS label, round(greatest(8.0::double, sqrt(c_custkey) * 4), 6) AS middle, round(greatest(8.0::double, sqrt(c_custkey) * 10), 6) AS large FROM customer")
def symbol_sizes(spark, sf_dir):
    rows = providers(spark, sf_dir)
    key = F.col("ord")
    return rows.select(key.alias("c_custkey"), F.coalesce(symbols.count_label(F.col("NUM_PROVIDERS")), F.lit(-1)).alias("label"), F.round(symbols.radius(key, 8, 4), 6).alias("middle"), F.round(symbols.radius(key, 8, 10), 6).alias("large"))


@query("SELECT p_partkey, 'VIRTUAL=' || CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END || '|grade=' || CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'y' END || '|Name of part=' || p_name AS details FROM part")
def answer_columns(spark, sf_dir):
    """Only the named columns show Y and N as words."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, " y").otherwise("n ").alias("VIRTUAL"), F.when(F.col("p_size") % 2 == 0, "N").otherwise("y").alias("grade"), F.col("p_name").alias("p_name"), F.lit(" ").alias("blank"), F.lit("x").alias("Unnamed: 7")
    )
    pairs = symbols.details(part.columns, hidden=("p_partkey",), labels={"p_name": "Name of part"})
    return part.select("p_partkey", F.array_join(F.transform(pairs, lambda x: F.concat(x["label"], F.lit("="), x["value"])), "|").alias("details"))


def _as_csv(spark, df: DataFrame) -> str:
    path = f"{work_dir(spark)}/table.csv"
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name || ', \"of\" ' || s_nationkey || chr(10) || 'line' AS name, length(CAST(s_suppkey AS VARCHAR)) AS digits FROM supplier")
def csv_strings(spark, sf_dir):
    name = F.concat(F.col("s_name"), F.lit(', "of" '), F.col("s_nationkey").cast("string"), F.lit("\nline"))
    path = _as_csv(spark, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name")))
    return io.read_csv(spark, path).select("id", "name", F.length("id").cast("long").alias("digits"))


@query("SELECT s_suppkey AS id, s_acctbal AS balance, s_suppkey * 2 AS twice FROM supplier")
def csv_schema(spark, sf_dir):
    path = _as_csv(spark, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))
    return io.read_csv(spark, path, schema="id bigint, balance double").withColumn("twice", F.col("id") * 2)


@query("SELECT CAST(p_size AS INTEGER) AS size, 'NA' AS code, p_retailprice AS price, p_partkey % 2 = 0 AS even FROM part")
def csv_inferred(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = _as_csv(spark, part.select(F.col("p_size").alias("size"), F.lit("NA").alias("code"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 2 == 0).alias("even")))
    return io.read_csv(spark, path, infer=True)


#: Suppliers as features: points, lines and multi-lines by turns; every fifth has no geometry.
_PROPERTIES = "id bigint, name string"


def _features(spark, sf_dir) -> DataFrame:
    key, lat = F.col("s_suppkey"), F.col("s_nationkey")
    point = lambda d: F.array(key + d, lat)
    text = lambda c: F.to_json(c)
    geometry = (
        F.when(key % 5 == 0, "null")
        .when(key % 3 == 0, F.concat(F.lit('{"type":"Point","coordinates":'), text(point(0)), F.lit("}")))
        .when(key % 3 == 1, F.concat(F.lit('{"type":"LineString","coordinates":'), text(F.array(point(0), point(1))), F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"MultiLineString","coordinates":'), text(F.array(F.array(point(0), point(1)), F.array(point(2), point(3)))), F.lit("}")))
    )
    properties = F.to_json(F.struct(key.alias("id"), F.col("s_name").alias("name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature"))


def _as_script(spark, sf_dir, before: str, after: str) -> str:
    path = f"{work_dir(spark)}/features.js"
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "feature"))), lambda x: x["feature"]), ",\n")
    _features(spark, sf_dir).agg(F.concat(F.lit(before), each, F.lit(after)).alias("value")).coalesce(1).write.text(path)
    return path


def _shapes(features: DataFrame) -> DataFrame:
    at = io.coordinates(F.col("geometry"))
    last = F.element_at(at, -1)
    return features.select("properties.id", "properties.name", F.coalesce(F.array_size(at), F.lit(0)).cast("long").alias("vertices"), F.get(last, 0).alias("lon"), F.get(last, 1).alias("lat"))


_SHAPES_SQL = """SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE [1, 2, 4][s_suppkey % 3 + 1] END::BIGINT AS vertices,
CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey + [0, 1, 3][s_suppkey % 3 + 1] END::DOUBLE AS lon, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END::DOUBLE AS lat FROM supplier"""


@query(_SHAPES_SQL)
def geojson_features(spark, sf_dir):
    return _shapes(io.read_geojson(spark, _as_script(spark, sf_dir, '{"type":"FeatureCollection","name":"x","features":[', "]}"), _PROPERTIES))


@query(_SHAPES_SQL)
def script_features(spark, sf_dir):
    return _shapes(io.read_geojson(spark, _as_script(spark, sf_dir, '\ufeffvar shapes_1 = {"type":"FeatureCollection","features":[', "]};\n"), _PROPERTIES))


@query(_SHAPES_SQL + " WHERE s_suppkey % 5 <> 0")
def script_array(spark, sf_dir):
    """Features without a geometry yield no marker."""
    return _shapes(filters.with_geometry(io.read_feature_array(spark, _as_script(spark, sf_dir, "let rows=[", "] ; "), _PROPERTIES)))


@query("SELECT user_id, count(*) AS positions, count(DISTINCT event_type) AS keys, sum(event_id)::DOUBLE AS lat FROM (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) GROUP BY user_id")
def saved_positions(spark, sf_dir):
    """Saved objects, read back as maps and as positions; broken ones are empty."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    entry = F.struct("event_type", F.struct(F.struct(F.col("event_id").cast("double").alias("lat"), F.lit(1.0).alias("lng")).alias("latLng")).alias("value"))
    saved = last.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("field"))
    plain = F.regexp_replace("field", r'\{"latLng":(\{[^}]*\})\}', "$1")
    at = state.positions(plain)
    return saved.select(
        "user_id",
        F.size(at).cast("long").alias("positions"),
        (F.size(F.map_keys(state.read_state(F.col("field")))) + F.size(state.read_state(F.lit(" "))) + F.size(state.read_state(F.lit("{broken")))).cast("long").alias("keys"),
        F.aggregate(at, F.lit(0.0), lambda a, x: a + x["lat"]).alias("lat"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'saved' WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'centre' END AS place FROM orders")
def position_defaults(spark, sf_dir):
    key = F.col("o_orderkey")
    saved = state.read_state(F.when(key % 3 == 0, '{"0":"saved"}').when(key % 3 == 1, '{"1":"other"}').otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", state.position_or(saved, F.lit("0"), F.when(key % 3 == 1, F.col("o_orderstatus")), F.lit("centre")).alias("place"))


_RING_SQL = "[[s_nationkey, 10], [s_nationkey + 1 + s_suppkey % 4, 10], [s_nationkey + 1, 11], [s_nationkey, 11 + s_suppkey % 2]]"


@query(
    f"""WITH r AS (SELECT s_suppkey, s_name, s_suppkey % 4 AS k, {_RING_SQL} AS p FROM supplier),
a AS (SELECT *, abs(list_sum(list_transform(range(4), lambda i: radians(p[(i + 1) % 4 + 1][1] - p[i + 1][1]) * (2 + sin(radians(p[i + 1][2])) + sin(radians(p[(i + 1) % 4 + 1][2])))))) * pow(6371000.0, 2) / 2 AS area FROM r)
SELECT s_suppkey AS id, CASE k WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Point' END AS "type", CASE WHEN k = 0 THEN round(area / 1e6, 3) END AS km2, k < 3 AS is_valid,
       CASE WHEN s_suppkey % 5 < 3 THEN '-- no description provided --' ELSE s_name END AS name,
       CASE k WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS vertices FROM a"""
)
def drawn_features(spark, sf_dir):
    key, at = F.col("s_suppkey"), lambda *xy: F.array(*(F.col("s_nationkey").cast("double") + xy[0], F.lit(float(xy[1])) + xy[2]))
    points = F.array(at(0, 10, 0), at(1 + key % 4, 10, 0), at(1, 11, 0), at(0, 11, key % 2))
    kind = F.when(key % 4 == 0, " Polygon").when(key % 4 == 1, "polyline").when(key % 4 == 2, "circleMarker").otherwise("blob")
    name = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, " ").when(key % 5 == 2, "geometry description").otherwise(F.col("s_name"))
    drawn = state.drawn_shapes(table(spark, sf_dir, "supplier").select(key.alias("id"), kind.alias("kind"), points.alias("points"), name.alias("name")))
    numbers = F.regexp_count("coordinates", F.lit("[0-9.]+,[0-9.]+"))
    return drawn.select("id", "type", F.round(F.col("area_m2") / 1e6, 3).alias("km2"), "is_valid", "name", F.coalesce(numbers, F.lit(0)).cast("long").alias("vertices"))


@query("SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS crosses FROM supplier")
def crossing_rings(spark, sf_dir):
    """A bow tie crosses itself, a square doesn't."""
    key = F.col("s_suppkey").cast("double")
    corner = lambda dx, dy: F.array(key + dx, key + dy)
    square, tie = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)), F.array(corner(0, 0), corner(1, 1), corner(1, 0), corner(0, 1))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), spatial.crosses_itself(F.when(F.col("s_suppkey") % 2 == 0, tie).otherwise(square)).alias("crosses"))


@query("SELECT s_suppkey::DOUBLE AS lat, s_nationkey::DOUBLE AS lon, s_name AS name FROM supplier")
def marker_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("double").alias("Latitude"), F.col("s_nationkey").cast("double").alias("Longitude"), F.col("s_name").alias("Name of it"))
    return row_markers(rows, "Latitude", "Longitude", "Name of it")


@query("SELECT * FROM (VALUES ('#800000', 'Individual'), ('#007396', 'Agency'), ('#59315F', 'Agency and Individual Providers')) AS t(color, label)")
def legend_rows(spark, sf_dir):
    return io.legend(spark, {"Individual": "#800000", "Agency": "#007396", "Agency and Individual Providers": "#59315F"})


@query("SELECT s_suppkey, 'data:text/json;charset=utf-8%7B%22name%22%3A%22' || replace(s_name, '#', '%23') || '%22%7D' AS uri FROM supplier")
def data_uris(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", io.data_uri(F.to_json(F.struct(F.col("s_name").alias("name")))).alias("uri"))


@query("SELECT c_custkey, '<h3>' || c_name || ' &lt;' || c_mktsegment || '&gt;</h3><strong>Birthplace: </strong>' || c_nationkey || '<br><strong>Rec Station: </strong>' || c_mktsegment || '<br><br><i>from a register</i>' AS person, '<h3>' || c_name || '</h3>Type: ' || c_mktsegment || ' ' AS kind FROM customer")
def feature_popups(spark, sf_dir):
    last = F.concat(F.lit("<"), F.col("c_mktsegment"), F.lit(">"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", symbols.person_popup(F.col("c_name"), last, F.col("c_nationkey"), F.col("c_mktsegment"), "from a register").alias("person"), symbols.type_popup(F.col("c_name"), F.col("c_mktsegment")).alias("kind")
    )


@query(f"SELECT p_partkey AS \"ID\", {_fuzzy_sql('p_name', 'gizmoo', 3)} / 6.0::double AS score, p_name || ' ' || p_brand AS result FROM part WHERE {_fuzzy_sql('p_name', 'gizmoo', 3)} <= 3 ORDER BY score, p_partkey LIMIT 10")
def search_results(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), F.col("p_name").alias("LNAME"), F.col("p_brand").alias("FNAME"), F.col("p_type").alias("CTYORIGN"))
    return migration_search(lines, "Gizmoo ", symbols.result_text(F.col("LNAME"), F.col("FNAME"), F.col("CTYORIGN")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_brand ELSE p_type END AS result FROM part")
def result_texts(spark, sf_dir):
    last = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 0, "")
    return table(spark, sf_dir, "part").select("p_partkey", symbols.result_text(last, F.col("p_brand"), F.col("p_type")).alias("result"))


@query("SELECT s_suppkey AS \"ID\", '[' || s_suppkey || '.0,' || s_nationkey || '.0]' AS origin, '[' || c_custkey || '.0,' || c_nationkey || '.0]' AS goal FROM supplier JOIN customer ON s_suppkey = c_custkey")
def layer_pairs(spark, sf_dir):
    layer = lambda name, p, key: table(spark, sf_dir, name).select(F.col(f"{p}_{key}").alias("ID"), F.col(f"{p}_{key}").cast("double").alias("lon"), F.col(f"{p}_nationkey").cast("double").alias("lat"))
    pairs = search.pair_layers(layer("supplier", "s", "suppkey"), layer("customer", "c", "custkey"))
    return pairs.select("ID", F.to_json(F.get("line", 0)).alias("origin"), F.to_json(F.get("line", 1)).alias("goal"))


@query("SELECT n_nationkey, n_regionkey::VARCHAR AS a, n_name AS b, 'x' AS c FROM nation")
def merged_options(spark, sf_dir):
    merged = coerce.merged(F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.col("n_name")), F.create_map(F.lit("a"), F.col("n_regionkey").cast("string")), F.create_map(F.lit("c"), F.lit("x")))
    return table(spark, sf_dir, "nation").select("n_nationkey", *(F.try_element_at(merged, F.lit(k)).alias(k) for k in "abc"))


@query("SELECT o_orderkey, (SELECT min(year(o_orderdate)) FROM orders)::INTEGER AS least, (SELECT max(year(o_orderdate)) FROM orders)::INTEGER AS most FROM orders")
def full_years(spark, sf_dir):
    """A range's defaults are those of the data; unparsable years drop, so here none does."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"))
    years = filters.full_range(orders, "year")
    return filters.in_years(orders, "year", years).select("o_orderkey", F.lit(years.start).alias("least"), F.lit(years.end).alias("most"))


@query("SELECT s_suppkey::DOUBLE AS lon, s_name || '!' AS popup, CASE WHEN s_nationkey % 2 = 0 THEN 'blue' ELSE 'gray' END AS color FROM supplier WHERE s_acctbal > 0 OR s_acctbal IS NULL")
def callback_layer(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    color = lambda df: symbols.lookup((df["s_nationkey"] % 2).cast("string"), {"0": "blue"}, "gray")
    return feature_layer(rows, keep=lambda df: (df["s_acctbal"] > 0) | df["s_acctbal"].isNull(), lon=F.col("s_suppkey").cast("double"), popup=F.concat("s_name", F.lit("!")), color=color)


@query("SELECT p_name AS name, CAST(1900 + p_size AS INTEGER) AS year, CASE p_type WHEN 'PROMO' THEN 'red' ELSE 'gray' END AS color, '<h3>' || p_name || '</h3>Type: ' || p_type || ' ' AS popup, p_partkey::DOUBLE AS lat, p_size::DOUBLE AS lon FROM part WHERE 1900 + p_size BETWEEN 1931 AND 1940")
def timeline(spark, sf_dir):
    properties = F.struct(F.col("p_name").alias("name"), (F.col("p_size") + 1900).cast("int").alias("year"), F.col("p_type").alias("type"))
    at = F.to_json(F.array(F.col("p_size").cast("double"), F.col("p_partkey").cast("double")))
    features = table(spark, sf_dir, "part").select(properties.alias("properties"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"))
    return timeline_map(features, filters.YearRange(1900, 1940), {"PROMO": "red"})
