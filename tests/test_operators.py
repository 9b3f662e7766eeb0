"""Filters, search, grouping, state, sources and maps on small synthetic rows."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators import filters, search, spatial, state
from pointloom.plans import pipelines
from pointloom.sources import io
from pointloom.streaming.state_stream import run_latest

PROVIDERS = "ord long, ID string, NAME string, LATITUDE string, LONGITUDE string, AGENCY_INDIVIDUAL string, NUM_PROVIDERS string, VIRTUAL string, CDPH string, NEIGHBORHOODS string"
ROWS = [
    (0, "101", "A", "41.5", "-87.5", "Agency", "4", "Y", "N", "Hyde Park, Kenwood"),
    (1, "201", "B", " 41.5 ", "-87.5x", "individual", "Unknown", "y", None, "Kenwood"),
    (2, "401", "", "41.6", "-87.6", "", "", "Y ", "Y", ""),
    (3, None, " ", "41.7", "-87.6", "A", "1", "Y", "N", "Pilsen"),
    (4, None, "C", "abc", "-87.6", "A", "1", "Y", "N", None),
    (5, "202", "D", "41.8", "-87.8", "Both", "0", "N", "N", "Pilsen"),
]


@pytest.fixture(scope="module")
def providers(spark):
    return spark.createDataFrame(ROWS, PROVIDERS)


def ids(df, c="ord"):
    return sorted(r[c] for r in df.select(c).collect())


def test_filters(providers):
    base = filters.not_blank(providers, "ID", "NAME")
    assert ids(base) == [0, 1, 2, 4, 5]
    assert ids(filters.with_flags(base, "VIRTUAL")) == [0, 1, 4]
    assert ids(filters.with_flags(base)) == ids(base)
    assert ids(filters.with_flags(base, "MISSING")) == []
    on, off = filters.split_by_flag(base, "CDPH", True), filters.split_by_flag(base, "CDPH", False)
    assert ids(on) == [2] and ids(off) == [0, 1, 4, 5]
    assert ids(filters.split_by_flag(base, "MISSING", False)) == ids(base)
    assert ids(filters.by_role(base, "ID", True, False)) == [1, 5]
    assert ids(filters.by_role(base, "ID", False, True)) == [0, 2, 4]
    assert ids(filters.by_role(base, "ID", True, True)) == ids(filters.by_role(base, "ID", False, False)) == ids(base)
    assert ids(filters.with_place(base, "LATITUDE", "LONGITUDE")) == [0, 1, 2, 5]
    with pytest.raises(ValueError, match="empty"):
        filters.YearRange(2000, 1999)
    with pytest.raises(ValueError, match="NOPE"):
        filters.need(base, "NOPE")


def sellers(field, q):
    row = list(range(len(q) + 1))
    best = row[-1]
    for ch in field:
        new = [0]
        for j, c in enumerate(q, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != ch)))
        row = new
        best = min(best, row[-1])
    return best


def test_fuzzy_is_sellers(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(0, 12))) for _ in range(150)] + [None, "", "xabcdx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for q in ("abcd", "bcabd", "aa bé"):
        most = search.allowed_errors(q, 4)
        got = {r["id"]: r["score"] for r in search.fuzzy_match(df, "t", q).collect()}
        want = {i: sellers(t, q) / len(q) for i, t in enumerate(texts) if t and sellers(t, q) <= most}
        assert got == pytest.approx(want)
    assert search.fuzzy_match(df, "t", "  ").count() == len(texts)
    assert len(search.fuzzy_top(df, "t", "abcd", "id", 5).collect()) == 5


def test_semi_join_keeps_null_ids(providers):
    hit = providers.filter("ord = 3")
    assert ids(search.having_ids_of(providers, hit, "ID")) == [3, 4]


def scan(points, reach):
    centres, out = [], []
    for lat, lon in points:
        for k, (y, x, n) in enumerate(centres):
            h = math.sin(math.radians(lat - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - x) / 2) ** 2
            if 2 * spatial.EARTH_M * math.asin(math.sqrt(h)) <= reach:
                n += 1
                centres[k] = ((y * (n - 1) + lat) / n, (x * (n - 1) + lon) / n, n)
                out.append(k)
                break
        else:
            centres.append((lat, lon, 1))
            out.append(len(centres) - 1)
    return out


def test_greedy_clusters_equal_a_scan(spark):
    rng = random.Random(5)
    points = [(41.8 + rng.random() * 0.02, -87.7 + rng.random() * 0.02) for _ in range(400)]
    assert spatial.assign_greedily(points, 100.0) == scan(points, 100.0)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i long, lat double, lon double").repartition(3)
    got = [r["cluster"] for r in spatial.cluster_greedily(df, "lat", "lon", "i").orderBy("i").collect()]
    assert got == scan(points, 100.0)


def test_provider_map(providers):
    rows = {round(r["lat"], 3): r for r in pipelines.provider_map(providers).collect()}
    assert rows[41.5]["count"] == 5 and rows[41.5]["color"] == "violet" and rows[41.5]["types"] == ["agency", "individual"]
    assert rows[41.8]["count"] == 1 and rows[41.8]["color"] == "gray" and rows[41.8]["radius"] == 6
    found = pipelines.provider_map(providers, pipelines.ProviderQuery(search="kenwod")).collect()
    assert [round(r["lat"], 3) for r in found] == [41.5]
    assert [r["count"] for r in pipelines.cluster_map(providers).orderBy("cluster").collect()] == [2, 1]


def test_places_and_rings(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0), (3, None, 1.0)], "id long, lat double, lon double")
    gaz = spark.createDataFrame([("a", "A street", 1.001, 1.0), ("b", "B street", 1.1, 1.0)], "place string, formatted_address string, lat double, lon double")
    assert [r["address"] for r in spatial.nearest_place(points, gaz, "id").orderBy("id").collect()] == ["A street", "No results found", "Geocoder failed due to: INVALID_REQUEST"]
    rng = random.Random(6)
    spots = [(rng.uniform(*lats), rng.uniform(*lons)) for lats, lons in [((69, 71), (10, 14)), ((-20, -19), (179, 180)), ((-20, -19), (-180, -179)), ((88, 90), (-180, 180)), ((-90, -88), (-180, 180))] for _ in range(25)] + [(90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (70.5, 12.0), (70.5, 13.19)]
    entries = [(f"p{i}", f"p{i}", y + rng.uniform(-0.3, 0.3) * (abs(y) < 89), x) for i, (y, x) in enumerate(spots)][::2]

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371000 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for reach in (30_000.0, 50_000.0, 500_000.0):
        got = spatial.nearest_place(spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, lat double, lon double"), spark.createDataFrame(entries, gaz.schema), "id", reach)
        for r in got.collect():
            near = min((metres(r["lat"], r["lon"], y, x), n) for _, n, y, x in entries)
            assert r["address"] == (near[1] if near[0] <= reach else "No results found")
    with pytest.raises(ValueError):
        spatial.nearest_place(points, gaz, "id", 2e7)
    rings = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]],), ([[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0]],), ([[0.0, 0.0]],)], "r array<array<double>>")
    got = rings.select(spatial.ring_area_m2(F.col("r")).alias("a"), spatial.crosses_itself(F.col("r")).alias("x")).collect()
    assert got[0]["a"] == pytest.approx(1.2363e10, rel=1e-3) and [r["x"] for r in got] == [False, True, False]


def test_state(spark, tmp_path):
    events = spark.createDataFrame([(1, "0", "a"), (3, "0", "b"), (2, "1", "c")], "seq long, marker string, value string").withColumn("q", F.lit("Q"))
    assert json.loads(state.state_json(events, "q", "marker", F.col("value"), "seq").first()["state"]) == {"0": "b", "1": "c"}
    saved = spark.createDataFrame([('{"0":{"lat":1.0,"lng":2.0}}',), ("",), (None,), ("plain",)], "s string")
    assert [len(r["p"]) for r in saved.select(state.positions(F.col("s")).alias("p")).collect()] == [1, 0, 0, 0]
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    run_latest(stream, "marker", F.col("value"), ["seq"], "latest_markers", str(tmp_path / "check")).awaitTermination(60)
    assert {r["marker"]: r["value"] for r in spark.table("latest_markers").collect()} == {"0": "b", "1": "c"}


def test_columns_that_operators_need(spark):
    df = spark.createDataFrame([("1960", 1)], "year string, id long")
    assert filters.full_range(df, "year") == filters.YearRange(1960, 1960, 1960, 1960)
    assert filters.YearRange(1934, 1990, 1930, 2000, 10).start == 1930 and filters.YearRange(1, 3000).end == 2023
    for wrong in (lambda: filters.in_years(df, "jahr", filters.YearRange(1, 3000)), lambda: filters.with_place(df, "lat", "lon"), lambda: filters.not_blank(df, "ID", "NAME"), lambda: filters.full_range(df, "y"), lambda: filters.YearRange(1990, 1980), lambda: filters.YearRange(1, 2, step=0), lambda: pipelines.row_markers(df, "lat", "lon", "name")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        filters.full_range(df.filter("id > 1"), "year")


def test_captions(spark):
    from pointloom.functions import symbols

    df = spark.createDataFrame([("", None, "A", 1), (None, "t", "A", 2), ("l", "t", "A", 3), (None, "", None, 4)], "label string, title string, own string, i int")
    assert [r[0] for r in df.select(symbols.caption(F.col("label"), F.col("title"), F.col("i"), F.col("own"))).collect()] == ["Marker A", "t", "l", "Marker 4"]


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text('ID,NAME,,\r\n1,"two\nlines",,\r\n', newline="")
    assert io.read_csv(spark, str(tmp_path / "p.csv")).first()["NAME"] == "two\nlines"
    feature = {"type": "Feature", "properties": {"name": "é", "year": 1950, "type": "t"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}
    whole = {"type": "FeatureCollection", "features": [feature, {**feature, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(whole))
    (tmp_path / "b.js").write_text("var b = " + json.dumps(whole) + ";\n")
    (tmp_path / "c.js").write_text("var c = " + json.dumps(whole["features"]) + ";")
    props = "struct<name:string,year:int,type:string>"
    a, b = (io.read_geojson(spark, str(tmp_path / f), props) for f in ("a.geojson", "b.js"))
    c = io.read_feature_array(spark, str(tmp_path / "c.js"), props)
    for df in (a, b, c):
        assert df.count() == 2 and filters.with_geometry(df).select(io.coordinates(F.col("geometry")).alias("c")).first()["c"] == [[1.5, 2.5]]
    got = pipelines.timeline_map(a, filters.YearRange(1950, 1950), {"t": "red"}).collect()
    assert [(r["lat"], r["lon"], r["color"], r["popup"]) for r in got] == [(2.5, 1.5, "red", "<h3>é</h3>Type: t ")]
