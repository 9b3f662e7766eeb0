"""Scalar columns against plain Python."""

import math
import re
from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pointloom.functions import coerce, symbols


def one(spark, make, *values, kinds=None):
    kinds = kinds or ["string"] * len(values)
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"), [("41.5x", 41.5), (" 41.5 ", 41.5), ("", None), ("abc", None), (None, None), ("-.5e1", -5.0), ("1e", 1.0), ("+7", 7.0), ("..1", None)]
)
def test_leading_double(spark, raw, want):
    assert one(spark, coerce.leading_double, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("3 staff", 3), ("Unknown", None), ("", None), (None, None), (" -2.9", -2), ("99999999999", None)])
def test_leading_int(spark, raw, want):
    assert one(spark, coerce.leading_int, raw) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789+-.eE x", max_size=8), min_size=1, max_size=20))
def test_leading_double_by_rule(spark, raws):
    df = spark.createDataFrame([(x,) for x in raws], "c string")
    for row in df.select("c", coerce.leading_double(F.col("c")).alias("x")).collect():
        m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", row["c"])
        want = float(m[1]) if m else None
        assert row["x"] == want or (want is not None and math.isinf(want))


@pytest.mark.parametrize(("raw", "want"), [("y", True), ("Y", True), ("Y ", False), ("N", False), ("", False), (None, False)])
def test_flag(spark, raw, want):
    assert one(spark, coerce.flag_on, raw) is want


def test_small_columns(spark):
    assert one(spark, coerce.yes_no, " y ") == "Yes"
    assert one(spark, coerce.yes_no, "U") == "U"
    assert one(spark, coerce.link, "a.org") == "http://a.org"
    assert one(spark, coerce.link, "https://a.org") == "https://a.org"
    assert one(spark, coerce.link, None) == ""
    assert one(spark, lambda c: coerce.either(c, "Provider"), "") == "Provider"
    raw = "a b~(x)!'é*-_."
    assert one(spark, coerce.encode_component, raw) == quote(raw, safe="~()!'*-_.")
    assert one(spark, coerce.escape_html, "<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, lambda a, b: coerce.merged(F.create_map(F.lit("k"), a), F.create_map(F.lit("k"), b)), "1", "2") == {"k": "2"}


@pytest.mark.parametrize(("raw", "want"), [("a", "agency"), (" Agencies", "agency"), ("Individual", "individual"), ("BOTH", "mixed"), ("other", "unknown"), (None, "unknown")])
def test_provider_type(spark, raw, want):
    assert one(spark, symbols.provider_type, raw) == want


@pytest.mark.parametrize(("types", "want"), [(["agency", "individual"], "violet"), (["agency"], "blue"), (["individual", "mixed"], "red"), (["mixed"], "gray"), ([], "gray")])
def test_type_color(spark, types, want):
    assert one(spark, symbols.type_color, types, kinds=["array<string>"]) == want


def test_popup_is_escaped(spark):
    df = spark.createDataFrame([("<b>", "Y", "", "x")], "NAME string, MEDICAID string, CITY string, `Unnamed: 3` string")
    html = df.select(symbols.popup(F.col("NAME"), symbols.details(["MEDICAID", "CITY", "Unnamed: 3"]), F.lit("a.org")).alias("h")).first()["h"]
    assert html == '<a href="http://a.org"><b>&lt;b&gt;</b></a><table><tr><th>MEDICAID</th><td>Yes</td></tr></table>'
