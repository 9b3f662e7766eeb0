"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest

from pointloom.llm import queries as q
from pointloom.llm.bpe import encode_decode
from pointloom.llm.html_text import extract_text
from pointloom.llm.jaccard import jaccard_components
from pointloom.llm.lines import line_report
from pointloom.llm.media import audio_report
from pointloom.llm.neighbors import near_duplicates
from pointloom.llm.secrets import redact, secret_report
from pointloom.llm.substrings import remove_repeats
from pointloom.llm.toxicity import fit, score_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id_ long, text_ string, n long, rep long, row string, at int, n_lines long, spans string"
EXTRA = ("k", 1, "t", 1, 1, "r", 1, 1, "s")
LONG = "word " * 30_000 + "x" * 50_000
ROWS = [
    (1, "", "en", "s", 0, *EXTRA),
    (2, None, None, None, None, *([None] * 9)),
    (3, LONG, "en", "s", 1, *EXTRA),
    (None, "a b c d e f g", "en", "s", 1, *EXTRA),
    (None, None, None, None, None, *([None] * 9)),
    (4, "a b c d e f g", "en", "s", 1, *EXTRA),
    (4, "a b c d e f g", "en", "s", 1, *EXTRA),
    (5, LONG, "en", "s", 1, *EXTRA),
    (6, "\t\n \x0b", "en", "s", 1, *EXTRA),
    (7, "é 日本 😀 a", "en", "s", 1, *EXTRA),
]


def run_toxic(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    return score_documents(docs, fit(docs, labels))


RUNS = {
    "bpe": lambda d: encode_decode(d, *tokenizer()),
    "media": audio_report,
    "packing": q.pack_documents,
    "substrings": remove_repeats,
    "jaccard": jaccard_components,
    "lines": line_report,
    "secrets": secret_report,
    "redact": redact,
    "toxicity": run_toxic,
}


def tokenizer():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    got = RUNS[name](spark.createDataFrame(ROWS, SCHEMA)).collect()
    if name != "packing":
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "packing":
        assert sum(r["length"] for r in by[4]) == 2 * by[4][0]["doc_tokens"] and [r["length"] for r in by[2]] == [1]
    if name == "substrings":
        assert by[3][0]["n_removed"] == 0 and by[5][0]["n_removed"] == by[5][0]["n_words"] == 30_001 and by[2][0]["n_words"] == 0
    if name == "jaccard":
        assert by[5][0]["component_id"] == 3 and by[1][0]["component_id"] == 1 and by[6][0]["n_shingles"] == 0
        assert sorted(str(r["component_id"]) for r in by[None]) == ["4", "None"]
    if name == "media":
        assert by[1][0]["payload_bytes"] == 576 and by[1][0]["feature"] == by[2][0]["feature"]
    if name == "bpe":
        assert by[1][0]["n_tokens"] == 0 and by[3][0]["ids_sha256"] == by[5][0]["ids_sha256"]


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", "<article><p>A &amp; b<p> c <script>x</script></article><footer>f</footer>", "t", 1), (2, None, None, None, None), (None, "u", "", "t", 1), (2, "u", "<p" * 1000, "t", 1)]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and [r["text"] for r in got if r["page_id"] == 1] == ["A & b\nc"]
    assert extract_text(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, node long, v_ string, id long"
    near = [1.0, 0.01, 0.0]
    rows = [
        (5, [1.0, 0.0, 0.0], 1, 1, "a", 1), (3, near, 1, 1, "a", 1), (4, near, 1, 1, "a", 1), (9, [0.0, 1.0, 0.0], 1, 1, "a", 1), (1, None, None, None, None, None),
        (2, [0.0, 0.0, 0.0], 1, 1, "a", 1), (6, [float("nan"), 1.0, 0.0], 1, 1, "a", 1), (7, [1.0, None, 0.0], 1, 1, "a", 1), (8, [float("inf"), 0.0, 0.0], 1, 1, "a", 1), (None, near, 1, 1, "a", 1), (10, [1.0], 1, 1, "a", 1),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got[3] == (3, 3, True) and got[4] == (3, 3, False) and got[5] == (3, 3, False) and got[None] == (3, 3, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 6, 7, 8, 9, 10))
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_ties(spark):
    """Similarity, sites and ids right at the limit."""
    words = [f"w{i}" for i in range(13)]  # 9 shingles; a changed last word leaves 8 of 10, two leave 7 of 11
    docs = [(5, " ".join(words)), (3, " ".join(words[:12] + ["x"])), (1, " ".join(words[:11] + ["y", "z"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 1: 1}
    rows = [(i, f"ten sites\nown {i}" if i < 10 else f"nine sites\nown {i}", f"s{i}") for i in range(19)]
    got = {r["doc_id"]: r["n_removed"] for r in line_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: int(i < 10) for i in range(19)}
    passage = " ".join(words)  # one window of 13 words
    same = [(2, passage), (2, passage), (1, "a " + passage), (1, passage + " b"), (7, " ".join(words[:12]))]
    got = sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(same, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 13), (2, 13), (7, 0)]
