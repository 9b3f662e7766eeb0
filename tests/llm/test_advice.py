"""Cases that earlier versions of the operators left out."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm import queries as q
from pointloom.llm.html_text import main_text
from pointloom.llm.lines import LINE_REPORT_SQL, line_report, remove_boilerplate
from pointloom.llm.toxicity import Model, Scorer, trigram_counts

P = pytest.importorskip("public_tokenizers")


def test_boilerplate_goes_from_documents_that_are_mostly_boilerplate(spark):
    notice, whole = "All rights reserved by the makers of this long notice", "same page\neverywhere"
    rows = [(i, f"own {i}\n{notice}", f"s{i}") for i in range(10)] + [(20, f"a\n{notice}\n{notice}", "s0"), (21, notice, "s1")]
    rows += [(30 + i, whole, f"s{i}") for i in range(12)] + [(None, whole, "s1"), (50, "own\nsame page", "s2")]
    rows += [(60 + i, "two sites", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in remove_boilerplate(docs).collect()]
    want = [(i, f"own {i}", 1) for i in range(10)] + [(20, "a", 2), (21, "", 1), (30, whole, 0), (None, "", 2), (50, "own", 1)]
    want += [(30 + i, "", 2) for i in range(1, 12)] + [(60 + i, "two sites", 0) for i in range(12)]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(want, key=key)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows] + [99, None], "text": [r[1] for r in rows] + [None, notice], "source": [r[2] for r in rows] + ["s1", None]}))
    more = docs.unionByName(spark.createDataFrame([(99, None, "s1"), (None, notice, None)], docs.schema))
    report = line_report(more)
    cur = con.execute(LINE_REPORT_SQL.format(documents="documents", sites=10))
    assert [d[0] for d in cur.description] == report.columns
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in report.collect())


def test_boilerplate_with_clashing_columns(spark):
    rows = [(i, "notice\nown", f"s{i}", i, "x", "y") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, gone string, `key` string")
    got = remove_boilerplate(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert all((r["text"], r["row"], r["gone"], r["n_removed"]) == ("", r["doc_id"], "x", 2) or r["doc_id"] == 0 and r["text"] == "notice\nown" for r in got.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("st" + "u" * 40 + "pid", "stupid"),
        ("and/that/is/a/token/without/any/space/i.d.i.o.t/in/it", "idiot"),
        ("https://an.example/of/a/long/unbroken/address/1d10t", "idiot"),
        ("you i\td\ti\to\tt you", "idiot"),
        ("you  i  d  i  o  t  you", "idiot"),
        ("b!7(#", "bitch"),
        ("a$$", "ass"),
        ("jacka$$", "jackass"),
        ("jacka$$!!", "jackass"),
        ("(razy", "crazy"),
        ("word$$$", "word"),
    ],
)
def test_disguised_words_are_decoded(text, want):
    words = b"you are an idiot and stupid that is a bitch with an ass a jackass or a crazy word " * 50
    assert want in Scorer(Model(trigrams=trigram_counts([words]))).all_words(text)


def test_long_tokens_are_decoded_in_windows():
    restorer = Scorer(Model(trigrams=trigram_counts([b"idiot and stupid " * 50]))).restorer
    token = "abcdefghijklmnop" * 5 + "1d10t"
    assert any("idiot" in x for x in restorer.restore(token))


BODY = [f"Paragraph {i} of the body tells at some length what happened on day {i} of the journey, and why it did." for i in range(6)]
TEASERS = "".join(f'<article><h3><a href="/{i}">Other story {i}</a></h3><p>Read on.</p></article>' for i in range(4))
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(5)) + "</ul>"


def paragraphs(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div>{LINKS}</div><div><h1>Title</h1>{paragraphs(BODY)}</div><div>{LINKS}</div>", ["Title", *BODY]),
        (f"<div><h1>Title</h1>{paragraphs(BODY)}</div><div>{TEASERS}</div>", ["Title", *BODY]),
        (f"<main><h1>Title</h1><p>By A.</p><article>{paragraphs(BODY)}{LINKS}</article>{TEASERS}</main>", ["Title", "By A.", *BODY]),
        (f"<article><h1>Title</h1><p>By A.</p>{paragraphs(BODY)}<p>The end.</p></article><div>{LINKS}<p>Fine print.</p></div>", ["Title", "By A.", *BODY, "The end."]),
    ],
    ids=["no article", "articles are teasers", "teasers within main", "article"],
)
def test_ratio_decides_with_and_without_article(html, want):
    assert main_text(f"<html><body>{html}</body></html>").split("\n") == want


def test_packing_of_a_million_spaces(spark):
    from tokenizers import Tokenizer

    docs = {1: "a" + " " * 1_200_000 + "b c", 2: "x <|endoftext|>y" + " " * 1_100_000 + "<|endoftext|>", 3: "short"}
    rows = q.pack_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    encode = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in docs.items():
        ids, at = np.array(encode.encode(text, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
