"""Main text of pages whose article is known, and pages that are hard to parse."""

import html
import random
import re
import time

import pytest

from pointloom.llm.html_text import beside, main_text, whole_tags

WORDS = "river stone walks under bright morning people with letters about the harbour and its long winter".split()


def sentence(rng, least=12, most=60):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(least, most))).capitalize() + "."


def article(rng):
    """Blocks of an article with their markup: a title, paragraphs long and short, sections, lists, a table, a quote."""
    blocks, parts = [], []

    def add(text, pattern="<p>{}</p>"):
        blocks.append(text)
        parts.append(pattern.format(html.escape(text).replace("river", "<b>river</b>").replace("stone ", "  stone\n ")))

    add(sentence(rng, 3, 8), "<h1>{}</h1>")
    for _ in range(rng.randrange(4, 9)):
        add(sentence(rng))
        kind = rng.randrange(6)
        if kind == 0:
            add("A short & small one.")
        if kind == 1:
            add("Heading", "<h2>{}</h2>")
            add(sentence(rng))
        if kind == 2:
            for _ in range(3):
                add(sentence(rng, 2, 6), "<li>{}")
            parts[-3:] = ["<ul>" + "".join(parts[-3:]) + "</ul>"]
        if kind == 3:
            add("é — 日本 <tag> quoted", "<blockquote>{}</blockquote>")
        if kind == 4:
            add(sentence(rng), '<section id="related-work">{}</section>')
        if kind == 5:
            add(sentence(rng), '<div class="search results">{}</div>')
    add("The end.")
    return blocks, "".join(parts)


LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Topic {i}</a>' for i in range(6)) + "</ul>"
BEFORE = ["<nav>" + LINKS + "</nav>", "<header><h1>The Site</h1><p>Since 1901</p></header>", '<div class="cookie-notice"><p>We use cookies for this and that.</p></div>', '<div id="topNav">' + LINKS + "</div>", "<div>" + LINKS + "</div>", '<div class="ad-slot"><p>Buy this thing now.</p></div>']
AFTER = ["<footer><p>&copy; The Site</p></footer>", '<aside><p>Most read this week.</p></aside>', '<div class="comments"><p>' + "I do not agree with any of this at all. " * 6 + "</p></div>", "<form><label>Name</label><input><button>Send</button></form>", '<div class="related-posts">' + LINKS + "</div>", '<div class="share-buttons"><span>Share</span></div>', "<script>var a = '<p>no</p>';</script>", "<div hidden><p>Nothing to see here.</p></div>"]
FRAMES = ["<article>{}</article>", "<main><article>{}</article></main>", "<div>{}</div>", '<div id="wrap"><div class="content">{}</div></div>', "<table><tr><td>{}</td></tr></table>", "{}", '<div class="overlay">{}</div>']


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("frame", range(len(FRAMES)))
def test_known_articles(seed, frame):
    rng = random.Random(100 * frame + seed)
    blocks, body = article(rng)
    some = lambda of: "".join(rng.sample(of, rng.randrange(0, len(of))))
    before, after = ("", "") if FRAMES[frame].startswith('<div class="overlay') else (some(BEFORE), some(AFTER))
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{FRAMES[frame].format(body)}<!-- <p>no</p> -->{after}</body></html>"
    assert main_text(page).split("\n") == blocks


def test_names():
    assert all(map(beside, ["ad", "ads", "ad-slot-1", "adBox", "site-footer", "mainNav", "cookie_notice", "related-posts", "search-form", "comments", "sidebar-left"]))
    assert not any(map(beside, ["related-work", "search", "results", "adder", "social-history", "content", "article-header", "navy", "", "123", "tags", "post-body"]))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        (" \n ", ""),
        ("no markup & all", "no markup & all"),
        ("<p>a<p>b", "a\nb"),
        ("<p>1 < 2 &lt; 3 <3</p>", "1 < 2 < 3 <3"),
        ("<p>x</p><!-- open <p>y</p>", "x"),
        ("<p>x</p><script>if (a < b) '</p>'", "x"),
        ("<p>x</p><![foo[ y ]]><p>z</p>", "x\nz"),
        ("<p title='a > b'>x</p><?php no ?>", "x"),
        ("<p>x</div></p></b>y", "x\ny"),
        ("<p>&eacute;&#233;&#xe9;&nbsp;&bogus;</p>", "ééé &bogus;"),
        ("<p>a</p><a href='", "a\n<a href='"),
    ],
)
def test_odd_markup(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("part", ["<ul><li>x", "<a b='", "<div>x", "<!--", "<b>", "<p>x", "<table><tr><td>x", "</a ", "<![CDATA[", '<div class="ad">x', "&#"])
def test_time_is_linear(part):
    def seconds(n):
        began = time.process_time()
        main_text(part * (n // len(part)))
        return time.process_time() - began

    seconds(20_000)
    small, large = min(seconds(50_000) for _ in range(2)), min(seconds(400_000) for _ in range(2))
    assert large < 0.3 or large < 20 * small  # 8 times the page; quadratic: 64 times


def test_tags_survive_whole():
    page = "<p class=\"a\" id='b>c'>x <i>y</i></p>"
    assert whole_tags(page) == page
    assert not re.search(r"script>.*if", whole_tags("<script>if</script><p>x"))
