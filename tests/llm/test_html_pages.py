"""Pages whose markup is easily misread, and a plain second version over the pages of the tables."""

import re

import pytest

from tablewright.llm import html_text, queries

P = [f"Paragraph number {i} of the article has a good many words in a row, as articles do." for i in range(8)]
TEXT = "".join(f"<p>{p}</p>" for p in P)
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9)) + "</ul>"
COMMENT = "<p>I do not agree with a word of this, and I have said so many times before, at length.</p>"
WHOLE = "\n".join(P)


def body(inner):
    return f"<html><head><title>T</title></head><body><nav>{LINKS}</nav>{inner}<footer>Foot</footer></body></html>"


PAGES = {
    # Classes that only say that there is something else.
    "has-sidebar": (f'<div class="content has-sidebar"><article>{TEXT}</article></div>', WHOLE),
    "with-sidebar": (f'<div class="wrapper with-sidebar">{TEXT}</div><div class="sidebar">Side</div>', WHOLE),
    "comments-open": (f'<div class="entry comments-open">{TEXT}</div>', WHOLE),
    "comments-open and comments": (
        f'<div class="entry comments-open">{TEXT}<div class="comments">{COMMENT}</div></div>', WHOLE
    ),
    "post-header": (f'<article><div class="post-header"><h1>Head</h1></div>{TEXT}</article>', f"Head\n{WHOLE}"),
    "no-nav": (f'<div class="no-nav page">{TEXT}</div>', WHOLE),
    # Classes that name it by their last or first word.
    "site-footer": (f'<article>{TEXT}</article><div class="site-footer"><p>{COMMENT}</p></div>', WHOLE),
    "left sidebar": (f'<div class="left-sidebar"><p>{COMMENT}</p></div><article>{TEXT}</article>', WHOLE),
    "post-comments": (f'<article>{TEXT}<div class="post-comments">{COMMENT * 3}</div></article>', WHOLE),
    "sidebar-left in main": (f'<main>{TEXT}<div id="sidebar-left">{LINKS}</div></main>', WHOLE),
    # Several elements that hold the text.
    "sibling articles": (
        f"<article><p>{P[0]}</p><p>{P[1]}</p></article><article><p>{P[2]}</p></article>", "\n".join(P[:3])
    ),
    "sibling divs": (
        f"<div><div><p>{P[0]}</p></div><div><p>{P[1]}</p><p>Short.</p></div></div><div>{LINKS}</div>",
        f"{P[0]}\n{P[1]}\nShort.",
    ),
    "a closing section": (
        f"<div id=text><section>{TEXT}</section><section><h2>End</h2><p>{P[0]}</p></section></div>",
        f"{WHOLE}\nEnd\n{P[0]}",
    ),
    "nested articles": (
        f"<article><h1>Head</h1><article><p>{P[0]}</p></article>{TEXT}</article>", f"Head\n{P[0]}\n{WHOLE}"
    ),
    "main around an article": (f"<main><div>{LINKS}</div><article>{TEXT}</article></main>", WHOLE),
    "main with text of its own": (
        f"<main><p>{P[7]}</p><article><p>{P[0]}</p><p>{P[1]}</p></article></main>",
        "\n".join([P[7], P[0], P[1]]),
    ),
    # An article in something that is not one, and something beside with articles in it.
    "a form around the page": (f'<form id="all"><article>{TEXT}</article></form>', WHOLE),
    "an article in a dialog": (f'<div class="modal"><article>{TEXT}</article></div>', WHOLE),
    "related articles": (
        f'<article>{TEXT}</article><aside class="related"><article>{COMMENT}</article></aside>', WHOLE
    ),
    "a short article": (f"<article><p>Short news.</p></article><div>{COMMENT * 4}</div>", "Short news."),
    # Nothing to read.
    "only comments": (f'<div class="comments">{COMMENT}</div>', ""),
    "only links": (f"<aside>{LINKS}</aside>", ""),
    "hidden": (f"<article>{TEXT}<div hidden>{COMMENT}</div><p aria-hidden=true>x</p></article>", WHOLE),
    "controls": (f"<article>{TEXT}<button>Go</button><select><option>a</select></article>", WHOLE),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    inner, want = PAGES[name]
    assert html_text.main_text(body(inner)) == want


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + TEXT + "</div>" * 3000
    assert html_text.main_text(body(f"<article>{deep}</article>")) == WHOLE
    long = "".join(f"<p>Sentence {i} of a very long article, which goes on.</p>" for i in range(20000))
    got = html_text.main_text(body(f"<article>{long}</article>")).split("\n")
    assert len(got) == 20000 and got[-1].startswith("Sentence 19999")
    one = "word " * 200_000
    assert html_text.main_text(body(f"<article><p>{one}</article>")) == one.strip()


ARTICLE = re.compile(r"<article>(.*?)</article>", re.DOTALL)
BLOCK = re.compile(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>|<br>")


def plain(html):
    """The article of the pages of the tables, by expressions: they have one, without further markup
    than paragraphs, headings, line breaks and inline elements."""
    import html as entities

    found = ARTICLE.search(html or "")
    if not found:
        return None
    inner = re.sub(r"<(script|style|aside|nav|form|footer|header)\b.*?</\1>", "\n", found[1], flags=re.DOTALL)
    blocks = BLOCK.sub("\0", re.sub(r"<!--.*?-->", "", inner, flags=re.DOTALL)).split("\0")
    texts = [entities.unescape(re.sub(r"<[^>]*>", "", b)) for b in blocks]
    return "\n".join(t for t in (re.sub(r"[\s\x00]+", " ", t).strip() for t in texts) if t)


def test_pages_of_the_tables(spark, directory):
    path = directory.replace("sf0.001", "sf0.01")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = queries.QUERIES["op5_html_text"](spark, path).collect()
    assert len(got) == len(pages)
    for r in got:
        want = plain(pages[r.page_id])
        if want is not None:
            assert r.text == want and r.n_chars == len(want)


def test_rows(spark):
    schema = "page_id BIGINT, html STRING, TEXT STRING, text_ STRING, facts MAP<STRING, INT>"
    rows = [(1, body(f"<article>{TEXT}</article>"), "x", "y", {"k": 1})] * 2 + [(2, None, "x", "y", None)]
    pages = spark.createDataFrame(rows, schema)
    got = html_text.extract(pages, text_column="made")
    assert got.columns == [*pages.columns, "made"]
    assert sorted(r.made for r in got.collect()) == ["", WHOLE, WHOLE]
    assert html_text.extract(pages.limit(0)).collect() == []
