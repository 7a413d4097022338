import html
import itertools
import re
import time

import pytest

from lectern.llm import entry, html_blocks

SF = "/root/testdata/sf0.01"
LENGTHS = (1, 3, 6, 20, 46, 282, 1808)


def article_of(source):
    """The lines of a fixture page's only <article>, by plain replacing."""
    inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
    lines = re.sub(r"<[^>]+>", "\n", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inside))).split("\n")
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


def test_pages_against_brute_force(spark):
    pages = {r["page_id"]: article_of(r["html"]) for r in entry.table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in entry.op4_html_text(spark, SF).collect()}
    assert got == pages


def row(words, links=0.0, before=0, linked_before=0.0, after=0, linked_after=0.0, ends=1, heading=0, place=1, aside=0):
    return words, links, before, linked_before, after, linked_after, ends, heading, place, aside


def test_no_block_of_an_article_goes_for_its_neighbours():
    tree = html_blocks.trained_tree()
    for words, before, after, heading, ends in itertools.product(LENGTHS, (0, *LENGTHS), (0, *LENGTHS), (0, 1), (0, 1)):
        for links, linked_before, linked_after in itertools.product((0, 0.3), (0, 1.0), (0, 1.0)):
            assert html_blocks.classify(tree, row(words, links, before, linked_before, after, linked_after, ends, heading))
            assert not html_blocks.classify(tree, row(words, links, before, linked_before, after, linked_after, ends, heading, aside=1))


def test_the_tree_learns_its_table():
    x, y = html_blocks.labelled_table()
    assert len(x) > 500 and all(html_blocks.classify(html_blocks.trained_tree(), r) == bool(k) for r, k in zip(x, y, strict=True))


#: pages, marked by hand: what is to stay is in capital letters
MARKED = [
    "<article><h1>SHORT TITLE</h1><p>" + "ONE " * 40 + "<p>" + "TWO " * 40 + "<h2>SUB HEAD</h2><p>" + "X " * 30 + "<p>" + "Y " * 20 + "</article>",
    "<div class='social-science'><article><p>" + "ONE " * 30 + "</article></div>",
    "<div class='widget-area-free main'><article><h1>A</h1><p>" + "ONE " * 30 + "</article></div>",
    "<div class='content-with-sidebar'><p>" + "ONE " * 30 + ".</p><p>" + "TWO " * 20 + ".</p></div>",
    "<article><p>" + "ONE " * 30 + "</article><section id=thread><p>i liked it<p>" + "me too " * 30 + "</section>",
    "<p>" + "ONE " * 30 + ".</p><div><h3>12 Comments</h3><p>i liked it<p>" + "me too " * 30 + ".</div>",
    "<article><p>" + "ONE " * 30 + "<div class=comments><article><p>" + "me too " * 30 + "</article></div></article>",
    "<ul class=menu><li><a href=/>home</a><div>" + "x " * 40 + "</td></div><li>more " + "x " * 40 + "</ul><article><p>" + "ONE " * 30 + "</article>",
    "<table><tr><td class=sidebar>" + "x " * 40 + "<ul><li>y</li></ul></li><li>" + "z " * 40 + "</li><td><p>" + "ONE " * 40 + ".<p>" + "TWO " * 20 + ".</table>",
    "<main><p>" + "ONE " * 20 + "<div class=ad>buy this " + "now " * 40 + "</div><p>TWO.<form>your name<input></form><p>THREE.<div class=cookie-notice>we use cookies</div></main>",
    "<article><p>" + "ONE " * 30 + "<svg><title>icon</title><text>chart</text></svg><noscript>turn it on</noscript><p hidden>not seen<p>TWO &amp; THREE&nbsp;&lt;B&gt;</article>",
    "<header><h1>the site</h1></header><article><header><h1>TITLE</h1></header><p>ONE.</article><footer>all rights</footer>",
    "<article><p>ONE <a href=/x>TWO</a> THREE<br>FOUR<p><a href=/y>FIVE</a><p>" + "SIX " * 60 + "</article>",
    "<div role=navigation>" + "go " * 40 + "</div><div role=main><p>ONE.</div><div role=contentinfo>" + "x " * 40 + "</div>",
    "<article><p>ONE<p>TWO<h2>Related articles</h2><p>" + "see also " * 9 + "</article>",
    "<article><p>ONE 中文字。<p>日本語。</article><script>var a = '</p><p>no</p>'</script><p>after",
    "<article><p>ONE<p>TWO <b>THREE",
]


@pytest.mark.parametrize("page", MARKED, ids=range(len(MARKED)))
def test_marked_pages(page):
    text = html_blocks.main_text(page)
    kept = [w for w in re.findall(r"[A-Z]{2,}|\b[A-Z]\b|[\u3000-\u9fff]+", re.sub(r"<[^>]*>", " ", html.unescape(page.replace("&lt;B&gt;", "B"))))]
    assert re.findall(r"[A-Z]{2,}|\b[A-Z]\b|[\u3000-\u9fff]+", text) == kept
    assert not re.search(r"\b[a-z]+\b", text)


def test_time_is_linear_in_a_page():
    for made in ("<div>{}</b2>", "<div>{}</li>", "<ul><li>{}</td>", '<a title="x>{}', "<script>{}", "<table><td>{}</p>", "<p>x{}", "<!--{}"):
        took = []
        for n in (4000, 16_000):
            begun, ended = made.split("{}")
            page = begun * n + ended * n
            began = time.process_time()
            html_blocks.Page(page)
            took.append(time.process_time() - began)
        assert took[1] < 10 * max(took[0], 0.02)


def test_defined_results(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "<p", "z"), (3, "<p", "z"), (4, "<article><p>" + "word " * 200_000, "q")]
    pages = spark.createDataFrame(rows, "page_id int, html_source string, MAIN_TEXT string")
    got = sorted((r["page_id"], len(r["main_text"])) for r in html_blocks.extract(pages, "html_source").collect())
    assert got == [(1, 0), (2, 0), (3, 0), (3, 0), (4, 999_999)]
    assert html_blocks.extract(pages.limit(0), "html_source").columns == ["page_id", "html_source", "main_text"]
    assert html_blocks.extract(pages.limit(0), "html_source").count() == 0


@pytest.mark.parametrize("n", [5, 282, 1808])
def test_paragraph_between_a_heading_and_a_short_one(n):
    body = " ".join(["word"] * n)
    page = f'<nav><a href="/">Home</a></nav><article><h2>Of the mill</h2><p>{body}</p><p>And so on.</p></article><footer>All rights</footer>'
    assert html_blocks.main_text(page) == f"Of the mill\n{body}\nAnd so on."


def test_lists_of_links_and_what_lies_beside_still_go():
    links = "".join(f'<li><a href="/{i}">Read more of {i}</a></li>' for i in range(5))
    page = f"<article><p>{'text ' * 30}</p><ul>{links}</ul><aside>{'other ' * 90}</aside></article>"
    assert html_blocks.main_text(page) == ("text " * 30).strip()
