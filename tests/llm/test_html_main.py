"""Main text of hand-written pages, and templates that only their recurrence gives away."""

import pytest

from obsynth.llm import html_main
from obsynth.llm.html_main import extract_main, main_text, tree_of

CASES = [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b&nbsp;c<div class='comment'>x</div><div>d <span>e</span></div>", "a\n\nb c\n\nd e"),
    ("<nav>m</nav><main><h1>T</h1><ul><li>1<li>2</ul></main><p>out", "T\n\n1\n\n2"),
    ("<article><p title=\"a>b\" x=don't>text &lt;b&gt; <br>more<!-- c --></p><div class=ad>no</div><p>x<", "text <b> more\n\nx"),
    ("<head><title>no</title></head><body><script>var t='</p>';</script><article><h1> T </h1><p><b>one<br><p>two\n\n three</article><footer>f</footer>", "T\n\none\n\ntwo three"),
    ("<article><p>ok</p></article", "ok"), ("<article><aside>no</aside><form>no</form><style>no</style><p>ok<noscript>no</noscript></article>", "ok"),
    ("<article class='comment'>no</article><article>yes<section id=comments><p>no</section></article>", "yes"), ("<div hidden>no</div><p style='display: none'>no</p>yes", "yes"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("</p></div>x<unknown y>z</unknown>", "xz"), ("<div>" * 5000 + "deep", "deep"), ("<!-- open", ""),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_cases(source, want):
    assert main_text(tree_of(source), frozenset()) == want


def test_host_templates(spark):
    rows = []
    for host, n in (("big.example", 40), ("small.example", 3)):
        for i in range(n):
            box = "<div><p>Follow us on the square</p></div>"
            plain = f"<div><p>Story {i} of {host}</p></div>"
            rows.append((f"http://{host}/{i}", box + plain))
            rows.append((f"http://{host}/a{i}", f"<article><p>The line of all</p><p>Text {i} {'long ' * 30}</p>{box}</article>"))
    rows += [(None, None), ("http://big.example/0", ""), ("nothing", "<p>x</p>")]
    pages = spark.createDataFrame([(i, u, h, "t", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r for r in extract_main(pages).collect()}
    assert len(got) == len(rows)
    for i, (u, h) in enumerate(rows):
        text = got[i]["text"]
        assert got[i]["url"] == u and got[i]["n_chars"] == len(text)
        if u and "/a" in u:
            assert text.startswith("The line of all\n\nText")  # a line of an article stays though all pages have it
            assert ("Follow" in text) == ("small" in u)
        elif u and h and "Story" in h:
            assert ("Follow" in text) == ("small" in u) and "Story" in text
    assert [got[i]["text"] for i in range(len(rows) - 3, len(rows))] == ["", "", "x"]
    assert extract_main(pages.limit(0)).count() == 0


BODY = "<p>The body of the page stands here</p><p>and goes on for some more words</p>"
CARDS = "<article><h2>Card one</h2></article><article><h2>Card two</h2></article>"


@pytest.mark.parametrize("source", [f"<main>{BODY}</main>{CARDS}", f"<div>{BODY}</div>{CARDS}", f"<main>{BODY}{CARDS}</main>"])
def test_cards_do_not_displace_the_body(source):
    assert "body of the page" in main_text(tree_of(source), frozenset()) and "some more words" in main_text(tree_of(source), frozenset())
    cards = {c.digest for c in tree_of(CARDS).children}
    assert main_text(tree_of(source), cards) == "The body of the page stands here\n\nand goes on for some more words"


def test_copies_of_an_article_stay():
    tree = tree_of(f"<div>12 May</div><article>{BODY}</article>")
    assert main_text(tree, {tree.children[1].digest, *(c.digest for c in tree.children[1].children)}) == "The body of the page stands here\n\nand goes on for some more words"


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_counted_subtrees_alone_decide(spark, sent, monkeypatch):
    """Plain blocks without telling names: what recurs on a host goes there and stays on a host with few such pages."""
    monkeypatch.setattr(html_main, "SENT", sent)
    top = "<div><p>Words on top of every page of the place, said again and again</p></div>"
    page = lambda i: f"<html><body>{top}<div><p>Body number {i} with words of its own</p><p>and a second block {i}</p></div></body></html>"
    rows = [(i, f"http://big.test/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://small.test/{i}", page(100 + i)) for i in range(3)] + [(200, "http://big.test/x", page(200) + " " * 200_000)]
    got = {r["page_id"]: r["text"] for r in html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == 44
    for i in (*range(40), 200):
        assert got[i] == f"Body number {i} with words of its own\n\nand a second block {i}"
    for i in range(100, 103):
        assert got[i].startswith("Words on top") and got[i].endswith(f"and a second block {i}")
