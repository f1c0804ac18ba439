from __future__ import annotations

import html
import re
from random import Random

import pytest

from callcause.llm import html_text
from callcause.llm.common import read

SCHEMA = "page_id long, url string, html string"


def text_of(source):
    return " ".join(t for t, _ in html_text.Page(source).blocks)


@pytest.mark.parametrize("source, text", [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a <b>b</b>c<br>d</p><p>e", "a bc d e"),
    ("<article><p><b>open bold<br><p>next  \n\t one&nbsp;x</article>", "open bold next one x"),
    ("<nav>menu</nav><article><h1>T</h1><p>x</article><footer>f</footer>", "T x"),
    ("<article>a<aside>side</aside><form>f</form><div class='ad'>buy</div>b</article>", "a b"),
    ("<article>a<section class='comments'><article>me</article></section></article>", "a"),
    ("<script>var t='</p>';<article>no</article></script><p>yes</p>", "yes"),
    ("<style>p{}</style><!-- <p>no</p> --><p>1 &lt; 2 &#233;&#x41; &copy &am", "1 < 2 éA © &am"),
    ("<article><p>cut off &am</p><p clas", "cut off &am"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
    ("<div hidden>x</div><div style='display: none'>y</div><div role=navigation>z</div><span class=sponsored>w</span>v", "v"),
    ("<p>a <b q=\">\">c</b></p></i></div>d", "a c d"),
    ("<article></article><p>outside</p>", ""),
    ("<main><p>m</p></main><article><p>a</p></article>", "m a"),
    ("<script>never closed <p>x", ""),
    ("<p>a</p><!-- b --!><p>c</p><!--> d <!---> e", "a c d e"),
])
def test_pages(source, text):
    assert text_of(source) == text


STORY = "A story that is told at some length, with several words of its own. " * 3


@pytest.mark.parametrize("source", [
    "<div class='layout has-sidebar'><article><p>{}</article><div class='sidebar'>more</div></div>",
    "<article class='post category-social'><p>{}</article>",
    "<article class='tag-alert social'><p>{}</article>",
    "<div id='page' class='no-header'><nav>menu</nav><p>{}</div>",
    "<div class='entry-content ad-free'><p>{}</div><div class='x ad'>buy</div>",
    "<main id='social'><p>{}</main><div class=related><p>another</div>",
    "<div class='sidebar'><div><main>{}</main></div></div>",
    "<div class='widget'><h1></h1><p>{}</div><footer>f</footer>",
    "<article><div class='header'>by me</div><p>{}<div class='Comments'>talk</div></article>",
    "<article><p>{0}<div id='comments'><article>{0} {0} {0}</article></div></article>",
])
def test_names_never_take_the_article(source):
    assert text_of(source.format(STORY)) == STORY.strip()


def test_generated_pages_against_their_articles(spark):
    """The article of a generated page holds headings and paragraphs only, so plain cutting gives the same."""
    folder = "/root/testdata/sf0.001"
    for row in html_text.query(read(spark, folder, "pages")).join(read(spark, folder, "pages"), ["page_id", "url"]).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", row["html"], re.S)[1]
        body = re.sub(r"</?(?:p|h1|br)>", " ", body)
        body = re.sub(r"</?[a-z]+>|<[^>]*\Z", "", body)
        assert row["text"] == " ".join(html.unescape(body).split())
        assert row["n_chars"] == len(row["text"])


def test_what_recurs_on_a_host_goes(spark):
    def page(k, host="h.example"):
        body = (f"<div><div>Welcome to our site</div><p>story {k} has words of its own, many more than any frame has</p>"
                f"<p>All rights reserved</p></div>")
        return (k, f"http://{host}/{k}", body)

    pages = [page(k) for k in range(12)] + [page(k, "other.example") for k in range(100, 103)]
    found = {r["page_id"]: r["text"] for r in html_text.query(spark.createDataFrame(pages, SCHEMA).repartition(4)).collect()}
    story = "story {} has words of its own, many more than any frame has"
    assert found[3] == story.format(3)
    assert found[101] == "Welcome to our site " + story.format(101) + " All rights reserved"


def test_recurring_prose_of_articles_stays(spark):
    pages = [(k, "http://h/", f"<article><h1>same head</h1><p>same line</p><p>{k} differs</p>"
                              f"<div>box</div></article>") for k in range(15)]
    copies = [(k, "http://copies/", "<article><h1>one</h1><div>text</div><div>copied whole</div></article>") for k in range(50, 80)]
    found = {r["page_id"]: r["text"] for r in html_text.query(spark.createDataFrame(pages + copies, SCHEMA)).collect()}
    assert found[4] == "same head same line 4 differs"
    assert found[60] == "one text copied whole"


def texts_of(spark, sources, host="h"):
    rows = [(k, f"http://{host}/{k}", source) for k, source in enumerate(sources)]
    return {r["page_id"]: r["text"] for r in html_text.query(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_lines_of_articles_that_recur_on_very_many_pages_go(spark):
    legal = "Reprinted by permission of the publishers of this site"
    found = texts_of(spark, [f"<article><h1>head {k}</h1><p>story {k} with some words of its own that no other page has, {k}</p>"
                             f"<p>{legal}</p><ul><li>Subscribe now</li></ul><table><tr><td>{k % 3}<td>row {k}</table></article>"
                             for k in range(60)])
    assert found[7] == "head 7 story 7 with some words of its own that no other page has, 7 1 row 7"


def test_named_elements_count_too(spark):
    """What menus, footers and adverts of ten articles hold goes from a page that has it under no such name."""
    box = "<div><div>Welcome to the shop of the house</div></div>"
    pages = [f"<nav>{box}</nav><article><p>story {k}</p></article><footer>f</footer>" for k in range(12)]
    found = texts_of(spark, [*pages, f"<div>{box}<p>one page without an article, but a story</p></div>"])
    assert found[12] == "one page without an article, but a story"


def test_known_template_goes_where_it_is_most_of_a_page(spark):
    note = "<div>This long note of the host stands below each of its many stories</div>"
    pages = [f"<article><p>{f'story {k} goes on for a while. ' * 5}</p>{note}</article>" for k in range(12)]
    assert texts_of(spark, [*pages, f"<article><p>brief</p>{note}</article>"])[12] == "brief"


@pytest.mark.parametrize("size", [300, 3_000])
def test_a_line_that_some_articles_share_stays_on_hosts_of_any_size(spark, size):
    line = "The council met again on the first evening of the month"
    sources = [f"<article><h1>head {k}</h1><p>story {k} with some words of its own that no other page has, {k}</p>"
               + (f"<p>{line}</p>" if k % 8 == 0 else "") + "</article>" for k in range(size)]
    found = texts_of(spark, sources)
    assert sum(text.endswith(line) for text in found.values()) == -(-size // 8)


def test_counts_against_brute_force(spark):
    """Flat articles: a line goes by the number and the share of its host's different articles, a box by the number."""
    random = Random(5)
    sources, parts = {}, {}
    for host, size in (("a", 30), ("b", 60), ("c", 9)):
        lines = [(tag, f"{tag} {k} of host {host}") for tag in ("p", "li", "div") for k in range(6)]
        for k in range(size):
            own = ("p", f"story {k} of {host}, " + "longer than all the lines that it shares with other pages " * 12)
            parts[host, k] = [own, *[line for i, line in enumerate(lines) if random.random() < (i % 6 + 1) / 7]]
            sources[host, k] = "<article>" + "".join(f"<{tag}>{text}</{tag}>" for tag, text in parts[host, k]) + "</article>"
    rows = [(n, f"http://{host}/{k}", sources[host, k]) for n, (host, k) in enumerate(sources)]
    rows += [(len(rows) + n, f"http://a/again/{n}", sources["a", 0]) for n in range(40)]
    parts |= {("again", n): parts["a", 0] for n in range(40)}
    beside, articles = {}, {}
    for (_, url, source), blocks in zip(rows, parts.values()):
        host = url.split("/")[2]
        articles.setdefault(host, set()).add(source)
        for block in blocks:
            beside.setdefault((host, block), set()).add(source)

    def stays(host, block):
        n = len(beside[host, block])
        return n < 10 if block[0] == "div" else n < 20 or 2 * n <= len(articles[host])

    found = {r["page_id"]: r["text"] for r in html_text.query(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    gone = 0
    for (page, url, _), blocks in zip(rows, parts.values()):
        left = [text for tag, text in blocks if stays(url.split("/")[2], (tag, text))]
        gone += len(blocks) - len(left)
        assert found[page] == " ".join(" ".join(left).split())
    assert gone > 100


def test_input_columns_of_any_name(spark):
    names = ["_row", "_p", "_q", "_host", "_html", "_blocks", "_text", "_gone", "a.b"]
    pages = spark.createDataFrame([(1, "http://h/", "<p>x</p>", *names)], ["page_id", "url", "html", *names])
    row = html_text.extract_text(pages).collect()[0].asDict()
    assert row == {"page_id": 1, "url": "http://h/", "text": "x", "n_chars": 1} | {n: n for n in names}


def test_odd_tables(spark):
    rows = [(None, None, None, "old"), (1, "u", "", "old"), (1, "u", "", "old"), (2, "http://x/", "<p>" + "long " * 200_000, "old")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.extract_text(docs)
    assert sorted(found.columns) == ["n_chars", "page_id", "text", "url"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found.collect()) == [(0, 0), (1, 0), (1, 0), (2, 999_999)]
    assert html_text.query(spark.createDataFrame([], SCHEMA)).count() == 0
