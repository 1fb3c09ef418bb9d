"""Articles in pages: what is text, what stands beside it, and what a page says about itself."""

import uuid

import pytest

from skein.operators.articles import extract_articles, rows_of

P = "This paragraph has enough words to be read as part of an article, with a clause or two, and it goes on for a while."


def extracted(spark, tmp_path, pages, **options):
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string").repartition(3)
    return [r for r in extract_articles(df, f"{tmp_path}/{uuid.uuid4().hex}", **options).orderBy("id").collect()]


def page(body, head=""):
    return f'<html lang="en"><head>{head}</head><body>{body}</body></html>'


def test_navigation_comments_and_asides_stay_out(spark, tmp_path):
    links = "<ul>" + "".join(f'<li><a href="/{i}">A link to somewhere {i}</a></li>' for i in range(20)) + "</ul>"
    comments = f'<div id="comments"><p>First! {P}</p><p>{P} {P}</p></div>'
    body = f'<nav>{links}</nav><div id=wrap><div class="sidebar">{P}</div><div class="post"><h1>Rivers</h1><p>{P}</p><p>{P} <a href="x">one link</a></p><aside>{P}</aside></div>{links}{comments}</div><footer>{P}</footer>'
    got, = extracted(spark, tmp_path, [page(body)])
    assert got["text"] == f"Rivers\n\n{P}\n\n{P} one link"
    assert got["content"] == f"<h1>Rivers</h1><p>{P}</p><p>{P} one link</p>"
    assert got["is_article"] and got["length"] == len(got["text"]) and got["excerpt"] == P and got["title"] == "Rivers"


def test_siblings_are_kept_and_small_ones_not(spark, tmp_path):
    body = f"<div><div><p>{P}</p><p>{P}</p><p>{P}</p></div><div>{'<a href=x>more links</a> ' * 8}</div><div>{'<a href=x>to go away</a> ' * 60}</div><div><p>{P}</p><p>{P}</p></div><div><p>Short.</p></div></div>"
    got, = extracted(spark, tmp_path, [page(body)])
    assert got["text"].count(P) == 5 and "links" not in got["text"] and "go away" not in got["text"] and "Short" not in got["text"]


def test_nested_tables(spark, tmp_path):
    cell = f"<table><tr><td><p>{P}<p>{P}</td><td>one<td>two<tr><td>three</table>"
    body = f'<table><tr><td><a href="/">Home</a><td><table><tr><td>{cell}</table></table>'
    got, = extracted(spark, tmp_path, [page(body)])
    assert got["text"] == f"{P}\n\n{P}"


def test_what_a_page_says_about_itself(spark, tmp_path):
    facts = '<title>The River at Night - The Daily Mill</title><meta property="og:site_name" content="The Daily Mill"><meta name=description content="About a  river.">'
    pages = [
        page(f'<article><h1>Other</h1><p class="byline">By <b>Jane Writer</b></p><p>{P}</p><p>{P}</p></article>', facts),
        page(f'<article><p>{P}</p><p>{P}</p><span class="author">A. N. Other</span></article>', '<meta name="author" content="Jo Scribe"><meta property="og:title" content="Told &amp; sold">'),
        page(f"<article><h1>Only a heading</h1><p>{P}</p><p>{P}</p></article>"),
        page(f"<p>{P}</p><p>{P}</p>", "<title>Two words - Site</title>"),
    ]
    a, b, c, d = extracted(spark, tmp_path, pages)
    assert (a["title"], a["byline"], a["site_name"], a["lang"], a["excerpt"]) == ("The River at Night", "By", "The Daily Mill", "en", "About a river.")
    assert (b["title"], b["byline"], b["site_name"]) == ("Told & sold", "Jo Scribe", "")
    assert c["title"] == "Only a heading" and d["title"] == "Two words - Site"


def test_pages_without_an_article(spark, tmp_path):
    home = "".join(f'<div><a href="/{i}">{P}</a></div>' for i in range(10))
    got = extracted(spark, tmp_path, [page(home), None, "", "<p", "no markup at all, but text that is long enough to count. " * 5, page(f'<div hidden>{P}{P}</div><div style="display: none"><p>{P}{P}</p></div>')])
    assert [g["is_article"] for g in got] == [False] * 6
    assert {g["text"] for g in got} == {""} and got[1]["title"] == "Untitled"


def test_scripts_and_signs(spark, tmp_path):
    body = f"<article><script>var x = '<p>{P}</p>'</script><p>{P} &lt;b&gt; 1 &lt; 2 &amp; caf&eacute;</p><p>{P}<br>line</p></article>"
    got, = extracted(spark, tmp_path, [page(body)])
    assert got["text"] == f"{P} <b> 1 < 2 & café\n\n{P} line"
    assert "&lt;b&gt; 1 &lt; 2 &amp; café" in got["content"] and "script" not in got["content"]


def test_other_columns_stay_and_rows_repeat(spark, tmp_path):
    one = page(f"<article><p>{P}</p><p>{P}</p></article>")
    df = spark.createDataFrame([(1, one, 5), (1, one, 5), (None, one, None)], "id long, html string, seq int")
    got = extract_articles(df, f"{tmp_path}/rows").collect()
    assert sorted((r["id"] or 0, r["seq"] or 0, r["length"]) for r in got) == [(0, 0, 2 * len(P) + 2), (1, 5, 2 * len(P) + 2), (1, 5, 2 * len(P) + 2)]


@pytest.mark.parametrize("text", ["<div><p>a<p>b</div>c", "<ul><li>a<ul><li>b</ul><li>c</ul>", "</p></div><b>x</i>", "<table><tr><td>a<td>b<tr><td>c</table>"])
def test_rows_are_nested(text):
    rows = rows_of(text)
    assert [r[0] for r in rows] == list(range(len(rows)))
    stack = []
    for _, kind, element, parent, *_ in rows:
        if kind == "open":
            assert parent == (stack[-1] if stack else -1)
            stack.append(element)
        elif kind == "close":
            assert stack.pop() == element
        elif kind == "text":
            assert element == (stack[-1] if stack else -1)
    assert not stack


def test_titles_that_were_cut_in_an_escape(spark, tmp_path):
    """The beginning of an escape at a title's end goes, whole escapes and other signs stay."""
    titles = ["Rivers &amp; seas&am", "Rivers&a", "Rivers &amp; seas&amp", "Rivers of AT&T", "Rivers&amp;am", "Rivers &quo "]
    got = extracted(spark, tmp_path, [page(f"<p>{P}</p><p>{P}</p>", f"<title>{t}</title>") for t in titles])
    assert [r["title"] for r in got] == ["Rivers & seas", "Rivers", "Rivers & seas&", "Rivers of AT&T", "Rivers&am", "Rivers"]
