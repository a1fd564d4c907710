"""Page extraction: hand-made pages, and the given pages against a plain reading of their one template."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest

from topicloom.llm.html_extract import Page, common_path, extract, extract_pages, host_paths

CASES = [
    (None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p>a<p>b", "a\nb"), ("<script>x</script><style>y</style>", ""),
    ("<body><p>one<br>two &amp; <b>th</b>ree&nbsp;\n four</p></body>", "one two & three four"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>", "yes"),
    ('<p title="a>b">q</p><p data-x=\'<p>\'>r</p>', "q\nr"),
    ("<SCRIPT>var t='</p>'; if (a<b) {}</SCRIPT ><P>Up</P>", "Up"),
    ("<ul><li>one<li>two<ul><li>in</ul></ul>", "one\ntwo\nin"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<article><h1>T</h1><p><b>x<br><p>y</p></article><footer>f</footer>", "T\nx\ny"),
    ("<p>2 < 3 and 5 > 4</p>", "2 < 3 and 5 > 4"), ("<p>a</div></span>b</p>", "ab"), ("<p>x</p><nav>m", "x"),
    ("<div hidden>no</div><div style='display: none'>no</div><div aria-hidden=true>no</div><p>yes</p>", "yes"),
    ("<pre>a\n  b</pre>tail", "a b\ntail"), ("<title>t</title><p>x &#233; &eacute; &#x1F600; &unknown;</p>", "x é é 😀 &unknown;"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_cases(source, want):
    assert extract(source, None) == want


SLUGS = [
    ('<p>see <a href="/hidden-gems">gems</a></p>', "see gems"), ('<p title="hidden costs">a</p>', "a"), ("<p title='x id=search' data-hidden>b</p>", "b"),
    ('<p data-id="search" data-role="menu">c</p>', "c"), ('<section id="discussion"><h2 id="related-work">R</h2><p>d</p></section>', "R\nd"),
    ('<h2 id="form-validation">F</h2><h3 id="search">S</h3>', "F\nS"), ("<p/hidden>no</p><p HIDDEN=''>no</p><div id = 'comments'>no</div><p class=a id=b>e", "e"),
    ('<p x="a"id=y hidden>no</p><p = hidden>no</p><p role=search>no</p><p href=/a/hidden>f</p>', "f"),
]


@pytest.mark.parametrize(("source", "want"), SLUGS)
def test_attributes_are_read_whole(source, want):
    assert extract(source, None) == want


RICH = """<html><body class="has-sidebar"><header><a href=/>Site</a></header><nav class=main-menu><ul><li>Home</ul></nav>
<div class="layout row-12"><div class="sidebar"><p>Side text that is long enough to look like an article, with commas, and more.</p></div>
<div class="post-content"><h1>Title</h1><section><p>First part of the article, long enough.</p></section>
<div class="ad-slot">Buy now</div><form><p>Subscribe</p><input></form><section><p>Second part of it, <a href=x>linked words</a>.</p></section></div>
<div id="comments"><article><p>A reader says something at great length, again and again and again.</p></article></div>
<div class="cookieNotice">We use cookies</div></div><aside>more</aside><footer><p>Imprint</p></footer></body></html>"""


def test_a_rich_page():
    areas = [dict(zip(("area", "digest", "size", "links"), (p, *a))) for p, a in Page(RICH).areas().items()]
    assert common_path(areas, set())[0] == "/html/body.has-sidebar/div.layout.row-#/div.post-content"
    assert extract(RICH, None) == "Title\nFirst part of the article, long enough.\nSecond part of it, linked words."


def test_hosts_agree_on_a_path(spark):
    page = "<body><div class=wrap-{0}><div class=story><p>{1}</p></div><div class=links><p>{2}</p></div></div></body>"
    rows = [(i, f"https://A.example:80/{i}", page.format(i, f"words of story {i} " * 9, "see also"), "x") for i in range(5)]
    rows += [(9, "http://u@a.example?q", page.format(7, "short", "a list of other stories, longer than the story"), "x")]
    rows += [(10, None, "<p>no host</p>", "y"), (None, "http://b.example/", None, "z"), (10, None, "<p>no host</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string").drop("path")
    won = {r["host"]: r["path"] for r in host_paths(pages).collect()}
    assert won["a.example"] == "/body/div.wrap-#/div.story"
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert got[9]["text"] == "short" and got[10]["text"] == "no host" and got[None]["text"] == "" and got[None]["n_chars"] == 0
    assert got[0]["text"] == ("words of story 0 " * 9).strip() and got[0]["n_chars"] == len(got[0]["text"])
    assert extract_pages(pages).count() == len(rows) and extract_pages(pages.limit(0)).count() == 0


LONG = "Words of an article, with commas, and a full stop. " * 8
WHOLE = [
    (f"<div class=post><h1>TITLE</h1><p>LEAD</p><div class=body><p>{LONG}</p></div><p>END</p></div>", ["TITLE", "LEAD", LONG, "END"]),
    (f"<main><h1>TITLE</h1><article><p>{LONG}</p></article><section><h2>SECT</h2><p>more</p></section></main>", ["TITLE", LONG, "SECT", "more"]),
    (f"<article class=a><p>{LONG}</p></article><article class=b><p>{LONG[:200]}</p></article>", [LONG, LONG[:200]]),
    ('<h1 class="entry-header">H</h1><h2 class="section-header">S</h2><h3 class="share">T</h3><p>t</p>', ["H", "S", "T", "t"]),
    ('<div class="share-price">P</div><div class="social-history">S</div><p class="ad-hoc">A</p><p>t</p>', ["P", "S", "A", "t"]),
    ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>a <math><mi>x</mi></math></p></article>", ["T", "a x"]),
    ("<p><a href=x>only</a></p><p><a href=y>links</a></p>", ["only", "links"]),
    ('<div class="ad-slot">no</div><div class="comments-list">no</div><div class="site-header">no</div><div id=sidebar-left>no</div><ul><li><a href=x>no</a></ul><div><p>t</p></div>', ["t"]),
]


@pytest.mark.parametrize(("source", "want"), WHOLE)
def test_article_text_is_kept(source, want):
    assert extract(source, None) == "\n".join(w.strip() for w in want)


def test_areas_by_force(spark):
    """A host's boilerplate areas against a count over all its pages."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        parts = [f"<div class=story><h1>T{i}</h1><p>{rng.random()} words of the story</p></div>"]
        parts += [f"<div class=again><p>{rng.choice(['We say so.', 'And so on.'])}</p></div>"] * (i % 2)
        parts += [f"<div class=more><p><a href=x>link {i}</a> {i}</p></div>"] * (i % 3 > 0) + [f"<div class=rare><p>same</p></div>"] * (i < 2)
        parts += [f"<section><p>note {rng.random()}</p></section>"] * (i % 5 == 0)
        rows.append((i, f"http://h/{i}", f"<body>{''.join(parts)}</body>"))
    rows += [(100 + i, "http://h/copy", "<body><section class=old><p>one article many times</p></section></body>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    told = {r["host"]: r for r in host_paths(pages).collect()}["h"]
    areas = [[dict(zip(("area", "digest", "size", "links"), (p, *a))) for p, a in Page(h).areas().items()] for _, _, h in rows]
    found = defaultdict(list)
    for _, page in {h: a for (_, _, h), a in zip(rows, areas)}.items():
        for a in page:
            found[a["area"]].append(a)
    total = lambda all_, key: sum(a[key] for a in all_)
    poor = {p for p, all_ in found.items() if len(all_) >= 3 and (2 * total(all_, "links") > total(all_, "size") or 3 * len({a["digest"] for a in all_}) <= len(all_))}
    votes = Counter(common_path(a, poor)[0] for a in areas)
    path = max(votes, key=lambda p: votes[p])
    assert poor == {"/body/div.again", "/body/div.more"} and told["path"] == path and set(told["areas"].split("\n")) == poor
    got = {r["page_id"]: r["text"] for r in extract_pages(pages).collect()}
    assert got[3].startswith("T3\n") and "link" not in got[4] and "say" not in got[3] and got[1].endswith("same") and "note" in got[5]
    assert got[110] == "one article many times"


def test_two_templates_on_a_host(spark):
    one = "<body><div class=post><p>{}</p></div></body>"
    two = "<body><div class=post><p>one</p></div><div class=entry><h1>{}</h1><p>" + LONG + "</p></div></body>"
    rows = [(i, f"http://h/{i}", one.format(f"{LONG}{i}")) for i in range(20)] + [(100 + i, "http://h/x", two.format(f"T{i}")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[100 + i] == f"one\nT{i}\n{LONG.strip()}" for i in range(5)) and got[3] == f"{LONG}3"


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_pages(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        plain = (" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks)
        assert got[r["page_id"]] == "\n".join(b for b in plain if b)
