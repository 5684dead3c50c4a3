import pytest
from pyspark.sql import functions as F

from parchmill.operators import convert as C
from parchmill.operators import extract as X

AS_OF = "2026-01-03 16:47:00"

# Noise of several kinds, before, between and inside the blocks of a text in nested containers.
HARBOUR = """
<html><head><title>Harbour log</title></head><body><header>The harbour office, open on every day with wind</header>
<div id="all"><div class="share-row">Tell your friends about our harbour, all of them, today</div>
<main><section><h2>Fog over the quay</h2><p>Two barges waited until the bell rang, and then a third.</p>
<div class="promo">Rope and tar at half the price, this week and next week only</div>
<ul><li>Nobody saw the lighthouse all day</li></ul>
<p>Towards the evening, the wind turned and the pilots went out.</p></section></main></div>
<nav><ol><li><a href="/tides">Tides</a></li></ol></nav>
<div class="related"><p>Storm of March, as the keeper of the light saw it</p></div></body></html>
"""
LONG = "<p>Some text that is long enough to be scored, really.</p>"


def convert(spark, *pages, columns="page_id long, url string, html string"):
    rows = [(i, "https://example.com/a/b", h) for i, h in enumerate(pages)]
    out = C.documents(spark.createDataFrame(rows, columns), AS_OF).orderBy("page_id").collect()
    return out


def body(row):
    return row.markdown.split("\n---\n\n", 1)[1].rsplit("\n\n---\n<!-- Fetched", 1)[0]


def test_main_content_drops_noise(spark):
    row = convert(spark, HARBOUR)[0]
    assert row.meta.title == "Harbour log"
    assert body(row) == (
        "## Fog over the quay\n\nTwo barges waited until the bell rang, and then a third.\n\n"
        "- Nobody saw the lighthouse all day\n\nTowards the evening, the wind turned and the pilots went out."
    )


TEXT = "<p>The ferry came in with the tide, and everybody went home on it.</p>"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        # Wrappers that only read like noise, closed and unclosed.
        (f'<body><div class="site has-ads">{TEXT}</div><footer>Office</footer></body>', 1),
        (f'<body><nav>Home</nav><div class="post comments-open"><article>{TEXT}{TEXT}', 2),
        # Within one, noise is still noise.
        (f'<body><div class="has-ads site">{TEXT * 4}<div class="ads">Rope, tar and sails for less than in the town</div></div></body>', 4),
        # Three quarters are not more than three quarters.
        (f'<body><article>{TEXT}</article><div class="comments">{TEXT * 3}</div></body>', 1),
        (f"<body><aside>{TEXT * 9}</aside><article>{TEXT}</article></body>", 1),
    ],
)
def test_noise_by_share(spark, page, expected):
    row = convert(spark, page)[0]
    assert body(row) == "\n\n".join([TEXT[3:-4]] * expected)


def test_header_of_an_article(spark):
    site = "<header><h1>The harbour office and all of its pages</h1></header>"
    page = f"<body>{site}<article><header><h1>Ferry</h1><p>A lead, short</p></header>{TEXT}</article>{site}</body>"
    assert body(convert(spark, page)[0]) == "# Ferry\n\nA lead, short\n\n" + TEXT[3:-4]
    tokens = X.drop_boilerplate(X.tag_tokens(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")))
    kept = [r.tag for r in tokens.orderBy("pos").collect() if not r.close]
    assert kept == ["body", "article", "header", "h1", "p", "p"]


def test_fallback_keeps_the_whole_page(spark):
    rows = convert(spark, "<div>Low tide at six</div>", "<p>Gulls on the roof</p>", "", "plain", None)
    assert [r.meta.title for r in rows] == ["Untitled"] * 5
    assert [body(r) for r in rows] == ["Low tide at six", "Gulls on the roof", "", "plain", ""]
    stated = convert(spark, "<title>Short note</title><meta name=author content=Ada><p>Gone fishing</p>")[0]
    assert (stated.meta.title, stated.meta.author) == ("Short note", "Ada")


def test_a_page_may_leave_its_body_tag_out(spark):
    page = "<title>Bare</title><nav>Somewhere else, with quite a few words to read</nav><p>The text of this page is long enough to count.</p>"
    row = convert(spark, page)[0]
    assert row.meta.title == "Bare" and body(row) == "The text of this page is long enough to count."


def test_metadata(spark):
    page = (
        "<meta property='og:title' content='OG &amp; T'><meta name='author' content=\"John Doe\"><meta name=description content='Desc'>"
        "<meta property='article:published_time' content='2025-01-15T23:30:00+05:00'><title>Other</title><article>" + LONG + "</article>"
    )
    byline = "<title>T</title><article><p class='lead byline'>By Jane Smith</p><time datetime='not a date'></time>" + LONG + "</article>"
    stated, other = convert(spark, page, byline)
    assert tuple(stated.meta) == ("OG & T", "John Doe", "2025-01-15", "Desc")
    assert other.meta.author == "By Jane Smith" and other.meta.publish_date == ""
    assert stated.markdown.startswith(
        "# OG & T\n\n**URL:** https://example.com/a/b\n**Author:** John Doe\n**Published:** 2025-01-15\n**Description:** Desc\n\n---\n\n"
    )
    assert stated.markdown.endswith("\n\n---\n<!-- Fetched: 2026-01-03T16:47:00Z -->\n")


RULES = [
    ("<h3>Ropes and knots</h3>", "### Ropes and knots"),
    ("<strong>heavy anchor</strong>", "**heavy anchor**"),
    ("<em>light breeze</em>", "_light breeze_"),
    ('<a href="https://quay.example">the quay</a>', "[the quay](https://quay.example)"),
    ("<a href=/>home</a> <a href=/x/>x</a>", "[home](https://example.com/) [x](https://example.com/x/)"),
    ("</ul><ul><li>A</li></ul>", "- A"),
    ("</pre></blockquote><blockquote><p>Q</p></blockquote><pre>c</pre>", "> Q\n\n```\nc\n```"),
    ("<p><code>a`b</code> <code>``</code> <code> </code>end</p>", "`` a`b `` ``` `` ``` end"),
    ("<pre>```\nx</pre>", "````\n```\nx\n````"),
    ("&#x0001F600; &#128; &#150;", "😀 € –"),
    ('<a href="../x y">up</a>', "[up](https://example.com/x%20y)"),
    ("<ul><li>hull</li><li>mast</li></ul>", "- hull\n- mast"),
    ("<ol start=3><li>A<li>B</ol><p>C", "3. A\n4. B\n\nC"),
    ("<ul><li>A<ul><li>B</li></ul></li><li>C</li></ul>", "- A\n    - B\n- C"),
    ("<ul><li><p>A</p><p>B</p></li></ul>", "- A\n\n    B"),
    ("<blockquote><p>Q<br>R</p></blockquote>", "> Q  \n> R"),
    ("<pre><code>a  b\n  &lt;c&gt; *</code></pre>", "```\na  b\n  <c> *\n```"),
    ("<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    ("<p><b>open <br><p>next", "**open**\n\nnext"),
    ("<p>x <mark>m</mark> <code>a_b</code></p>", "x <mark>m</mark> `a_b`"),
    ('<img src="i.png" alt="A">', "![A](https://example.com/a/i.png)"),
    ("<p>2 * 3 [x] a_b</p>", "2 \\* 3 \\[x\\] a\\_b"),
    ("<p># no</p><p>- no</p><p>1. no</p>", "\\# no\n\n\\- no\n\n1\\. no"),
    ("&lt;b&gt; &amp;amp; &#233;&#x1F600; &bogus;", "\\<b> &amp; é😀 &bogus;"),
    ('<p title="a > b">t</p>', "t"),
    ("a < b and c", "a < b and c"),
    ("<b><p>xx</p><p>yy</p></b>zz", "**xx**\n\n**yy**\n\nzz"),
    ('<a href="/u"><h3>tt</h3></a>after', "### [tt](https://example.com/u)\n\nafter"),
    ("<em><ul><li>a</li><li>b</li></ul></em>", "- _a_\n- _b_"),
    ("<strong>x<p>y</strong> z</p><p>w</p>", "**x**\n\n**y** z\n\nw"),
    ("<a href=/1>l<p>m</p>n</a> o", "[l](https://example.com/1)\n\n[m](https://example.com/1)\n\n[n](https://example.com/1) o"),
    ("<b><i><p>q</p></i></b>r", "**_q_**\n\nr"),
    ("<p><i><b>q</p>", "_**q**_"),
    ("<b><h2>H</h2></b><p><b>un</p><p>p</p><b><p>c</p></b><p>d</p>", "## **H**\n\n**un**\n\np\n\n**c**\n\nd"),
    ("</b></a><p>a</p><a name=x><p>v</p></a><a href=/e></a>", "a\n\nv"),
    ("<p>`<code>a```b``c</code> and <code>x</code></p>", "\\````` a```b``c ```` and `x`"),
    ("<pre>a ```` b</pre>", "`````\na ```` b\n`````"),
    ("&rarr; &eta; &frac12; &copy x &notit; &notin; &copyright; &ampx; &#0; &#xD800; &#99999999999;", "→ η ½ © x ¬it; ∉ ©right; &x; � � �"),
    ('<a href="/?a=1&copy=2&amp;c=&lt;&reg">t</a>', "[t](https://example.com/?a=1&copy=2&c=<®)"),
    ("<script>var t='</p>'</script><!-- c --><style>p{}</style>kept", "kept"),
]


def test_markdown_rules(spark):
    rows = convert(spark, *[html for html, _ in RULES])
    assert [body(row) for row in rows] == [expected for _, expected in RULES]


def test_unclosed_and_stray_tags(spark):
    pages = ["</div></nav><body><div><article>" + LONG + "<div class='share'>Share this with everybody you know</div>tail<p>end of it"]
    row = convert(spark, *pages)[0]
    assert body(row) == "Some text that is long enough to be scored, really.\n\ntail\n\nend of it"


def test_score_goes_to_the_container_around(spark):
    page = "<body><div><section>" + LONG + "</section><section>" + LONG + "</section><section>" + LONG + "</section></div><div>" + LONG + "</div></body>"
    clean = X.partition_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    best = X.main_content(X.container_tokens(clean)).first()
    # Three sections of 2 hand up 1 each, which beats any single block of 2.
    assert (best.tag, best.score) == ("div", 3.0)


def test_link_lists_lose(spark):
    links = "".join(f'<a href="/{i}">A link that has a long label, number {i}</a> ' for i in range(9))
    page = f"<body><div>{links}</div><div>{LONG}</div></body>"
    clean = X.partition_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    assert X.main_content(X.container_tokens(clean)).first().open_pos == 4


def test_result_does_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = C.documents(pages.repartition(int(n)), AS_OF).select("page_id", F.sha2("markdown", 256)).collect()
            seen.append(sorted(map(tuple, rows)))
        assert seen[0] == seen[1] and len(seen[0]) == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
