import html as entities
import re

import pytest
from helpers import SF

from siltstone.llm import html

PAGES = [
    ("", ""),
    ("<p>One  two\n three<p>Four &amp; five &eacute;", "One two three\n\nFour & five é"),
    ("<body><div id='menu'><a href=x>Home</a></div><div class=post><h1>T</h1><p>Long text of the article here. <a href=y>a link</a> and more.</p><p>Second.</p></div><div class='comments'><p>I disagree with all of this, at length, and then some.</p></div></body>", "T\n\nLong text of the article here. a link and more.\n\nSecond."),
    ("<main><article><header><h1>Title</h1></header><p>a<br>b</p><ul><li>x<li>y</ul><aside>no</aside><form>no</form><script>var a='<p>';</script></article></main><footer>f</footer>", "Title\n\na b\n\nx\n\ny"),
    ("<article><p>ok</p><div class='ad-box'>buy</div><div class='cookie-notice'>eat</div><table><tr><td>1<td>2</table></article>", "ok\n\n1\n\n2"),
    ("<nav>a</nav><p>x &lt;b&gt; <!-- c --> y", "x <b> y"),
    ("<article><h1>A</h1><p>b</p>", "A\n\nb"),
    ("< p >a < b", "< p >a < b"),
    ("<article><p>one</p><svg/><p>two</p><iframe src=x /><p>three</p><svg><svg><text>no</text></svg></svg><p>four</p></article>", "one\n\ntwo\n\nthree\n\nfour"),
    ("<article><p>one <iframe src=x> two</p><video><p>no</p></video><object>no</object><p>three</p></article>", "one two\n\nthree"),
    ("<div class='header-story'><article><p>kept here</p><div class='share-price'>12.5</div></article></div>", "kept here\n\n12.5"),
    ("<div class='header-story'><p>kept, too</p></div>", "kept, too"),
    ("<div id=sidebar-page><div class=comments><h1>On comments</h1><p>An article about them.</p></div></div>", "On comments\n\nAn article about them."),
    ("<div class=comments><p>nothing else is here</p></div>", "nothing else is here"),
    ("<main><p>The only text of this page.</p><ol class=commentlist><li><article class=comment-body><h4>me</h4><p>no</p></article></li></ol></main>", "The only text of this page."),
    ("<script>never closed <p>no", ""),
    ("<article><p title=it's>One two.</p><p title=5\">Three.</p><p>Four 'five' \"six\".</p></article>", "One two.\n\nThree.\n\nFour 'five' \"six\"."),
    ("<article><p><a title='it's'>One</a> two</p><p a='b'c=\"d>e\">three</p><p =x y>four</p></article>", "One two\n\nthree\n\nfour"),
    ("<article><p>x<a href=/b/>link</a> y</p></article>", "xlink y"),
    ("<article><h1>A</h1><p>first</p></article><div class=ad>no</div><article><h1>B</h1><p>second article of the page</p></article>", "A\n\nfirst\n\nB\n\nsecond article of the page"),
    ("<main><article><p>first part of it</p></article><article><p>second</p></article></main>", "first part of it\n\nsecond"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be the <span aria-hidden=true>known</span> solution.</p><xmp>if (a<b) &amp;</xmp></article>", "Let x=1 be the known solution.\n\nif (a<b) &amp;"),
    ("<article><p>The article.</p><div class='menu'><p>Our kitchen offers a soup of the day, fish from the lake and bread that we bake.</p></div><ul class=menu><li><a href=a>Home</a></ul></article>", "The article.\n\nOur kitchen offers a soup of the day, fish from the lake and bread that we bake."),
    ("<article><p>The article, as it was printed.</p><section id='user-feedback'><h3>12 Comments</h3><p>I disagree.</p></section><section><h3>3 Replies:</h3><p>No.</p></section><section><h3>Comments on method</h3><p>Kept.</p></section></article>", "The article, as it was printed.\n\nComments on method\n\nKept."),
    ("<article><p>one</p>" + "<iframe src=x>" * 3 + "<p>two</p></article>", "one\n\ntwo"),
    ("<!--><p>a</p><!---->b", "a\n\nb"),
]
TEXT = "This is a sentence of the article, long enough to look like one. " * 3
WITHOUT_ARTICLE = f"""<html><head><title>no</title></head><body><div id=top><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>Sport</a></li></ul></div>
<div class=page><div class=story><h1>Title</h1><p>{TEXT}</p><p>{TEXT}<a href=d>link</a> end.</p><ul><li>{TEXT}</li><li>short</li></ul><p>Last.</p></div>
<div class=teasers><a href=e>Read this</a> <a href=f>And that</a> <a href=g>And more</a></div><div class=user-comments><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div></div>
<div class=site-footer>(c) <a href=h>imprint</a></div></body></html>"""


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_density_alone_finds_the_article():
    t = TEXT.strip()
    assert html.main_text(WITHOUT_ARTICLE) == f"Title\n\n{t}\n\n{t} link end.\n\n{t}\n\nshort\n\nLast."


@pytest.mark.parametrize("name, noise", [("site-footer", True), ("commentsSection", True), ("ADS", True), ("related-stories", True), ("cookie-notice", True), ("menu_item_3", True), ("share-price", False), ("header-story", False), ("list", False), ("article", False), ("adhoc", False), ("row", False), ("cookie-recipe", False)])
def test_names(name, noise):
    assert html.is_noise_name(name) is noise


def plain(page):
    """The density rule by the definition, over a well-formed page: recursion over elements, counts by walking every subtree anew."""
    import math
    import xml.etree.ElementTree as Tree

    body = Tree.fromstring(page)
    parents = {k: e for e in body.iter() for k in e}

    def texts(e):
        yield e, e.text or ""
        for k in e:
            yield from texts(k)
            yield e, k.tail or ""

    def counts(e):
        linked = lambda x: x.tag == "a" or (x is not e and x in parents and linked(parents[x]))
        size = lambda t: len(" ".join(t.split()))
        return sum(size(t) for _, t in texts(e)), sum(1 for _ in e.iter()), sum(size(t) for x, t in texts(e) if linked(x)), sum(1 for x in e.iter() if linked(x))

    whole = counts(body)

    def density(e):
        c, t, lc, lt = counts(e)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log1p(base)

    order = list(body.iter())
    core = max(order, key=lambda e: (sum(density(k) for k in e), -order.index(e)))
    while core.tag not in html.LIFT:
        core = parents[core]
    path = [core]
    while path[-1] is not body:
        path.append(parents[path[-1]])
    least = min(density(e) for e in path)
    blocks = [""]

    def take(e):
        if e.tag in html.BLOCKS:
            blocks.append("")
        blocks[-1] += e.text or ""
        for k in e:
            take(k)
            blocks[-1] += k.tail or ""
        if e.tag in html.BLOCKS:
            blocks.append("")

    def visit(e):
        if e in path and e is not core:
            for k in e:
                visit(k)
        elif e is core or e.tag in ("h1", "h2") or density(e) >= least:
            take(e)

    visit(body)
    return "\n\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


@pytest.mark.parametrize("seed", range(8))
def test_density_against_its_definition(seed):
    import random

    r = random.Random(seed)

    def grown(depth):
        words = lambda n: " ".join(r.choices(["a", "word", "or", "another", "longer-one"], k=n))
        if not depth or r.random() < 0.2:
            return f"<p>{words(r.randrange(40))}<a>{words(r.randrange(1, 4))}</a> {words(r.randrange(10))}</p>" if r.random() < 0.6 else f"<ul>{''.join(f'<li><a>{words(2)}</a></li>' for _ in range(r.randrange(1, 6)))}</ul>"
        return f"<div>{'<h2>' + words(3) + '</h2>' if r.random() < 0.3 else ''}{''.join(grown(depth - 1) for _ in range(r.randrange(1, 5)))}</div>"

    for _ in range(25):
        page = f"<body>{grown(4)}{grown(2)}</body>"
        assert html.main_text(page) == plain(page)


def test_many_unclosed_raw_elements_take_linear_time():
    import time

    start = time.perf_counter()
    html.main_text("<iframe src=x>" * 40_000)
    html.main_text("<p " + "a='" * 40_000)
    html.main_text("<" * 40_000 + "<a " * 40_000)
    assert time.perf_counter() - start < 8


def test_pages_without_the_article_element(spark):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()
    same = 0
    for r in rows:
        bare = re.sub(r"(</?)article\b", r"\1div", r.html)
        same += html.main_text(bare) == html.main_text(r.html)
    print("same without article elements", same, len(rows))
    assert same >= 0.98 * len(rows)


def test_query_against_the_article_elements(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html.op6_html_extraction(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*)</article>", rows[r.page_id].html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_odd_rows(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    df = spark.createDataFrame([(1, None, None, 1), (1, "u", deep, 1), (None, "u", "<p>a", 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html.extract(df).collect()) == ["", "a", "x"]
    assert html.extract(df.limit(0)).count() == 0
