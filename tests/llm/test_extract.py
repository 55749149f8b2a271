import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tempolens.llm import extract as X
from tempolens.llm.queries import op4_html_extraction

from .helpers import frame, got, save

SCHEMA = "page_id long, url string, html string"
COLS = ("page_id", "url", "text", "n_chars")


def article(page):
    """The text of the pages' one article, cut out by patterns."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>", inner.group(1)) if inner else []
    plain = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
    return " ".join(b for b in plain if b)


def test_query_on_pages(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    want = sorted(((r.page_id, r.url, t := article(r.html), len(t)) for r in rows), key=repr)
    assert got(op4_html_extraction(spark, sf), *COLS) == want


PAGES = [
    ("<p>one<p>two <b>bo</b>ld<br>next&nbsp;&amp;&lt;x&gt; &am", "one two bold next &<x> &am"),
    ("<html><head><title>T</title></head><body><header>H</header><main><header>Top</header><p>text</p></main><footer>F</footer>", "Top text"),
    ("<article>a<form>f</form><div class='comments'>c</div><script>var s='</p>';</script><p hidden>h</p>z</article>", "a z"),
    ("<div class=sidebar>s</div><div id='cookie-notice'>k</div><div role=navigation>n</div><ul><li>x<li>y</ul>after", "x y after"),
    ("<table><tr><td>1<td>2<tr><td>3</table><!-- no --> <style>p{}</style>5 < 6 &#233;", "1 2 3 5 < 6 é"),
    ("<div>open <i>in<div>ner</i> tail</div></nonsense></div>", "open in ner tail"),
    ("<!-- never closed <p>gone", ""), ("", ""), (None, ""), ("no markup at all", "no markup at all"), ("<p title='>'>quoted</p>", "quoted"),
    ("<p title=\"open>text", "text"), ("<nav>only</nav>", ""), ("<textarea>t</textarea><button>b</button>left", "left"), ("a" * 300_000, "a" * 300_000),
]


def test_edges(spark, tmp_path):
    rows = [(i, f"http://h{i}.example/x" if i % 3 else None, h) for i, (h, _) in enumerate(PAGES)]
    docs = frame(spark, [*rows, rows[1], (None, None, None)], SCHEMA).selectExpr("*", "'x' as host", "1 as nodes", "2 as text", "3 as page")
    want = [(i, u, PAGES[i][1], len(PAGES[i][1])) for i, u, _ in [*rows, rows[1]]] + [(None, None, "", 0)]
    assert got(op4_html_extraction(spark, save(tmp_path, pages=docs)), *COLS) == sorted(want, key=repr)
    assert X.extract_text(frame(spark, [], SCHEMA)).count() == 0


def site(n, notice, body):
    return [(i, f"https://WWW.site.example:80/{i}", f"<body><div class='y1'>{notice}</div><div class='x{i % 7}2'>{body(i)}</div><div>word {i % 3}</div></body>")
            for i in range(n)]


def test_branches_that_repeat_over_a_site_go(spark):
    rows = site(40, "the same line on each page", lambda i: f"<p>story {i}</p><p>and its end {i * 31}</p>")
    out = {r.page_id: r.text for r in X.extract_text(frame(spark, rows, SCHEMA)).collect()}
    assert out == {i: f"story {i} and its end {i * 31}" for i in range(40)}


def test_few_pages_prove_nothing_and_a_page_of_copies_stays(spark):
    rows = site(3, "seen thrice", lambda i: "story")
    assert {r.text for r in X.extract_text(frame(spark, rows, SCHEMA)).collect()} == {f"seen thrice story word {i}" for i in range(3)}
    copies = [(i, "http://c.example/", "<div>all pages say this</div>") for i in range(30)]
    assert {r.text for r in X.extract_text(frame(spark, copies, SCHEMA)).collect()} == {"all pages say this"}


def test_importance_by_hand(spark):
    """Four presentations and ten texts over 40 pages, ten presentations of one element each."""
    rows = site(40, "same", lambda i: f"<p>t{i % 10}</p>")
    low = X.low_nodes(frame(spark, rows, SCHEMA).selectExpr("'h' as host", "html"), low=2.0).first().nodes
    import math
    m = math.log(40)
    tree = X.parse(rows[0][2])
    labels = dict(zip(tree.path, tree.prior))
    assert set(low) == set(labels)
    notice = tree.path[1]
    assert abs(low[notice] - (0.9 * 0 + 0.1 * 0)) < 1e-9  # one presentation, one text on all pages
    story = 1 - math.log(4) / m
    assert abs(low[tree.path[2]] - 0.9 * story) < 1e-9
    last = tree.path[4]
    assert abs(low[last] - 0.9 * (1 - (math.log(14) + 2 * math.log(13)) / 3 / m)) < 1e-9


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/pdivbra \"'=!-&;x\n"), max_size=80))
def test_any_text_is_parsed(page):
    t = X.parse(page)
    assert all(p < k for k, p in enumerate(t.parent)) and all(s and s == " ".join(s.split()) for _, s in t.blocks)
    X.main_text(t, {})


TEXT = "the text of the page, which is longer than what stands around it"
WRAPPED = [
    (f"<body class='has-sidebar'><p>{TEXT}</p></body>", TEXT),
    (f"<div id='content-sidebar-wrap'><article>{TEXT}</article><div class=sidebar>s</div></div>", TEXT),
    (f"<main class='with-sidebar'>{TEXT}</main><footer>f</footer>", TEXT),
    (f"<article class='post comments-open'>{TEXT}</article><div class='comments'><article class='comment'>c</article></div>", TEXT),
    (f"<form id='aspnetForm'><div id='page'><div class='menu'>m</div><p>{TEXT}</p></div></form>", TEXT),
    (f"<form><main><p>short</p></main></form><nav>{TEXT}</nav>", "short"),
    (f"<main>{TEXT}</main><div class='comments'>{TEXT * 3}</div>", TEXT),
    (f"<div class='share'>ab</div><aside>{TEXT}</aside><div class='related'>abc</div><nav>{TEXT * 2}</nav>", TEXT),
    (f"<div style='display:none'><p>{TEXT}</p></div><div class='popup'>p</div>", TEXT),
]


def test_names_of_wrappers_do_not_cut_the_page():
    assert [X.main_text(X.parse(h), {}) for h, _ in WRAPPED] == [t for _, t in WRAPPED]


REPLY = "<div class='c'><span class='author'>Ann</span> <time>3 May</time><p>a reply by a reader</p></div>"
INSIDE = [
    ("<article><p>The <span class='share'>market share</span> rose.</p></article>", "The market share rose."),
    ("<article><p>See the <a class='menu'>File menu</a>.</p></article>", "See the File menu."),
    ("<article><h2 id='related-work'>Related work</h2><p>x</p></article>", "Related work x"),
    ("<article><section id='social-effects'><p>of it</p></section></article>", "of it"),
    ("<p>(<span class='ad'>one</span>)</p>", "(one)"),
    ("<article><p>x</p><div class='ad-slot'>buy</div><div class='share'>s</div><ul class='related-posts'><li>r</ul></article>", "x"),
    (f"<article>short</article><section class='comments'><article class='comment'>{TEXT}</article></section>", "short"),
    (f"<article>{TEXT}</article><div id='reviews'><h3>Reviews</h3>{REPLY * 2}</div>", TEXT),
    (f"<article>{TEXT}<div class='discussion'>{REPLY * 3}</div><p>end</p></article>", TEXT + " end"),
    (f"<article>{TEXT}<article><a rel=author>Bo</a> <time>1 May</time> one reply</article></article>", TEXT),
    ("<main>" + "<article><span class='author'>Ann</span> <time>3 May</time><p>a post</p></article>" * 2 + "</main>", "Ann 3 May a post Ann 3 May a post"),
    (f"<main>{REPLY * 2}</main>", "Ann 3 May a reply by a reader Ann 3 May a reply by a reader"),
    (f"<article><div class='byline'><span class=author>Ann</span> <time>3 May</time></div><p>{TEXT}</p></article>", f"Ann 3 May {TEXT}"),
]


def test_names_in_articles_and_comments_by_structure():
    assert [X.main_text(X.parse(h), {}) for h, _ in INSIDE] == [t for _, t in INSIDE]


def test_copies_count_once_and_single_blocks_stay(spark):
    def page(i):
        return (f"<body><div class='top'>the same line stands here</div><div class='story'><p>This is the long body of article {i % 5}, found under four addresses</p>"
                f"</div><div class='count'>seen {i * 37} times</div></body>")
    rows = [(i, f"http://copies.example/{i}", page(i)) for i in range(20)]
    rows += [(100 + i, f"http://method.example/{i}",
              f"<body><div class='top'>the same line stands here</div><div class='text'><h2>{'Method' if i % 2 else 'Introduction'}</h2><p>Paragraph {i} says what was found in trial {i * 31}</p>"
              f"<table><tr><td>yes</td><td>no</td></tr><tr><td>trial</td><td>{i * 31}</td></tr></table></div></body>") for i in range(40)]
    rows += [(200 + i, f"http://post.example/{i}", f"<article class='post'><h2 class='section'>Method</h2><p>The long body of article {i % 5}, found under many addresses</p>"
              f"</article><div class='count'>seen {i * 37} times</div>") for i in range(100)]
    out = {r.page_id: r.text for r in X.extract_text(frame(spark, rows, SCHEMA)).collect()}
    for i in range(20):
        assert f"This is the long body of article {i % 5}, found under four addresses" in out[i]
    for i in range(40):
        assert out[100 + i] == f"{'Method' if i % 2 else 'Introduction'} Paragraph {i} says what was found in trial {i * 31} yes no trial {i * 31}"
    for i in range(100):
        assert f"Method The long body of article {i % 5}, found under many addresses" in out[200 + i]


def test_a_rare_notice_of_a_large_host_goes(spark):
    notice = "<div class='y'>the same line on some pages</div>"
    rows = [(i, "http://large.example/", f"<body>{notice if i < 6 else ''}<div class='x'><p>story {i} and its end {i * 31}</p></div></body>") for i in range(700)]
    out = {r.page_id: r.text for r in X.extract_text(frame(spark, rows, SCHEMA)).collect()}
    assert out == {i: f"story {i} and its end {i * 31}" for i in range(700)}
