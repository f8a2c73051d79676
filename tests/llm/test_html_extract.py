import html
import random
import re

from codemap.llm import html_extract
from codemap.llm.html_extract import page_text, tree_match

SITE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style></head><body class="has-sidebar">
<div class="site-header"><h2>Site</h2></div><ul class="menu"><li><a href="/">Home</a></li></ul>
<div class="cookie-notice">We use cookies</div><div id="content"><h1>Title {i}</h1><div class="by">By the staff of this site</div>{body}
<p>Write to the editor about this text.</p></div><div class="box"><p>About this site and its owners.</p></div></body></html>"""


def pages(n=12, seed=1):
    rnd = random.Random(seed)
    say = lambda k: " ".join(f"w{rnd.randrange(500)}" for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        body = [say(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))]
        rows.append((i, f"http://www.one.example/{i}", SITE.format(i=i, body="".join(f"<p>{b}" for b in body))))
        want[i] = " ".join([f"Title {i}", *body])
    return rows, want


def test_constant_nodes_are_template(spark):
    rows, want = pages()
    # one page of another layout, one of another host, nulls, and pages of a host that is too small for a template
    rows += [(100, "http://www.one.example/x", "<p>Lone text.</p>"), (101, "http://two.example/", SITE.format(i=1, body="<p>b")), (102, None, "<p>no host"),
             (103, "http://www.one.example/y", None), (None, "not a url", ""), (0, rows[0][1], rows[0][2])]
    want |= {100: "Lone text.", 101: "Title 1 By the staff of this site b Write to the editor about this text. About this site and its owners.", 102: "no host", 103: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'t' as text")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want.get(r.page_id, ""), r.page_id
        assert r.n_chars == len(r.text)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_vote_once(spark):
    """Copies on one host, alone or beside other pages, keep their text; the others' template stays."""
    others, want = pages(12, seed=3)
    body = "<p>First of the copied page.</p><table><tr><td>only here</td></tr></table><p>Last of the copied page.</p>"
    text = "Title c First of the copied page. only here Last of the copied page."
    for n in (5, 60, 1000):
        copies = [(100 + i, f"http://www.one.example/copy{i}", SITE.format(i="c", body=body)) for i in range(n)]
        alone = [(5000 + i, "http://alone.example/same", "<article><h1>A</h1><p>Equal text.</p></article>") for i in range(n)]
        # mirrors: the same article in different pages round it
        mirrored = [(9000 + i, f"http://mirror.example/{i}", f"<nav>{i}</nav>{'<div>' * (i % 3)}<article><p>Mirrored.</p></article>") for i in range(n)]
        df = spark.createDataFrame(others + copies + alone + mirrored, "page_id long, url string, html string")
        got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
        expected = want | {i: text for i, _, _ in copies} | {i: "A Equal text." for i, _, _ in alone} | {i: "Mirrored." for i, _, _ in mirrored}
        assert got == expected


def test_article_markup():
    cases = {
        "<article><h1>A &amp; B&nbsp;c</h1><p>one<br>two <b>th</b>ree</p><script>var t='</p>';</script><div class='ad'>x</div><p>four<p>five</article><footer>f</footer>":
            "A & B c one two three four five",
        "<nav>n</nav><main><p>m</p><aside>s</aside><section class='comments'><article class='comment'><p>long long comment text</p></article></section></main>": "m",
        "<header>H</header><article><header><h1>T</h1><p>by X</p></header><p>x</p><form><label>l</label></form><table><tr><td>1<td>2<tr><td>3</table></article>": "T x 1 2 3",
        "<div class='article-body'><p>a<p>b</div><div class='newsletter-signup'>s</div><div id='comments'><p>c</div>": "a b",
        "<article><p>cut off <b>at the": "cut off at the",
        "<article><ul><li>one<li>two</ul><pre> a\n  b </pre><dl><dt>k<dd>v</dl></article>": "one two a b k v",
        "<p>x</p><!-- a <p>comment</p> --><p>&lt;y&gt; &#233;&#x4e2d;</p>": "x <y> é中",
        "<div class='page has-sidebar'><main><article><p>body</p></article></main></div>": "body",
        "<div role='navigation'>n</div><div hidden>h</div><div style='display: none'>d</div><p>t<span class='hidden'>u</span>v</p>": "t v",
        "": "", "no markup": "no markup", "<" * 50: "<" * 50, "<div>" * 5000 + "deep": "deep",
    }
    for source, want in cases.items():
        assert page_text(source)[0] == want, source[:60]


def test_names_inside_an_article_must_say_nothing_else():
    cases = {
        "<article><h2 id='related-work'>Related work</h2><p>a</article>": "Related work a",
        "<article><h3 id='comments'>Comments on the proof</h3><p>a</article>": "Comments on the proof a",
        "<article><h2 id='menu' class='menu'>The menu</h2><p>a</article>": "The menu a",
        "<article><section class='social-history'><p>a</section></article>": "a",
        "<article><div class='hidden-gem'>a</div><p class='notice-board'>b<p class='search-for-truth'>c</article>": "a b c",
        "<article><p>a</p><div class='ad-slot-3'>x</div><div class='related-posts'>x</div><div id='comments'><p>x</div><ul class='share_buttons'><li>x</ul><p>b</article>": "a b",
        "<article><p>a<div class='newsletter signup'>x</div><div class='cookie-notice'>x</div><aside>x</aside><form><p>x</form></article>": "a",
        "<form id='aspnet'><div><h1>T</h1><p>body of the page</p></div><nav>n</nav></form><footer>f</footer>": "T body of the page",
        "<p>the text of a page without an article</p><form><label>name</label><p>send</form>": "the text of a page without an article",
        "<form><article><p>a</p><form><p>x</p></form></article></form>": "a",
        "<h2 id='search'>Search</h2><p>is a word</p>": "Search is a word",
    }
    for source, want in cases.items():
        assert page_text(source)[0] == want, source[:60]


def test_long_alternating_pages_are_matched_in_bounded_memory():
    """Repeated groups are one group; siblings in no order are aligned row by row."""
    import resource
    import time
    rnd = random.Random(8)
    long = "<article>" + "".join(f"<h2>t{i}</h2><p>a</p><ul><li>b</ul>" for i in range(30_000)) + "</article>"
    assert len(long) > 1_000_000
    mixed = ["<body>" + "".join(rnd.choice(("<h2>t</h2>", "<p>a</p>", "<pre>c</pre>", "<h3>d</h3>", "<ul><li>e</ul>")) for _ in range(6_000)) + "</body>" for _ in range(2)]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    small = html_extract.skeleton(html_extract.Page(long).root)
    assert len(html_extract._dump(small)) < 200
    trees = [html_extract.skeleton(html_extract.Page(m).root) for m in mixed]
    pairs = tree_match(*trees)
    assert len(pairs) > 2_000 and pairs == sorted(pairs, key=lambda p: p[1])
    assert tree_match(trees[0], trees[0]) == [(i, i) for i in range(len(tree_match(trees[0], trees[0])))]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.time() - start < 60


def test_boilerplate_that_only_induction_finds(spark):
    """Neutral tags and class names: what all pages of the host say is template, what varies is content."""
    rnd = random.Random(9)
    say = lambda k: " ".join(f"w{rnd.randrange(900)}" for _ in range(k))
    rows, want = [], {}
    for i in range(30):
        parts = [say(rnd.randint(4, 30)) for _ in range(rnd.randint(1, 9))]
        rows.append((i, f"https://plain.example/{i}", "<html><body><div class='a'><p>Plain Example, since 1999</p></div><div class='b'><div class='c'>All sections of the house</div>"
                     + f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p><h2>{p} too</h2>" for p in parts) + "<p>Printed by the house</p></div><div class='d'><p>Write to us</p></div></body></html>"))
        want[i] = " ".join([parts[0], *(f"{p} {p} too" for p in parts)])
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_template == 4 for r in got)


def test_deep_nesting(spark):
    """Elements at any depth close their own start tag, and are dropped like others."""
    def deep(n, i=""):
        menu = "<nav><ul><li>menu</li></ul></nav><script>var s = 1;</script><aside>a</aside><form>f</form><div hidden>h</div>"
        return (f"<div><article><h1>T{i}</h1>{'<div>' * n}<p>in{i}</p>{menu}{'</div>' * n}<p>after{i}</p><p>end</p></article></div><footer>foot</footer>")

    for n in (10, 149, 150, 200, 5000):
        assert page_text(deep(n))[0] == "T in after end", n
    # over Spark, with a template: the constant text goes, at any depth
    rows = [(1000 * n + i, f"http://h{n}.example/{i}", deep(n, f" {i}").replace(f"<p>in {i}</p>", f"<p>same</p><p>in {i}</p>")) for n in (20, 200, 3000) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        i = r.page_id % 1000
        assert r.text == f"T {i} in {i} after {i}", r.page_id
    # many open elements and end tags that match none of them
    assert page_text("<x-a>" * 50_000 + "</x-b><td>" * 50_000 + "deep")[0] == "deep"


def test_given_pages_equal_their_articles(spark):
    """Articles of the test pages, cut out by a pattern that knows their markup."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in df.collect()}
    got = html_extract.extract(df).collect()
    assert len(got) == len(source)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        want = html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner)))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)


def brute_match(a, b):
    """Size of the largest matching, straight from the recursive definition."""
    if a[0] != b[0]:
        return 0

    def seq(xs, ys):
        if not xs or not ys:
            return 0
        return max(seq(xs[1:], ys), seq(xs, ys[1:]), seq(xs[1:], ys[1:]) + brute_match(xs[0], ys[0]))
    return 1 + seq(a[1:], b[1:])


def test_simple_tree_matching():
    rnd = random.Random(4)

    def tree(depth):
        return [rnd.choice("ab")] + [tree(depth - 1) for _ in range(rnd.randint(0, 3) if depth else 0)]

    size = lambda t: 1 + sum(map(size, t[1:]))
    for _ in range(200):
        a, b = tree(3), tree(3)
        pairs = tree_match(a, b)
        assert len(pairs) == brute_match(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        assert pairs == [] or max(x for x, _ in pairs) < size(a)
        assert sorted(pairs) == sorted(pairs, key=lambda p: p[1])
