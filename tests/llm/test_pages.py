"""Main text by markup rules on single pages, and template removal across pages of a host."""

import random
import time

import pytest

from postlake.llm.pages import blocks, extract, without


def _text(page):
    return " ".join(blocks(page).texts)


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<nav>menu</nav><article><h1>T</h1><p><b>a <i>b</i>c<br><p>d\n  e &eacute;&#x41;&am</p></article><footer>f</footer>", "T a bc d e éA&am"),
    ("<div class='sidebar-right'>x</div><div id=content><p>yes</div><div class='userComments'>no</div>", "yes"),
    ("<div class='has-sidebar'><article>in<aside>no</aside> on</article></div>", "in on"),
    ("<script>var a='</p>'; if (a<b) x('<article>')</script><style>p{}</style>text<!-- <p>no</p> -->s", "texts"),
    ("<p>a<span class='ad'>buy <span>this</span> now</span>b", "a b"),
    ("<form><input><label>q</label></form><main>m<ul><li>1<li>2</ul></main>", "m 1 2"),
    ("<article>one<section id='comments'><article class='comment'>two</article></section></article>", "one"),
    ("<article>x<header>h</header>y</article>", "x y"), ("a < b and c > d", "a < b and c > d"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"), ("<p title=\"a>b\">t</p>", "t"),
    ("<article><h2 class='section-header'>Results</h2><p class='notice-period'>Three months</p><p>Body</p><math>x = 2</math>"
     "<div class='related-work'>Earlier work</div><div class='ad'>buy</div><p class='notice'>yes</p></article>", "Results Three months Body x = 2 Earlier work yes"),
    ("<p>open <b", "open <b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
])
def test_markup(page, want):
    assert _text(page) == want


def test_deep_pages_cost_no_more_than_long_ones():
    """Text at every depth: what is kept of a page, and the time it takes, grow with its length alone."""
    times = []
    for n in (1_000, 16_000):
        start = time.process_time()
        page = blocks("<div>x" * n)
        times.append(time.process_time() - start)
        assert len(page.texts) == len(page.marks) == len(page.around) == n
    assert times[1] < 40 * times[0] + 1
    assert without(page, {page.marks[5]}) == ["x"] * 5 and without(page, set()) == page.texts


def _slow(rows, least):
    """The same, page by page: every subtree around a block is looked up among those counted on the host."""
    counts, out = {}, []
    for host in {h for h, _ in rows}:
        for page in {p for h, p in rows if h == host}:
            for tree in set(blocks(page).trees):
                counts[host, tree] = counts.get((host, tree), 0) + 1
    for host, html in rows:
        page, kept = blocks(html), []
        for text, i in zip(page.texts, page.inside, strict=True):
            chain = []
            while i >= 0:
                chain.append(page.marks[i])
                i = page.around[i]
            if all(counts[host, tree] < least for tree in chain):
                kept.append(text)
        out.append(" ".join(kept))
    return out


def test_templates_equal_a_page_by_page_count(spark):
    rng = random.Random(9)

    def tree(depth):
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.6 else f"<p>{rng.choice('abcdefgh')}</p>" for _ in range(rng.randrange(1, 4)))
        return f"<{(tag := rng.choice(['div', 'section', 'ul']))}>{inner}</{tag}>"
    rows = [(f"h{rng.randrange(3)}", rng.choice(["", "<article>{}</article>"]).format("") + tree(3)) for _ in range(120)]
    rows += [(h, f"<article>{p}<p>own {i}</p></article>") for i, (h, p) in enumerate(rows[:40])]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    got = [r.text for r in extract(pages, min_pages=4).orderBy("page").collect()]
    assert got == _slow(rows, 4) and got != [" ".join(blocks(p).texts) for _, p in rows]


def test_long_and_deep_pages():
    assert len(_text("<article>" + "<p>word &amp; " * 50_000)) == 50_000 * 7 - 1
    assert _text("<div>" * 20_000 + "x") == "x"
    assert _text("<a \"" * 2_000) != ""


def test_recurring_subtrees_go(spark):
    rows = [(i, "http://a.org/x", f"<div><div><p>Best of the site</p></div><div><p>story {i}</p><p>end</p></div></div>", "h")
            for i in range(8)]
    rows += [(100 + i, "http://b.org/x", f"<article><div>Share it</div><p>Same words</p><p>text {i}</p></article>", "h") for i in range(6)]
    rows += [(200, "http://c.org", "<div>Best of the site</div>", "h"), (None, None, None, None), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r.page: r.text for r in extract(pages).collect()}
    assert got[3] == "story 3" and got[102] == "Same words text 2" and got[200] == "Best of the site" and got[None] == ""
    assert extract(pages).count() == len(rows)
    assert extract(pages.limit(0)).count() == 0


def test_a_block_of_one_section_goes_on_hosts_of_every_size(spark):
    """A notice on five pages goes, be there six pages on the host or six hundred; one on four stays on both."""
    rows = [(host, i, f"http://{host}/x", f"<div><div><p>Notice of {'five' if i < 5 else 'four' if i < 9 else i}</p></div><p>story {i}</p></div>")
            for host, n in (("small.org", 10), ("big.org", 600)) for i in range(n)]
    got = {(r.url, r.page): r.text for r in extract(spark.createDataFrame(rows, "host string, page_id long, url string, html string")).collect()}
    for host in ("small.org", "big.org"):
        assert [got[f"http://{host}/x", i] for i in (4, 8)] == ["story 4", "Notice of four story 8"]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://a.org/{i}", "<div><p>one text</p></div>" if i < 20 else f"<p>{i}</p>") for i in range(30)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page < 20").collect()
    assert [r.text for r in got] == ["one text"] * 20


@pytest.mark.parametrize(("page", "want"), [
    ("<p data-x=\"" + "a" * 6_000 + "<b>LEAK</b> more\">text</p>", "text"), ("<p data-x='" + "a>" * 500_000 + "'>text</p>", "text"),
    ("<div data-x='{" + " " * 6_000 + "\"hidden\": true, class=\"ad\" <nav>}' id=content>text</div>", "text"),
    ("<p title=it's>one</p><p>isn't</p>", "one isn't"), ("<p title=\"open>one</p><p>two</p>", "one two"),
    ("<p a = 'x>y' b=\"'>\" c=d/>t</p>", "t"), ("<p a=>t</p>", "t"), ("x <a <b<!-- c", "x <a <b"), ("<p a=\"b", "<p a=\"b"),
])
def test_attributes_of_any_length(page, want):
    assert _text(page) == want


@pytest.mark.parametrize("page", ["<a b=\"", "<a b='c\" d=\"'", "<a b=\">\"", "<a b=\">'", "<a ", "<a<", "<a b='\"' c=\"", "<a b= \"'\">"])
def test_unclosed_quotes_cost_little(page):
    times = []
    for n in (20_000, 160_000):
        start = time.process_time()
        blocks(page * n)
        times.append(time.process_time() - start)
    assert times[1] < 30 * times[0] + 1
