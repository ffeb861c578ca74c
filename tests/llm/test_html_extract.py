import random
import time

import pytest

from framealign.llm import html_extract as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="ad-free">
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- c --><div class="ad">Buy %d</div>
<article><h1>Head  &amp; &lt;%d&gt;</h1><p><b>Bold start<br><p>One
two&nbsp;&copy; three<p>Third <i>in</i>line&#33;</p><aside>Side</aside><div class="comments"><p>Reader</p></div></article>
<form><p>Mail?</p></form><footer>&copy; foot</footer></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame([(*r, "w", "h") for r in rows], "page_id long, url string, html string, wrapper string, host string").repartition(2)
    return {r.page_id: (r.text, r.n_chars) for r in X.extract_text(df).collect()}


def test_article_without_the_rest(spark):
    rows = [(i, "https://u@a.example.org:80/x", PAGE % (i, i)) for i in range(5)]
    rows += [(10, "http://b.example.org", None), (11, None, ""), (12, "nonsense", "just text  here"), (13, "http://c.example.org/", "<article><p>cut &am"), (14, "http://d.example.org", "<p>a<p>b</p><ul><li>x<li>y</ul>"), (15, "http://b.example.org", "<div>" + "<p>long text</p>" * 20000 + "</div>")]
    got = run(spark, rows)
    want = "Head & <%d>\nBold start\nOne two © three\nThird inline!"
    for i in range(5):
        assert got[i] == (want % i, len(want % i))
    assert got[10] == ("", 0) and got[11] == ("", 0) and got[12] == ("just text here", 14)
    assert got[13][0] == "cut &am" and got[14][0] == "a\nb\nx\ny" and got[15][0].count("\n") == 19999


def test_template_text_goes_where_no_element_tells(spark):
    page = '<div class="x"><span>Site name</span></div><div class="y"><p>Story %d</p><p>More of %d</p></div><div class="z">Imprint</div>'
    assert run(spark, [(i, "http://h.example.org", page % (i, i)) for i in range(4)])[2][0] == "Story 2\nMore of 2"


def test_copies_of_one_page_keep_their_text(spark):
    assert run(spark, [(i, "http://h.example.org", PAGE % (1, 1)) for i in range(3)])[0][0].startswith("Head & <1>")


def test_empty_table(spark):
    assert run(spark, []) == {}


def plain(items):
    return [(x.key if x.items is None else plain(x.items), x.optional, x.repeated) for x in items]


def test_alignment_finds_optional_and_repeated_groups():
    a = X.folded(["h", "p", "p", "p", "f"])
    assert plain(a) == [("h", False, False), ("p", False, True), ("f", False, False)] and a[1].mark == [1, 2, 3]
    b = X.folded(["h", "p", "ad", "f"])
    assert plain(X.aligned(a, b)) == [("h", False, False), ("p", False, True), ("ad", True, False), ("f", False, False)]
    c = X.folded(["h", "t", "p", "t", "p", "t", "p", "f"])
    assert plain(c)[1] == ([("t", False, False), ("p", False, False)], False, True)
    assert X.aligned(c, X.folded(["h", "f"]))[1].optional is True
    period = [f"x{k}" for k in range(9)]
    assert plain(X.folded(["a", *period * 3, "b"])) == [("a", False, False), ([(p, False, False) for p in period], False, True), ("b", False, False)]


def test_partners_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = X.partners(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_very_many_slots_end_soon():
    start = time.process_time()
    wrapper = X.Wrapper([])
    for page in range(3):
        wrapper.add([(f"div class={k * 7 % 20011 if k % 3 else page}", str(k)) for k in range(20_000)])
    assert time.process_time() - start < 60


@pytest.mark.parametrize("most", [X.MOST_BROADCAST, 0])
def test_hosts_of_plain_blocks_against_their_generator(spark, monkeypatch, most):
    """Pages of nothing but div and p: only the place in the expression and the texts of the host's pages tell what is main text."""
    monkeypatch.setattr(X, "MOST_BROADCAST", most)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for host in range(5):
        before = [(rng.choice(("div", "section")), text(4)) for _ in range(rng.randrange(1, 4))]
        after = [(rng.choice(("div", "section")), text(4)) for _ in range(rng.randrange(1, 4))]
        for page in range(8):
            blocks = [("h1", text(5))]
            if page % 2:
                blocks.append(("h2", text(3)))
            for _ in range(rng.randrange(1, 4)):
                blocks += [("p", text(12)), ("blockquote", text(6))]
            parts = [*before, *blocks, *after]
            i = len(rows)
            rows.append((i, f"http://h{host}.example.org/{page}", "".join(f"<{t}>{x}</{t}>" for t, x in parts)))
            want[i] = "\n".join(x for _, x in blocks)
    assert {k: v[0] for k, v in run(spark, rows).items()} == want


def test_one_path_at_two_places_is_two_slots(spark):
    """A table of paths, without the expression, can't tell the site's name from the story."""
    page = "<div>Site name</div><h2>Head %d</h2><div>Story %d</div><hr><h3>End</h3>"
    rows = [(i, "http://h.example.org", page % (i, i)) for i in range(4)]
    assert run(spark, rows)[2][0] == "Head 2\nStory 2"


def test_references_are_those_of_the_page(spark):
    assert run(spark, [(1, "http://h.example.org", "<p>a &am<b>p;</b> &lt<!-- x -->; &#65;</p>")])[1][0] == "a &amp; <; A"


def test_only_whole_texts_of_two_pages_are_template(spark):
    long = "x" * 70
    page = '<h1>Site</h1><div class="y"><p>Story %d</p><p>More</p></div><div class="z">' + long + "%d" + "y" * 20 + '</div><div id="post-%d"><h2>Same head</h2></div>'
    rows = [(9, "http://one.example.org", "<h1>Title</h1><p>a</p><p>b</p>"), *((i, "http://h.example.org", page % (i, i, i)) for i in range(4))]
    got = run(spark, rows)
    assert got[9][0] == "Title\na\nb"
    assert got[2][0] == f"Story 2\nMore\n{long}2{'y' * 20}\nSame head"
    assert run(spark, [(i, "http://h.example.org", f"<h1>Site</h1><p>{k}</p><p>b{k}</p>") for i, k in enumerate("aabb")])[0][0] == "a\nba"


def test_article_rule_holds_per_page(spark):
    new, old = "<article><p>New %d</p></article><p>Around</p>", '<div class="site">Site</div><div class="content"><p>Old %d</p></div>'
    rows = [(i, "http://h.example.org", (new if i % 2 else old) % i) for i in range(6)]
    rows += [(10, "no host", "<article><p>Own</p></article>"), (11, None, "<div><p>Plain</p></div>"), (12, "", "bare")]
    got = {k: v[0] for k, v in run(spark, rows).items()}
    assert got == {0: "Old 0", 1: "New 1", 2: "Old 2", 3: "New 3", 4: "Old 4", 5: "New 5", 10: "Own", 11: "Plain", 12: "bare"}


def test_every_slot_of_a_long_expression_stays():
    """A notice on two pages is template although over 20,000 slots are on one page only."""
    named = lambda n, s: "".join(f'<div class="{s}{"".join(chr(97 + int(d)) for d in str(k))}">{k}</div>' for k in range(n))
    notice = '<section class="end">Notice</section>'
    pages = [named(20_100, "x") + notice, named(3, "y"), '<h2 class="q">Own</h2>' + notice]
    made = X.Wrapper([])
    for page in pages:
        made.add(X.slots(page))
    assert len(made.items) == 20_105
    again = X.Wrapper.load(made.dump())
    assert [X._main_text(again, p) for p in pages[1:]] == ["0\n1\n2", "Own"]


def test_known_places_give_the_same_partners():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        at = {}
        for k, x in enumerate(a):
            at.setdefault(x, []).append(k)
        assert X.partners(a, b, at) == X.partners(a, b)


def test_large_wrappers_travel_once_per_group(spark, monkeypatch):
    """Beyond MOST_BROADCAST no page's row carries its host's wrapper."""
    monkeypatch.setattr(X, "SALTS", 2)
    page = '<div class="a">Site</div><h2>Head %d</h2>'
    df = X.with_host(spark.createDataFrame([(i, f"http://h{i % 3}.example.org", page % i) for i in range(60)], "page_id long, url string, html string"))
    rows = X._in_groups(df, X.infer_wrappers(df)).collect()
    assert sum(r.wrapper is not None for r in rows) <= 6 and sorted(r.page_id for r in rows if r.wrapper is None) == list(range(60))
