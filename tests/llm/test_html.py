"""Wrapper induction: what alignment finds without telling names, on deep, wide and template-only pages, and on Spark."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tessella.llm import htmltext


def plain(k, body=None):
    """A page without an article element or a telling name."""
    body = body if body is not None else f"<h1>Title {k}</h1><p>Daily report</p><p>Body {k} of the day</p><p>See you tomorrow</p>"
    return f'<body><div class="x"><a href="/">Home</a> <a href="/n">News</a></div><div class="y"><p>Welcome to a site of many words.</p></div><div class="z">{body}</div><div class="w">All rights are ours</div></body>'


WANT = "Title 1\n\nDaily report\n\nBody 1 of the day\n\nSee you tomorrow"


def test_the_wrapper_makes_the_result_where_no_name_tells():
    wrapper = htmltext.induce([plain(k) for k in range(2, 9)])
    assert htmltext.extract(plain(1), wrapper) == WANT
    without = htmltext.extract(plain(1))
    assert without != WANT and "Home News" in without and "All rights" in without


def test_neighbours_of_the_same_name_are_told_by_being_constant():
    page = lambda k: f"<body><div>Menu of it</div><div><h1>Title {k}</h1><p>Daily report</p></div><div>The end</div></body>"
    assert htmltext.extract(page(1), htmltext.induce([page(k) for k in range(2, 9)])) == "Title 1\n\nDaily report"


def test_a_body_that_holds_the_slots_loses_constant_parts_and_link_lists():
    page = lambda k: (
        f'<body><div class="x">Menu of it</div><div class="y"><h1>Title {k}</h1><p>Daily report</p></div><div class="z"><p>More {k}</p></div>'
        f'<ul><li><a href="/r">Other {k}</a></li></ul><div class="w">The end</div></body>'
    )
    wrapper = htmltext.induce([page(k) for k in range(2, 9)])
    assert htmltext.extract(page(1), wrapper) == "Title 1\n\nDaily report\n\nMore 1"


def test_names_only_break_ties():
    # all slots in a form: the name does not count, as nothing else is left
    page = lambda k: f'<body><form class="search"><div class="x">Menu</div><div class="y"><h1>Title {k}</h1><p>Text {k}</p></div></form></body>'
    assert htmltext.extract(page(1), htmltext.induce([page(k) for k in range(2, 9)])) == "Title 1\n\nText 1"
    # a varying advert beside the article is told by its name alone
    page = lambda k: f'<body><div class="ad">Buy {k} now</div><div class="y"><h1>Title {k}</h1><p>Text {k}</p></div></body>'
    assert htmltext.extract(page(1), htmltext.induce([page(k) for k in range(2, 9)])) == "Title 1\n\nText 1"


def test_a_part_of_the_body_with_nearly_all_text_is_the_article():
    long = "words of the story that go on and on. " * 9
    page = lambda k: f'<body><div>Buy {k} now</div><div><h1>Title {k}</h1><p>{long} {k}</p></div><div>Printed {k} times</div></body>'
    assert htmltext.extract(page(1), htmltext.induce([page(k) for k in range(2, 9)])) == f"Title 1\n\n{long}1"
    # a title in an element of its own is of the text, wherever it stands
    page = lambda k: f'<body><h1>Title {k}</h1><div><p>{long} {k}</p><p>End {k}</p></div></body>'
    assert htmltext.extract(page(1), htmltext.induce([page(k) for k in range(2, 9)])) == f"Title 1\n\n{long}1\n\nEnd 1"


def test_pages_that_are_all_template_or_alike_give_no_wrapper():
    assert htmltext.induce([plain(1)] * 9) == {}
    assert htmltext.induce([f"<body><p>Same</p><!-- {k} --></body>" for k in range(9)]) == {}
    assert htmltext.induce(["", "<p>"]) == {}
    assert htmltext.extract("<body><p>Same</p></body>", {}) == "Same"


def test_deep_and_wide_pages_are_aligned_in_bounded_time():
    began = time.time()
    deep = lambda k: "<body><p>same</p>" + "<div>" * 3000 + f"deep {k}"
    assert htmltext.extract(deep(9), htmltext.induce([deep(k) for k in range(8)])) == "deep 9"

    def wide(k):
        rng = random.Random(k)
        return plain(k, "".join(f"<{x}>text {rng.random()}</{x}>" for x in (rng.choice(["p", "h2", "div", "p"]) for _ in range(10_000))))

    wrapper = htmltext.induce([wide(k) for k in range(8)])
    text = htmltext.extract(wide(9), wrapper)
    assert wrapper["main"][-1] == "div.z" and text.count("\n\n") == 9999 and "Home" not in text
    assert time.time() - began < 60


def test_matching_is_simple_tree_matching():
    def size(x, y):  # by its definition, recursively
        if x.node.label != y.node.label:
            return 0
        n, m = len(x.below), len(y.below)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(x.below[i], y.below[j]))
        return best[n][m] + 1

    rng = random.Random(4)

    def grow(depth):
        tag = rng.choice(["div", "section", "div", "td"])
        return f"<{tag}>" + "".join(grow(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)) + f"</{tag}>"

    for _ in range(60):
        a, b = (htmltext.blocks_of(htmltext.parse("<body>" + grow(4) + grow(3) + "</body>")) for _ in range(2))
        matcher = htmltext.Matcher(a, b)
        pairs = matcher.pairs()
        assert len(pairs) == size(a, b) == matcher.match(a.kind, b.kind)
        assert all(x.node.label == y.node.label for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def texts(spark, pages):
    rows = [(k, "http://h/", x) for k, x in enumerate(pages)]
    return [r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_parts_are_confirmed_by_all_distinct_pages_of_a_host(spark):
    page = lambda k, last: f'<body><div class="y"><h1>Title {k}</h1></div><div class="z"><p>Body {k}</p></div><div class="w">{last}</div></body>'
    # copies of the page of smallest hash take no place among the pages drawn
    pages = [page(k, "Share this") for k in range(12)]
    h = F.xxhash64("html")
    first = spark.createDataFrame([(x,) for x in pages], "html string").orderBy(h).first()["html"]
    assert texts(spark, pages + [first] * 20)[:12] == [f"Title {k}\n\nBody {k}" for k in range(12)]
    # a part that the drawn pages share, and most pages of the host do not, stays
    many = [page(k, f"Own {k}") for k in range(40)]
    low = spark.createDataFrame([(page(k, "Same here"),) for k in range(4000)], "html string").orderBy(h).limit(8)
    got = texts(spark, many + [r["html"] for r in low.collect()])
    assert all(t.endswith("Same here") for t in got[40:]) and all(f"Own {k}" in t for k, t in enumerate(got[:40]))


def test_the_wrapper_changes_texts_on_spark(spark):
    got = texts(spark, [plain(k) for k in range(12)])
    assert got == [WANT.replace("1", str(k)) for k in range(12)]
    # one distinct page is read by its own landmarks, copies or not
    assert texts(spark, [plain(1)] * 5) == [htmltext.extract(plain(1))] * 5


def test_deep_pages_on_spark(spark):
    deep = ["<div>" * 1500 + f"deep {k}" for k in range(4)]
    assert texts(spark, deep) == [f"deep {k}" for k in range(4)]


def test_all_distinct_pages_of_a_host_are_aligned(spark):
    # one page of many has a paragraph outside of the main node, and its hash is the largest
    pages = [plain(k) for k in range(60)]
    odd = [plain(1).replace('<div class="w">', f'<div class="v"><p>Correction {k} to the report</p></div><div class="w">') for k in range(200)]
    odd = spark.createDataFrame([(x,) for x in odd], "html string").orderBy(F.xxhash64("html").desc()).first()["html"]
    got = texts(spark, [*pages, odd])
    assert got[:60] == [WANT.replace("1", str(k)) for k in range(60)]
    assert got[60].startswith(WANT + "\n\nCorrection ") and got[60].endswith(" to the report")
    # it has no say in what the main node of the others is, though a few more say so together
    few = htmltext.induce([*pages, odd])
    assert few["main"][-1] == "div.z" and htmltext.extract(odd, few) == got[60]
    # a text that the pages of smallest hash share by chance is none of the template
    h = F.xxhash64("html")
    page = lambda k, end: plain(k).replace('<div class="w">All rights are ours', f'<div class="w"><p>{end}</p>')
    low = spark.createDataFrame([(page(k, "Signed by all"),) for k in range(3000)], "html string").orderBy(h).limit(8).collect()
    got = texts(spark, [page(k, f"Signed by {k}") for k in range(50)] + [r["html"] for r in low])
    assert all(x.endswith(f"Signed by {k}") for k, x in enumerate(got[:50])) and all(x.endswith("Signed by all") for x in got[50:])


def test_each_layout_of_a_host_has_its_wrapper(spark):
    other = lambda k: f'<body><div class="top">Places to go</div><div class="a"><div class="b"><h2>Note {k}</h2><p>Words of note {k}</p></div></div><div class="end">Printed in town</div></body>'
    got = texts(spark, [plain(k) for k in range(30)] + [other(k) for k in range(20)])
    assert got == [WANT.replace("1", str(k)) for k in range(30)] + [f"Note {k}\n\nWords of note {k}" for k in range(20)]
    # a layout of fewer pages is read with the common one, and where it lacks its main node by its own landmarks
    got = texts(spark, [plain(k) for k in range(30)] + [other(k) for k in range(2)])
    assert got[:30] == [WANT.replace("1", str(k)) for k in range(30)] and got[30:] == [htmltext.extract(other(k)) for k in range(2)]


def test_sums_do_not_depend_on_how_pages_are_dealt():
    pages = [plain(k) for k in range(20)] + [plain(k).replace("<p>Daily report</p>", "") for k in range(20, 25)]
    layout = htmltext.Layout(htmltext.blocks_of(htmltext.parse(pages[0])))
    whole, parts = layout.nothing(), [layout.nothing() for _ in range(3)]
    for k, page in enumerate(pages[1:]):
        layout.add(whole, htmltext.blocks_of(htmltext.parse(page)))
        layout.add(parts[k % 3], htmltext.blocks_of(htmltext.parse(page)))
    assert (sum(parts) == whole).all() and layout.wrapper(whole, 24)["main"][-1] == "div.z"


def test_pages_that_differ_in_no_text_are_copies():
    alike = [plain(1) + f"<!-- {k} -->" for k in range(95)]
    wrapper = htmltext.induce(alike + [plain(k) for k in range(2, 7)])
    assert htmltext.extract(alike[0], wrapper) == WANT and htmltext.extract(plain(5), wrapper) == WANT.replace("1", "5")
    # what one page of many copies changes is not the text of all
    assert htmltext.induce([*alike, plain(1).replace("All rights", "Few rights")]) == {}
