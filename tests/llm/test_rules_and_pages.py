from __future__ import annotations

import re
from collections import Counter

import pytest

from adpulse.llm import page_text as pt
from adpulse.llm import rule_cascade as rc

TEXTS = ["", None, " \n\t", "one two", "a b c a b c", "a a a a", "x y z " * 40, "l1 w\nl1 w\n\n \nl1 w", "ß ä#&|<> über " * 30, "\x0ba\x0cb\rc", "W! " * 60, " ".join(f"w{i}" for i in range(80)),
         "A B C D. " * 3 + " ".join(f"word{i}" for i in range(60)), "nb\xa0sp\u2003em one"]


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeat = {i + s for i, w in enumerate(windows) if n[w] > 1 for s in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeat))


def test_measures_equal_brute_force():
    for t in TEXTS:
        d = rc.Doc((t or "").encode())
        assert tuple(getattr(d, m) for m in rc.MEASURES) == brute(t), t


def test_order_is_by_rejections_per_cost_and_stops_early():
    calls = []
    rule = lambda name, answer: rc.Rule(name, lambda d: calls.append(name) or answer)
    rules = [rule("dear", True), rule("cheap", True), rule("never", False)]
    order = rc.ordered(rules, [rc.Estimate("dear", 1.0, .9), rc.Estimate("cheap", .01, .5), rc.Estimate("never", .001, 0.0)])
    assert [r.name for r in order] == ["cheap", "dear", "never"]
    assert rc.rejected_by(rc.Doc(b"x"), order) == "cheap" and calls == ["cheap"]


def test_verdicts_and_cascade(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, "one two", "k"), (None, "x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(2)
    got = sorted(map(tuple, rc.verdicts(df).collect()), key=str)
    want = []
    for i, t, _ in rows:
        m = brute(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((i, *m, failed, rc.rejected_by(rc.Doc((t or "").encode()), (*rc.BASE, *rc.STANDARD)) is None))
    assert got == sorted(want, key=str)
    left = rc.cascade(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if w[-1])
    assert rc.estimate(df, rc.STANDARD, sample_docs=4) and rc.verdicts(df.limit(0)).collect() == []


def test_estimates_are_of_what_a_rule_meets(spark):
    import time

    long, junk = " ".join(f"w{i}" for i in range(100)), "a a a a"
    df = spark.createDataFrame([(i, long if i % 2 else junk) for i in range(20)], "doc_id long, text string")
    slow = lambda d: time.sleep(.002) or False
    rules = [rc.Rule("known", lambda d: d.n_repeat_words < 0), rc.Rule("slow", slow), rc.Rule("half", lambda d: d.n_words < 50), rc.Rule("all", lambda d: d.n_words > 50)]
    met = {e.name: e for e in rc.estimate(df, rules, base=rc.BASE, measured=rc.MEASURES)}
    assert met["half"].selectivity == 0 and met["all"].selectivity == 1 and met["slow"].cost > .0015 > 10 * met["known"].cost
    assert {e.name: e.selectivity for e in rc.estimate(df, rules)}["half"] == .5
    assert rc.estimate(df.where("doc_id % 2 = 0"), rules, base=rc.BASE) == [] and len({r.name for r in rc.STANDARD}) == len(rc.STANDARD)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head>
<body><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><!-- <p>not this</p> -->
<div class="ad">Buy this now and then and again</div><article><h1>Head &lt;1&gt;</h1><p><b>First
  par&nbsp;agraph &eacute; with words<br><p>Second one, a&amp b <a href="x>y">link</a> end</p><div class="comments"><p>A reader comment</p></div><p></p>
<form><input value=q>Sign up</form><p>Third para of the text</article><footer>&copy; somebody and some more words</footer>"""
TRUE = "Head <1>\n\nFirst par agraph é with words\n\nSecond one, a& b link end\n\nThird para of the text"


def pages():
    body = "".join(f"<p>{'word ' * n}</p>" for n in (1, 30, 12, 4))
    return [PAGE.replace("Third para of the text", "Third " + "w " * i) for i in range(3)] + [
        f"<html><body><nav><a href=/>x {'y ' * i}</a></nav><div class=ad>{'buy ' * (i + 5)}</div><article><h1>t</h1>{body}</article><footer>f {'g ' * i}</footer></body></html>" for i in range(12)]


def test_main_text_of_labelled_kinds():
    weights = pt.learn([pt._skeleton(p) for p in pages()])
    assert all(w < 0 for w in weights.values())
    assert pt.main_text(PAGE, weights) == TRUE
    for p in pages()[3:]:
        assert pt.main_text(p, weights) == "t\n\nword\n\n" + "\n\n".join(" ".join(["word"] * n) for n in (30, 12, 4))
    for odd in ["", None, "<", "<p", "plain words", "<!-- open", "<script>x", "</p></div>", "&#0;&bogus;&", "<p " + "a=\"" * 50]:
        assert isinstance(pt.main_text(odd, weights), str)
    assert pt.main_text("plain  words\n here", weights) == "plain words here"


def test_best_region_equals_brute_force():
    import itertools
    import random
    random.seed(1)
    for _ in range(200):
        s = [random.choice([-3, -1, 0, 1, 2]) for _ in range(9)]
        a, b = pt.best_region([], s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i, j in itertools.combinations(range(10), 2))])


INSIDE = {
    "named inline": ('<p>The <span class="search-term">fox</span> by <a class="related-link" href=x>Jane Roe</a> ran</p>', "The fox by Jane Roe ran"),
    "names that only hold one": ('<p class="share-price">ten dollars</p><div class="notice-of-sale">sold</div>', "ten dollars\n\nsold"),
    "a list of links": ("<ul>" + "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(12)) + "</ul>", "\n\n".join(f"item {i}" for i in range(12))),
    "a table": ("<table>" + "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(15)) + "</table>", "\n\n".join(f"{i}\n\nx" for i in range(15))),
    "headings": ("".join(f"<h3>Part {i}</h3>" for i in range(15)), "\n\n".join(f"Part {i}" for i in range(15))),
    "quotes": ("".join(f"<blockquote>quote {i}</blockquote>" for i in range(8)), "\n\n".join(f"quote {i}" for i in range(8))),
    "formulas": ("<p>as <math><mi>x</mi><mo>=</mo><mn>2</mn></math> shows</p>", "as x=2 shows"),
    "what stands in for another": ("<p><noscript>no script</noscript> <object data=x>an object</object> <canvas>a canvas</canvas> <svg><text>a label</text></svg></p>",
                                   "no script an object a canvas a label"),
    "a side note": ("<aside><ul>" + "<li>x</li>" * 30 + "</ul></aside><div class='reader-comments'><p>me first</p></div><div class='share-buttons'>tell all</div>", ""),
}


@pytest.mark.parametrize("kind", INSIDE)
def test_article_text_is_whole(kind):
    """Of tags that no labelled article holds, and that menus and junk of the labelled pages do hold."""
    weights = pt.learn([pt._skeleton(p) for p in [*pages(), *(p.replace("<div class=ad>", "<div><h3><a>") for p in pages())]])
    mid, text = INSIDE[kind]
    first, last = "An opening paragraph with a fair number of words in it.", "A closing paragraph with a fair number of words in it too."
    page = (f"<html><body><nav><ul><li><a>Menu</a></li><li><a>Other menu</a></li></ul></nav><article><h1>Title</h1><p>{first}</p>{mid}<p>{last}</p></article>"
            "<footer>copyright</footer></body></html>")
    assert pt.main_text(page, weights) == "\n\n".join(x for x in ("Title", first, text, last) if x)


def test_weights_are_counted_over_all_labelled_pages(spark):
    """A repeated id or page neither fills the sample nor reaches the driver; custom tags are one."""
    many = [f"<body><article><p>one two {i}</p><x-{i}>three</x-{i}></article><p>tail</p></body>" for i in range(300)]
    rows = [(7, p) for p in many] + [(7, many[0])] * 500 + [(i, "<p>not labelled at all") for i in range(100)] + [(None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(6)
    got = pt.train(df, train_pages=20)
    labelled = [pt.label(p) for p in [*many, *[many[0]] * 500]]
    assert set(got) == set(pt.initial(pt.counted(labelled))) == {"body", "/body", "article", "/article", "p", "/p"}
    assert pt.counted(labelled)["p"] == (800, 800) and pt.counted(labelled)["?"] == (1600, 0)
    assert pt.train(df.limit(0)) == {}


def test_pages_table(spark):
    rows = [(i, f"u{i}", p, 1) for i, p in enumerate(pages())] + [(50, None, None, 1), (51, "u", "", 1), (None, "n", PAGE, 1), (3, "u3", pages()[3], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = pt.extract(df).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (50, 51)} == {""}
    assert [r.text for r in got if r.page_id is None] == [TRUE] and all(r.n_chars == len(r.text) for r in got)
    assert pt.extract(df.limit(0)).collect() == []


def left(page):
    return " ".join(" ".join(t.text for t in pt.tokens(page)[0] if t.key is None and not t.out).split())


def test_an_element_around_the_main_content_is_not_left_out():
    article = "<article><p>one two three four</p><div class=comments><article class=comment>no no</article></div></article>"
    for open_, close in [('<div class="page has-sidebar">', "</div>"), ('<div id="search-result">', "</div>"), ("<form action=x>", "</form>"), ("<form>", "")]:
        page = f"<html><body>{open_}<nav>menu a b c d e f g h</nav>{article}<div class=related><article>teaser</article></div>{close}</body></html>"
        assert left(page) == "one two three four", page
    # Without a content element, most of the page's words decide; a menu or a footer never comes back so.
    assert left("<body><form><p>one two three four</p><nav>a b</nav></form></body>") == "one two three four"
    assert left("<body><nav>a b c d e f</nav><p>one two</p><div class=ad>buy</div></body>") == "one two"


def test_unclosed_elements_are_left_out_too():
    assert left("<body><ul><li class=ad>buy this<li>one<li class=ad>buy that</ul><p>two") == "one two"
    assert left("<body><div><nav>menu <a>x</a></div><article>one two</article>") == "one two"
    assert left("<body><p>one two three<div><p class=notice>cookies</div><p>four") == "one two three four"
    assert left("<body><p>one two three<table><tr><td class=ad>buy<td>four<tr><td>five</table><footer>foot") == "one two three four five"
