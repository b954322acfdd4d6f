import html
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from lumenspan.llm import labelled_pages, maintext


def test_signs_of_weights():
    w = maintext.model().weights
    assert w[maintext.WORD] == 1 > w[maintext.LINKED]
    assert all(v <= 0 for k, v in w.items() if k[0] == "<") and w["<>"] < 0
    assert w[maintext.BESIDE] < 0 and w[maintext.LEFT_OUT] < 0


def inside(page):
    page, spans = maintext.marked(page)
    return html.unescape(re.sub("<[^>]*>", " ", " ".join(page[a:b] for a, b in spans))).split()


@pytest.mark.parametrize("k", range(len(labelled_pages.PAGES)))
def test_labelled_page_left_out(k):
    pages = [p for i, p in enumerate(labelled_pages.PAGES) if i != k]
    page = labelled_pages.PAGES[k]
    want = inside(page)
    got = maintext.main_text(maintext.marked(page)[0], maintext.learn([*pages, *labelled_pages.made(700)])).split()
    both = len(set(want) & set(got))
    assert both / len(set(want)) > 0.9 and both / len(set(got)) > 0.9


def test_held_out_made_pages():
    pages = list(labelled_pages.made(300, seed=99))
    right = sum(maintext.main_text(maintext.marked(p)[0]).split() == inside(p) for p in pages)
    assert right >= 0.97 * len(pages)


@given(st.lists(st.integers(-4, 4), max_size=20))
@settings(max_examples=300, deadline=None)
def test_best_stretch_equals_brute_force(scores):
    begin, end = maintext.best_stretch(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
    assert sum(scores[begin:end]) == max(best, 0) and (begin == end) == (best <= 0)


@given(st.lists(st.sampled_from(["a b c", "<p>", "</p>", "<nav>", "</nav>", "<a href=x>", "</a>", " one", "<li>", "<b>", "<br>", "<div class=ad>", "</div>", "<article>"]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_text_is_that_of_a_best_stretch(parts):
    page = "".join(parts)
    by = maintext.model()
    seen = list(maintext.Page(page, by.names).events())
    scores = [by.weight(kind) * n for _, kind, n, _, _ in seen]
    sums = {(i, j): sum(scores[i:j]) for i in range(len(seen)) for j in range(i, len(seen) + 1)}
    best = max(sums.values(), default=0.0)

    def text(i, j):
        runs = "".join("\n" if fresh else re.sub(r"\s", " ", said) for _, _, _, said, fresh in seen[i:j])
        return "\n".join(x for x in (" ".join(r.split()) for r in runs.split("\n")) if x)

    want = {text(i, j) for (i, j), total in sums.items() if total > best - 1e-9} if best > 1e-9 else {""}
    assert maintext.main_text(page) in want


BODY = " ".join(f"body{k}" for k in range(90))


def test_implied_end_tags():
    f = maintext.main_text
    assert f(f'<article><p class="notice">we moved<p>{BODY}</article>') == BODY
    assert f(f"<p class=ad>buy<div>{BODY}</div>") == BODY
    assert f(f"<article><ul><li class=ad>buy now<li>{BODY}</ul></article>") == BODY
    assert f(f"<table><tr><td class=sidebar>x y z<td><p>{BODY}</table>") == BODY
    assert f(f"<article><p>{BODY}</b></span></div></section></p></article>") == BODY
    assert f(f"<article><dl><dt>term<dd>said <a href=x>one<a href=y>two</dl><p>{BODY}</article>") == f"term\nsaid onetwo\n{BODY}"
    assert f(f"<form><div id=page><main><p>{BODY}</main></div></form>") == BODY


@pytest.mark.parametrize("name", ["search-for-life", "legal-analysis", "related-work", "popular-songs"])
def test_names_of_topics_stay(name):
    page = f'<article><p>{BODY}</p><div class="{name}"><p>part of it</p></div><p id="{name}">more of it</p></article>'
    assert maintext.main_text(page) == f"{BODY}\npart of it\nmore of it"


@pytest.mark.parametrize("part", ["<div>", "<div class=ad>", "<p><b>", "<a href=x>", "<nav><article>", "<ul><li>", "<table><tr><td>", "<i></b>", "</div>", "<span></p>", '<a "', "<!--"])
def test_time_grows_with_the_page(part):
    page = part * (100_000 // len(re.findall("<", part))) + f"<article>{BODY}</article>" + "</div></i>" * 50_000
    began = time.perf_counter()
    maintext.main_text(page)
    assert time.perf_counter() - began < 10


def test_cases():
    body = "<p>" + "long words of the story " * 5 + "</p>"
    story = " ".join(("long words of the story " * 5).split())
    f = maintext.main_text
    assert f(None) == f("") == f("<nav>a b c</nav>") == ""
    assert f(f"<nav>x y<article>{body}</article>") == story
    assert f(f'<div class="ad-box ad">buy</div>{body}<div id="comments"><article><p>me first</p></article></div>') == story
    assert f(f"<script>var a='<p>no</p>'</script>{body}<style>p{{}}</style><!-- <p>hidden</p> -->") == story
    assert f(f"<p>A &amp; B&nbsp;&lt;c&gt;   d</p>{body}") == f"A & B <c> d\n{story}"
    assert f(f"<h1>T</h1><p><b>u v<br>w{body}") == f"T\nu v w\n{story}"
    assert f(f"{body}<form>name <input></form>{body}<aside>see also</aside>") == f"{story}\n{story}"
    assert f(f"<header><h1>Site</h1></header><article><header><h1>Title here</h1></header>{body}</article>") == f"Title here\n{story}"
    assert f(f"{body}<p title='a>b'>x &#233;</p>") == f"{story}\nx é"
    assert f("only plain text") == "only plain text"


@pytest.mark.parametrize("n", [12, 70, 5000])
@pytest.mark.parametrize("box", ['<div class="share">{}</div>', "<aside>{}</aside>", "<form>{}</form>", '<div id="related"><ul>{}</ul></div>'])
def test_long_excluded_blocks_in_the_article(box, n):
    words = box.format(" ".join(f"<li>{k} more</li>" if "<ul>" in box else f"more{k}" for k in range(n)))
    lead, body = " ".join(f"lead{k}" for k in range(40)), " ".join(f"body{k}" for k in range(90))
    head = "six words stand in this headline"
    for name in ("article", "main"):
        page = f"<nav>{'menu ' * 30}</nav><{name}><h1>{head}</h1>{words}<p>{lead}</p>{words}<p>{body}</p></{name}><footer>{'end ' * 30}</footer>"
        assert maintext.main_text(page) == f"{head}\n{lead}\n{body}"


@pytest.mark.parametrize(
    "wrapper",
    ['class="content has-sidebar"', 'id="page" class="layout no-sidebar"', 'class="post category-legal"', "class='tags-travel'", 'class="content sidebar"', "id=search"],
)
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_hints_on_what_holds_the_main_text(wrapper, inner):
    body = " ".join(f"body{k}" for k in range(90))
    text = f"<nav>menu</nav><{inner}><h1>A headline of words</h1><p>{body}</p></{inner}>"
    boxes = f'<div class="cookie-banner">we use cookies</div><div id="comments"><article><p>{"me first " * 200}</p></article></div>'
    want = f"A headline of words\n{body}"
    assert maintext.main_text(f"<body><div {wrapper}>{text}{boxes}</div></body>") == want
    assert maintext.main_text(f"<body><div {wrapper}>{text}</div>{boxes}</body>") == want


def test_class_names_match_as_a_whole():
    body = " ".join(f"body{k}" for k in range(90))
    for name in ("has-sidebar", "category-legal", "tags-travel", "no-comments"):
        assert maintext.main_text(f'<p>{body}</p><div class="{name}"><p>a part of the story</p></div><p>{body}</p>') == f"{body}\na part of the story\n{body}"
    for name in ("sidebar", "ad-box", "site-footer", "ad_300", "x related-posts"):
        assert maintext.main_text(f'<p>{body}</p><div class="{name}"><p>not a part</p></div><p>{body}</p>') == f"{body}\n{body}"


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in maintext.extract(pages).collect()}
    assert got == want


def test_rows(spark):
    rows = [(1, "u", None, 7), (1, "u", None, 7), (None, None, "<p>a b c d</p>", 7), (2, "v", "<p>" + "w é" * 200_000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = maintext.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 7), (1, 0), (1, 0), (2, 600_000)]
    assert maintext.extract(pages.limit(0)).collect() == []
