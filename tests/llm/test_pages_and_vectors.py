"""HTML extraction and embedding near-dedup against brute force, and the cases that their docstrings define."""

import html as entities
import random
import re
import time

import numpy as np
import pytest

from barloom.llm import html, nndescent
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FLAT = {k: -0.1 for k in (*html.KINDS, html.OTHER)} | {k: -2.0 for k in ("a", "li", "ul", "div", "nav", html.OTHER)}


def test_best_run_against_all_runs():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.randrange(-3, 4) for _ in range(rng.randrange(12))]
        a, b = html.best_run(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(0, best)


def test_page_query_against_a_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op1_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)
        assert r.text == " ".join(entities.unescape(plain).split())
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PARAGRAPH = "Some words that make up a fine paragraph of text, long enough to count."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain words", "plain words"),
        (f"<div class='menu'>Home About</div><div><p>{PARAGRAPH}</p></div>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p><div id=comments><p>First! {PARAGRAPH}</p></div></article>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p><aside>By the way</aside><p>End.</p></article><footer>(c)</footer>", PARAGRAPH + " End."),
        (f"<ul><li><a>One</a></li><li><a>Two</a></li></ul><p>{PARAGRAPH}</p>", PARAGRAPH),
        ("<p>a&amp;b &lt;c&gt;\n  d<b>e</b>f<br>g</p>", "a&b <c> def g"),
        ("<script>if (a < b) { '<p>x</p>' }</script><p>kept words</p><style>p{}</style>", "kept words"),
        ("<!-- <p>no</p> --><p>yes words</p><!-- open", "yes words"),
        (f"<nav><a>never closed<article><p>{PARAGRAPH}</p></article>", PARAGRAPH),
        ("<p title='a > b'>quoted words</p>", "quoted words"),
        (f"<form>Name <input></form><p>{PARAGRAPH}", PARAGRAPH),
        (f"<body class='has-sidebar'><p>{PARAGRAPH}</p></body>", PARAGRAPH),
        (f"<p hidden>{PARAGRAPH}</p><p>seen words</p>", "seen words"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page, FLAT) == text


WORDS = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("mark", ["article", "main", ""])
@pytest.mark.parametrize(
    "wrapper",
    [
        "div class='has-sidebar'", "div class='no-sidebar'", "div class='content-with-nav'", "div class='social-science'",
        "div class='alert-free form-factor'", "div class='article-body banner-top'", "div id='page-share'", "form action='/x'", "body class='menu'",
    ],
)
def test_wrappers_named_for_the_layout(wrapper, mark):
    inner = f"<{mark}><p>{WORDS}</p></{mark}>" if mark else f"<p>{WORDS}</p>"
    assert html.main_text(f"<div class='menu'><a>Home</a></div><{wrapper}>{inner}</{wrapper.split()[0]}>", FLAT) == WORDS


def test_names_of_no_content():
    for name in ("ad", "ad-slot", "cookie-bar", "comment-list", "site-nav", "sidebar", "social-share"):
        assert html.main_text(f"<article><p>{WORDS}</p><div class='x {name}'>{WORDS} more</div></article>", FLAT) == WORDS
    teaser = f"<aside><article><p>{WORDS} teaser</p></article></aside>"
    assert html.main_text(f"{teaser}<article><p>{WORDS}</p>{teaser}</article>", FLAT) == WORDS
    comment = f"<div class='comments'><article><p>{WORDS} said</p></article></div>"
    assert html.main_text(f"<article><p>{WORDS}</p></article>{comment}", FLAT) == WORDS


def test_scan_cuts_pages_without_a_mark(spark):
    """Weights are learnt from the labelled pages of the test tables; the pages scanned have no article or main element."""
    weight = html.weights(spark.read.parquet(f"{SF}/pages.parquet"))
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12))
    for before, after in ((f"<ul>{links}</ul>", ""), ("", f"<div><ul>{links}</ul></div>"), (f"<div><ul>{links}</ul></div>", f"<ul>{links}</ul>")):
        page = f"<html><body>{before}<h1>A title of words</h1><p>{WORDS}</p><p>{PARAGRAPH}</p>{after}</body></html>"
        assert html.main_text(page, weight) == f"A title of words {WORDS} {PARAGRAPH}"
    doubtful = f"<div class='page-share'>{links}</div><p>{WORDS}</p>"
    assert html.main_text(doubtful, weight) == WORDS


def test_bad_pages_take_linear_time():
    page = "<nav>" + "<article>x" * 40_000
    start = time.perf_counter()
    html.main_text(page, FLAT)
    assert time.perf_counter() - start < 5


def test_page_table_cases(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>" + "long words " * 100_000 + "</p>", "y"), (2, "v", "<article><p>in it</p></article><ul><li>out</li></ul>", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted([(r.page_id, r.url, r.n_chars) for r in html.extract(pages).collect()], key=str)
    assert got == sorted([(1, "u", 0), (1, "u", 0), (None, None, 1_099_999), (2, "v", 5)], key=str)
    assert html.extract(pages.limit(0)).collect() == []


# --- embeddings


def plain_links(rows, threshold=0.93):
    """(n_links, component) by row, from all pairs."""
    vec = []
    for _, v, label in rows:
        x = np.array(v, float) if v is not None and label is not None and None not in v and len(v) else None
        vec.append(x / np.linalg.norm(x) if x is not None and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    near = [[j for j in range(len(rows)) if j != i and vec[i] is not None and vec[j] is not None and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= threshold] for i in range(len(rows))]
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return out


def answer(df):
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()]


def test_groups_of_all_kinds(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in range(3):
        for spread, size in ((0.02, 260), (0.035, 150), (0.05, 60)):
            centre = rng.normal(size=24)
            centre /= np.linalg.norm(centre)
            for _ in range(size):
                rows.append((len(rows), (centre + spread * rng.normal(size=24)).tolist(), label))
        rows += [(len(rows) + i, rng.normal(size=24).tolist(), label) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = plain_links(rows)
    got = {r[0]: r for r in answer(nndescent.near_duplicates(df))}
    assert len(got) == len(rows)
    assert all(got[i][1] <= want[i][0] for i in want)
    assert sum(got[i][1] for i in want) >= 0.98 * sum(n for n, _ in want.values())
    assert sum(got[i][2] == want[i][1] for i in want) >= 0.98 * len(rows)
    assert all(kept == (i == component) for i, _, component, kept in got.values())


def test_vector_cases(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (12, [1e200, 1e190], 1),
        (13, [0.0, 1.0], 1),
    ]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, row int, part string")
    got = sorted(answer(nndescent.near_duplicates(df)), key=str)
    want = [(r[0], 4 if r[0] in (1, 2, None, 12) else 0, 1 if r[0] in (1, 2, None, 12) else r[0]) for r in rows]
    assert [x[:3] for x in got] == sorted(want, key=str)
    assert {x[0] for x in got if x[3]} == {1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13}
    assert nndescent.near_duplicates(df.limit(0)).collect() == []


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_links(rows)
    got = {r[0]: r for r in answer(QUERIES["op6_embedding_near_dedup"](spark, SF))}
    assert all(got[rows[i][0]][1:3] == want[i] for i in want)
