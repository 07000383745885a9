"""Operator 4 on hand-made pages: regions that are never text, markup, forms, pages of extreme shape."""

import random
import time

import numpy as np
import pytest

from cograph.llm import extraction

LONG = "The council met on Monday, and after a long debate it agreed to repair the old bridge, which carries the road over the river."
OTHER = "Readers of this page, as always, may find that the words here are many, that they are well set, and that they go on for long."
WEIGHTS = np.array(extraction.DEFAULT_WEIGHTS)
STEEP = np.array([2.0, 2.0, -1.0, 2.0, 2.0, 0.0, 0.0, -1.0])  # every block of some words has the greatest text odds


def text(page: str, weights=WEIGHTS) -> list[str]:
    return extraction.main_blocks(page, weights)


@pytest.mark.parametrize("weights", [WEIGHTS, STEEP])
@pytest.mark.parametrize("region", [
    '<div class="comments">{}</div>', '<section class="comments">{}</section>', '<div id="disqus_thread">{}</div>', '<div class="comment-list"><article>{}</article></div>',
    '<article class="comment">{}</article>', '<div class="cookie-notice">{}</div>', '<div role="alert">{}</div>', '<div class="siteNotice">{}</div>', "<footer>{}</footer>",
    '<div class="site-footer">{}</div>', "<aside>{}</aside>", '<div class="sidebar">{}</div>', "<nav>{}</nav>", '<div class="main-menu">{}</div>', "<header>{}</header>",
    '<div class="ad">{}</div>', '<div class="advertisement"><div>{}</div></div>', '<div class="newsletter-signup">{}</div>', "<form>{}</form>", '<div class="related">{}</div>',
    "<script>{}</script>", "<style>{}</style>", "<!--{}-->", "<noscript>{}</noscript>", "<div hidden>{}</div>", '<span style="display:none">{}</span>'])
def test_regions_are_left_out_however_long_their_paragraphs(region, weights):
    region = region.format(f"<p>{OTHER}</p>" * 2)
    for page in (f"<body><article><h1>Old bridge to be mended, it is said</h1><p>{LONG}</p><p>{LONG}</p></article>{region}</body>",
                 f"<body>{region}<article><h1>Old bridge to be mended, it is said</h1><p>{LONG}</p><p>{LONG}</p></article></body>",
                 f"<body><main><p>{LONG}</p><p>{LONG}</p>{region if not region.startswith('<header') else ''}</main></body>"):
        got = text(page, weights)
        assert OTHER not in " ".join(got) and got[-2:] == [LONG, LONG]


@pytest.mark.parametrize("wrapper", [
    '<div class="page sidebar-left"><h1>Title</h1>{}</div>', '<body class="comments-open"><div class="has-sidebar">{}</div></body>', '<article class="post comments-open category-search tag-ads">{}</article>',
    '<div class="content-sidebar">{}</div>', '<aside><main>{}</main></aside>', '<div class="banner"><article>{}</article></div>', '<div class="ad-free">{}</div>', "<header><main>{}</main></header>"])
def test_names_that_tell_of_the_page_leave_the_article(wrapper):
    got = text(wrapper.format(f"<p>{LONG}</p>" * 3))
    assert [b for b in got if b != "Title"] == [LONG] * 3


def test_attributes_are_read_as_html_reads_them():
    for tag in ("<p title=it's>", "<p title=a\"b>", "<p title='a>b'>", '<p title="a>b" x>', "<p a=1/b=2>", "<p title = it's >", "<p 'x' =y>", "<p title=>", "<p/title='it'>"):
        assert text(f"<article>{tag}{LONG}</p><p>{LONG}</p></article>") == [LONG, LONG], tag
    assert text(f'<article><p>{LONG}</p></article><p title="never closed>{OTHER}') != []
    assert text(f'<article><p>{LONG}</p><a href="a>b"') == [LONG]  # the page ends inside a tag
    assert text(f"<article><!--> <p>{LONG}</p> <!-- x --!><p>{LONG}</p></article>") == [LONG, LONG]
    assert text(f"<article><p>{LONG}</p><script>'</p>' < 1</script ><p>{LONG} 1 < 2 &lt; 3</p></article>") == [LONG, LONG + " 1 < 2 < 3"]


def test_forms_that_span_the_page_are_read():
    inputs = '<input name=x><label>Your name</label><button>Send</button><textarea>words</textarea><select><option>one</select>'
    assert text(f"<body><form id=aspnetForm>{inputs}<nav><a href=/>Home</a></nav><article><p>{LONG}</p></article></form></body>") == [LONG]
    assert text(f"<body><form>{inputs}<div>" + f"<p>{LONG}</p>" * 3 + f"</div><form><p>{OTHER}</p></form></form></body>") == [LONG] * 3
    assert text(f"<article><p>{LONG}</p><p>{LONG}</p><form>{inputs}<p>{OTHER}</p></form><p>{LONG}</p></article>") == [LONG] * 3


def test_pages_of_extreme_shape_take_time_in_proportion():
    n = 100_000
    began = time.monotonic()
    deep = "<div>x " * n
    found = extraction.blocks(deep)
    assert len(found) == n and found[-1].depth == n + 1
    extraction.minimum_cut(extraction.costs(found, WEIGHTS).tolist(), extraction.ties(found))
    assert len(extraction.blocks("<div>" * n + "</section>" * n + f"<p>{LONG}</p>")) == 1
    assert len(extraction.blocks("</p><p title='" * n)) <= n
    assert text(f"<article><p>{LONG}</p>" + "<b" * n) == [LONG]
    chain = extraction.minimum_cut([(-1) ** i * 0.1 for i in range(n)], {(i, i + 1): 1.0 for i in range(n - 1)})
    assert len(set(chain)) == 1  # no capacity is worth a cut edge
    ladder = {(i, i + d): 0.5 for d in (1, 2) for i in range(n - d)}
    extraction.minimum_cut([random.Random(i).uniform(-1, 1) for i in range(n)], ladder)
    assert time.monotonic() - began < 60


def test_cut_of_page_like_networks_is_least_and_has_least_content():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 9)
        odds = [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(n)]
        edges = {(i, i + 1): rng.choice([0.5, 1.0]) for i in range(n - 1)}
        for _ in range(rng.randint(0, 4)):
            i, j = sorted((rng.randrange(n), rng.randrange(n)))
            if i < j:
                edges[i, j] = edges.get((i, j), 0.0) + 0.5

        def cost(side):
            return sum(max(0, o) if not s else max(0, -o) for o, s in zip(odds, side)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])  # noqa: B023

        sides = [[bool(m >> i & 1) for i in range(n)] for m in range(2**n)]
        best = min(map(cost, sides))
        least = min((s for s in sides if cost(s) < best + 1e-9), key=sum)
        assert extraction.minimum_cut(odds, edges) == least


def test_rows_of_one_id_count_once_in_the_sample(spark):
    page = f"<nav><p>{OTHER}</p></nav><article><p>{LONG}</p><h2>So</h2></article>"
    one = spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string")
    many = spark.createDataFrame([(1, page)] * 500 + [(2, page), (2, None), (3, None)], "page_id long, html string")
    assert extraction.train(one).tolist() == extraction.train(many).tolist()
