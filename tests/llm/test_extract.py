import html
import re

import numpy as np
import pytest

from inkmill.llm.extract import DIM, Labeller, blocks, main_texts, padded, sample_pages, texts_of, trained

SF = "/root/testdata/sf0.01"


def article_text(page):
    """The article's paragraphs, for pages whose markup is as regular as the provided ones."""
    inside = page[page.find("<article>") + 9 : page.find("</article>")]
    parts = (re.sub(r"<[^>]*>", "", part) for part in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
    return "\n\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


@pytest.fixture(scope="module")
def labeller(spark):
    return trained(sample_pages(spark.read.parquet(f"{SF}/pages.parquet"), most=80))


def test_held_out_pages(spark, labeller):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(300).collect()]
    got = texts_of(pages, labeller)
    assert sum(g == article_text(p) for g, p in zip(got, pages)) >= 0.99 * len(pages)


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class=x><script>var a='</p><p>no';</script>"
        "<nav><ul><li><a href='/a>b'>one</a><li>two</ul></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1><p>x<b>y</b> \n z<br>w"
        "<p>next &lt;p&gt; &#233;&nbsp;!</article></span><div>tail<div>in</div>out"
    )
    got = [(path[-1], text) for path, text, _ in blocks(page)]
    assert got == [
        ("li", "one"), ("li", "two"), ("h1", "A & B"), ("p", "xy z w"), ("p", "next <p> é !"), ("div", "tail"), ("div", "in"), ("div", "out"),
    ]
    assert blocks("") == [] and blocks("<p>  </p>") == []
    assert blocks("a < b &am") == [((), "a < b &am", 0)]


def test_other_names_and_strange_blocks(labeller):
    body = [f"This paragraph number {i} goes on with a number of words, as prose in an article does." for i in range(6)]
    page = (
        "<html><body><div class='cookie notice'><p>We use cookies</p></div><div class=menu><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>"
        "<div class='content'><h1>A title</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</div>"
        "<div class=comments><p>First! Nice one.</p><p>Thanks.</p></div><footer>copyright</footer></body></html>"
    )
    assert texts_of([page], labeller) == ["\n\n".join(["A title", *body])]


def test_gradients():
    rng = np.random.default_rng(0)
    net = Labeller(1)
    x, mask, y = padded([(rng.normal(size=(n, DIM)), rng.integers(0, 2, n).astype(float)) for n in (3, 5, 1)])
    _, g = net.gradients(x, mask, y)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            old, step = flat[k], 1e-5
            flat[k] = old + step
            up = net.gradients(x, mask, y)[0]
            flat[k] = old - step
            down = net.gradients(x, mask, y)[0]
            flat[k] = old
            assert abs((up - down) / (2 * step) - g[name].reshape(-1)[k]) < 1e-6


def test_edges(spark, labeller):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (None, "v", "<p>" + "long " * 50_000, "t"), (3, "w", "<nav>x</nav>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_texts(pages, labeller).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(a), str(b)) for a, b, _, _ in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", "", ""]
    # Without pages to learn from nothing crashes.
    assert main_texts(pages.limit(0)).count() == 0
    assert main_texts(pages).count() == len(rows)


def test_closed_elements_do_not_swallow_the_rest():
    """Elements closed in their own tag hold nothing; formulas and objects are parsed through."""
    from inkmill.llm.extract import blocks

    page = '<article><p>a one</p><svg class="i"/><p>b two</p><select/><p>c <math><mi>x</mi></math></p><object>d</object><script src="s"/>e</script></article>'
    assert " ".join(b[1] for b in blocks(page)) == "a one b two c x d"
