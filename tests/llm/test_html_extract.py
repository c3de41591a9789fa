from collections import Counter

import pytest

pytest.importorskip("duelspark.llm.html_extract")
from duelspark.llm import html_extract as h  # noqa: E402


@pytest.fixture(scope="module")
def model(spark):
    return h.train(h.labelled_pages(spark))


def brute_marginals(page, model):
    """All labellings of a small page."""
    import itertools
    import math

    n = len(page.tag)
    total, hits = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        p = (0.99, 0.01)[labels[0]]
        for i, label in enumerate(labels):
            if label:
                p *= math.exp(max(-30, min(30, sum(model["seen"].get(f, 0.0) for f in page.features(i)))))
            if i:
                p *= model["pair"].get(h.kind(page.tag[i]), model["unseen_pair"])[labels[page.parent[i]]][label]
        total += p
        for i, label in enumerate(labels):
            hits[i] += p * label
    return [x / total for x in hits]


def test_marginals_equal_enumeration(model):
    for source in ("<body><nav>a</nav><article><h1>t</h1><p>x y z</p></article>", "<div class=ad>few<div><p>a<p>b</div></div><footer>c</footer>"):
        page = h.Page(source)
        assert h.marginals(page, model) == pytest.approx(brute_marginals(page, model), abs=1e-9)


def test_article_only(model):
    source = "<!DOCTYPE html><html lang=en><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav><!-- ad 0 --><div class=\"ad\">Some advert text here.</div><article><h1>Tom &amp; Co</h1><p><b>One  two\nthree.<br><p>Four &lt;five&gt;</p></article><footer>&copy; x</footer></body></html>"
    assert h.main_text(source, model) == "Tom & Co\n\nOne two three.\n\nFour <five>"


def words_of(page, keep):
    """The words of a labelled page's main text, or of what a model keeps."""
    import re

    return Counter(w for (block, parts) in page.texts if keep[block] for w in re.findall(r"\w+", "".join(parts)))


def test_held_out_pages(spark):
    """Each labelled page is read by a model of the others: F1 of words over all pages."""
    same = kept = true = 0
    for i, source in enumerate(h.LABELLED):
        others = [(k, x) for k, x in enumerate(h.LABELLED) if k != i]
        model = h.train(spark.createDataFrame(others, "page_id long, html string").coalesce(1))
        page = h.Page(source)
        got = words_of(page, [p >= 0.5 for p in h.marginals(page, model)])
        want = words_of(page, page.labels())
        same, kept, true = same + sum((got & want).values()), kept + sum(got.values()), true + sum(want.values())
    assert 2 * same / (kept + true) >= 0.9


def test_text_by_blocks(model, spark):
    """Ids, urls and whole texts of pages against their blocks as written down here; repeated rows and other columns."""
    blocks = ["A & B", "One two", "x = y + 2 holds here", "Script is off", "Last"]
    source = "<body><nav><a href=/>m</a></nav><article><h1>A &amp; B</h1><p>One\n <b>two</b></p><p>x = <math><mi>y</mi> <mo>+</mo> <mn>2</mn></math> holds here</p><p><noscript>Script is off</noscript></p><p>Last</p></article><footer>&copy; f</footer></body>"
    pages = spark.createDataFrame([(1, "u1", source, "a", 5), (1, "u1", source, "a", 5), (2, None, "<nav>only</nav>", "b", 6)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in h.extract(pages, model).collect() if r.page_id == 1)
    want = "\n\n".join(blocks)
    assert got == [(1, "u1", want, len(want))] * 2


def test_deep_markup_takes_linear_time():
    import time

    began = time.time()
    h.Page("<div><p></b></i></li>" * 30000)
    assert time.time() - began < 20


def test_cut_and_odd_pages(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "no tags at all"), (4, "u", "<article><p>cut off &am"), (5, "u", "<article><p title=\"open quote>text here</p></article>"), (6, "u", "<article><p>" + "long " * 50000)]
    out = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert out[1].text == "" and out[1].url is None and out[2].n_chars == 0
    assert out[4].text == "cut off &am"
    assert out[6].n_chars == 50000 * 5 - 1
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
