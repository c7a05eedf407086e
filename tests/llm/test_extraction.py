"""The block labeller on the given pages, on held-out composed pages and on broken markup; gradients against differences."""

import html
import re

import numpy as np
import pytest

from latticeqc.llm import html_labeller as hl
from latticeqc.llm.html_blocks import blocks
from latticeqc.llm.queries import QUERIES


def expected(page):
    """The article's text by plain string work on the generator's pages."""
    inner = (page or "").partition("<article>")[2].partition("</article>")[0]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_query_on_pages(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op3_html_block_labeller"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id][0], expected(pages[r.page_id][1])) and r.n_chars == len(r.text)


def test_blocks_of_broken_markup():
    page = """<body><nav><li>one<li>two</nav><!-- <p>no</p> --><p class="x Lead">a &amp; b<br>c <b>d<p>e</b> f<script>var t="</p>";</script> g
    <div id='side-bar'>h <a href="?a>b">link</a></div><style>p{}</style><p title="broken>i<td>j</textarea><textarea>k"""
    found = [(b.text, b.path[1:]) for b in blocks(page)]
    assert found[:4] == [("one", ("nav", "li")), ("two", ("nav", "li")), ("a & b c d", ("p", "c:x", "c:lead")), ("e f g", ("p",))]
    assert found[4] == ("h link", ("div", "i:side", "i:bar")) and blocks(page)[4].linked == 4
    assert blocks("") == [] and blocks("<") == [hl.Block("<", (), 0)] and blocks("a < b")[0].text == "a < b"


def test_nothing_but_raw_elements_is_dropped():
    page = """<article><p>One <svg class="i"/> two <svg><path d="m"/><title>t</title></svg>end</p><p>three four</p>
    <p>sum <math><mfrac><mi>a</mi><mn>2</mn></mfrac><mo>=</mo><mi>b</mi></math> here <math/>is</p>
    <noscript>no script</noscript><div><object data="x">instead</object></div><figure><img><figcaption>the caption</figcaption></figure></article>"""
    texts = ["One two end", "three four", "sum a2=b here is", "no script", "instead", "the caption"]
    assert [b.text for b in blocks(page)] == texts and all(hl.said_label(b.path) for b in blocks(page))


def test_deep_nesting_keeps_short_paths():
    depth = 20_000
    found = blocks("<article>" + "<div>a" * depth + "</div>" * depth + "</article><div><div><div><nav>b")
    assert len(found) == depth + 1 and max(len(b.path) for b in found) <= 4
    assert [hl.said_label(b.path) for b in (found[0], found[-2], found[-1])] == [1, 1, 0]


def test_sample_is_bounded_by_bytes(spark):
    pages = spark.createDataFrame([(k, f"<article><p>{'word ' * 100}{k}</p></article>") for k in range(6)] * 2, "page_id long, html string")
    small = hl.Labeller(composed=2, epochs=1, characters=1)
    assert hl.train(pages, small) is not None


def test_kept_by_the_trained_net(spark):
    net = hl.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    lead, more = "The river rose over the old bridge in the night, and nobody in the town slept.", "In the morning the water had gone down again, and people came out to look at the damage."
    page = f"""<body><nav><ul><li><a href="/">home</a></li></ul></nav><article><header><h1>The river</h1></header><p>{lead}</p><p>{more}</p><p>{more}</p><p>It rose by
    <math><mi>h</mi><mo>=</mo><mn>3</mn></math> m <svg/> that night, as the gauge below the bridge shows.</p><figure><img><figcaption>The old bridge after the flood, seen from the south.</figcaption></figure></article><footer>legal notes</footer></body>"""
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    kept = ["The river", lead, more, more, "It rose by h=3 m that night, as the gauge below the bridge shows.", "The old bridge after the flood, seen from the south."]
    assert hl.extract(rows, net).first().text.split("\n\n") == kept


def test_corner_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (3, "u", "plain words only"), (4, "u", "<article><p>" + "word " * 50_000 + "</article>"), (5, "u", "<nav>x</nav>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    assert hl.extract(pages, None).where("n_chars > 0").count() == 0
    assert hl.extract(pages.where("false"), hl.train(pages.where("false"))).count() == 0
    net = hl.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in hl.extract(pages, net).collect())
    assert len(got) == 6 and [g[1] for g in got[:2]] == ["", ""] and got[4][2] == 50_000 * 5 - 1 and got[5][1] == ""


def test_held_out_layouts(spark):
    pages = [blocks(r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    paragraphs = [b.text for p in pages for b in p if hl.said_label(b.path)]
    small = hl.Labeller(composed=400)
    rng = np.random.default_rng(0)
    made = [hl.compose(paragraphs, rng) for _ in range(400)]
    net = hl.fit(pages[:200] + [m[0] for m in made], [[hl.said_label(b.path) for b in p] for p in pages[:200]] + [m[1] for m in made], small)
    fresh = [m for m in (hl.compose(paragraphs, np.random.default_rng(10_000 + k)) for k in range(200)) if m[0]]
    guess = hl.label_pages(net, [m[0] for m in fresh], hl.Features())
    wrong = sum(((p >= 0.5) != np.array(m[1])).sum() for p, m in zip(guess, fresh))
    assert wrong <= 0.01 * sum(len(m[1]) for m in fresh)
    # Without any class or id, the neighbours and the wording still tell most blocks.
    bare = [[b._replace(path=tuple(s for s in b.path if ":" not in s)) for b in m[0]] for m in fresh]
    guess = hl.label_pages(net, bare, hl.Features())
    right = sum(((p >= 0.5) == np.array(m[1])).sum() for p, m in zip(guess, fresh))
    assert right >= 0.7 * sum(len(m[1]) for m in fresh)


@pytest.mark.parametrize("name", ["xf", "xb", "hf", "hb", "cf", "o", "e"])
def test_gradients(name):
    rng = np.random.default_rng(3)
    net = hl.BiLstm.fresh(5, 3, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = rng.standard_normal((2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = rng.integers(0, 2, (2, 4)) * mask

    def loss():
        p = net.forward(x, mask)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = net.gradients(x, mask, y)[name]
    flat = net.w[name].reshape(-1)
    for at in range(0, flat.size, max(1, flat.size // 5)):
        kept = flat[at]
        flat[at] = kept + 1e-4
        up = loss()
        flat[at] = kept - 1e-4
        assert g.reshape(-1)[at] == pytest.approx((up - loss()) / 2e-4, abs=2e-3)
        flat[at] = kept
