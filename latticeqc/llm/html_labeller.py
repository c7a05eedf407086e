"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. A bidirectional LSTM in numpy reads, for each block, a hashed vector of its
tag path (tags, class and id words), a hashed vector of its words and a few measures, and labels every
block as article or not, knowing the whole page in both directions.

It is trained on the driver on a bounded sample: ``sample`` real pages (smallest hashes, as many of them as have
``characters`` code points in all, and at least one), labelled by what their tags say of themselves (article and main, or navigation, footers, adverts, forms, comments), and ``composed``
pages put together from the sample's paragraphs under many other layouts, so that the labels are
learned from context and wording where a page names nothing. Then every page is labelled, whole.

A null or empty page has an empty text. Repeated rows give repeated results; other columns are ignored;
with no page to learn from (an empty table) the result is empty too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeqc.llm.common import inputs
from latticeqc.llm.html_blocks import Block, blocks

PATH, WORDS, MEASURES = 384, 48, 8
#: Names by which pages say what a part is.
ARTICLE_TAGS = {"article", "main"}
ARTICLE_NAMES = set("article content entry post story main body text".split())
OTHER_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset"}
OTHER_NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies disclaimer disqus footer gdpr header hero legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split()
)


@dataclass(frozen=True)
class Labeller:
    """``sample`` and ``characters`` bound the real pages, ``composed`` the made ones; blocks from ``threshold`` on are article."""

    sample: int = 300
    characters: int = 16_000_000
    composed: int = 600
    hidden: int = 24
    epochs: int = 9
    rate: float = 0.01
    threshold: float = 0.5
    seed: int = 7


def said_label(path: tuple[str, ...]) -> int:
    """What the tags of a block say: inside an article, and inside nothing else below it."""
    label = 0
    for step in path:
        name = step[2:] if step[1:2] == ":" else ""
        if step in ARTICLE_TAGS or name in ARTICLE_NAMES:
            label = 1
        elif step in OTHER_TAGS or name in OTHER_NAMES or step == "header" and not label:
            return 0
    return label


class Features:
    """Vectors of blocks; the paths seen are kept up to a bound."""

    #: Weights of the places in a word; a word's hash is the weighted sum of its bytes.
    WEIGHTS = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
    MARKS = np.isin(np.arange(256), list(b".,;:!?"))

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.paths: dict[tuple, list[int]] = {}

    def _path(self, path: tuple[str, ...]) -> list[int]:
        if len(self.paths) > self.limit:
            self.paths.clear()
        steps = [f"p{s}" for s in path] + [f"q{s}" for s in path[-2:]]
        places = self.paths[path] = sorted({zlib.crc32(s.encode()) % PATH for s in steps})
        return places

    def pages(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """One matrix per page. All words of all blocks are hashed in a few array steps."""
        found = [b for page in pages for b in page]
        out = np.zeros((len(found), PATH + WORDS + MEASURES), np.float32)
        if not found:
            return [out for _ in pages]
        known = self.paths.get
        for row, block in enumerate(found):
            out[row, known(block.path) or self._path(block.path)] = 1
        text = np.frombuffer("\n".join(b.text for b in found).encode("utf-8", "replace"), np.uint8)  # texts have single spaces only
        breaks = np.flatnonzero((text == 32) | (text == 10))
        starts = np.concatenate([[0], breaks + 1])
        lengths = np.diff(np.concatenate([starts, [len(text) + 1]])) - 1
        place = np.arange(len(text)) - np.repeat(starts, lengths + 1)[: len(text)]
        value = np.where((text == 32) | (text == 10), 0, text).astype(np.uint64)
        hashes = np.add.reduceat(value * self.WEIGHTS[place % 64], starts)
        block_of = np.cumsum(np.concatenate([[0], text[breaks] == 10]))
        slot = ((hashes ^ (hashes >> np.uint64(33))) % np.uint64(WORDS)).astype(np.int64)
        count = np.bincount(block_of * WORDS + slot, minlength=len(found) * WORDS).reshape(len(found), WORDS)
        out[:, PATH : PATH + WORDS] = count / np.sqrt((count * count).sum(axis=1, keepdims=True) + 1e-9)
        words = np.bincount(block_of, minlength=len(found))
        line = np.cumsum(np.concatenate([[0], text == 10]))[:-1]
        marks = np.bincount(line[self.MARKS[text]], minlength=len(found))
        size = np.array([len(b.text) for b in found])
        sizes = np.array([len(p) for p in pages if p])
        row = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        full = np.repeat(sizes, sizes)
        out[:, -MEASURES:] = np.stack([
            np.log1p(size) / 8, np.log1p(words) / 6, np.array([b.linked for b in found]) / size, 10 * marks / size,
            np.array([b.text[-1] in ".!?" for b in found]), row / full, 1 / (row + 1), 1 / (full - row),
        ], axis=1)
        return np.split(out, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLstm:
    """Forward and backward LSTM over padded batches, and a logistic output for each step."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden = weights["hf"].shape[0]

    @classmethod
    def fresh(cls, size: int, hidden: int, rng) -> BiLstm:
        def normal(rows, cols):
            return (rng.standard_normal((rows, cols)) / np.sqrt(rows)).astype(np.float32)

        w = {"xf": normal(size, 4 * hidden), "xb": normal(size, 4 * hidden), "hf": normal(hidden, 4 * hidden), "hb": normal(hidden, 4 * hidden)}
        for d in "fb":
            w["c" + d] = np.zeros(4 * hidden, np.float32)
            w["c" + d][hidden : 2 * hidden] = 1  # remember at first
        w["o"], w["e"] = normal(2 * hidden, 1), np.zeros(1, np.float32)
        return cls(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps, n = x.shape[1], self.hidden
        z = x @ self.w["x" + d] + self.w["c" + d]
        h = c = np.zeros((len(x), n), np.float32)
        out, kept = np.zeros((len(x), steps, n), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.w["h" + d]
            i, f, o = (_sigmoid(a[:, k * n : (k + 1) * n]) for k in range(3))
            g, m = np.tanh(a[:, 3 * n :]), mask[:, t, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            kept[t] = (h, c, i, f, o, g, tanh, m)
            h, c = m * o * tanh + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        forth, kept_f = self._run(x, mask, "f")
        back, kept_b = self._run(x, mask, "b")
        both = np.concatenate([forth, back], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["e"])[..., 0], both, {"f": kept_f, "b": kept_b}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, kept = self.forward(x, mask)
        error = (p - y) * mask / mask.sum()
        grads = {"o": both.reshape(-1, both.shape[2]).T @ error.reshape(-1, 1), "e": error.sum(keepdims=True).reshape(1)}
        flow = error[..., None] * self.w["o"][:, 0]
        n, steps = self.hidden, x.shape[1]
        for d, part in (("f", flow[..., :n]), ("b", flow[..., n:])):
            dz = np.zeros((len(x), steps, 4 * n), np.float32)
            dh = dc = np.zeros((len(x), n), np.float32)
            grads["h" + d] = np.zeros_like(self.w["h" + d])
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, c, i, f, o, g, tanh, m = kept[d][t]
                dh = dh + part[:, t]
                inner = m * dh * o * (1 - tanh**2) + m * dc
                a = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), m * dh * tanh * o * (1 - o), inner * i * (1 - g**2)], axis=1)
                dz[:, t] = a
                grads["h" + d] += h.T @ a
                dh, dc = a @ self.w["h" + d].T + (1 - m) * dh, inner * f + (1 - m) * dc
            flat = dz.reshape(-1, 4 * n)
            grads["x" + d], grads["c" + d] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), longest), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


def fit(pages: list[list[Block]], labels: list[list[int]], labeller: Labeller) -> BiLstm:
    """Adam on batches of pages of similar length."""
    rng = np.random.default_rng(labeller.seed)
    vectors = Features().pages(pages)
    net = BiLstm.fresh(PATH + WORDS + MEASURES, labeller.hidden, rng)
    first, second, step = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    order = np.argsort([len(v) for v in vectors], kind="stable")
    groups = [order[at : at + 16] for at in range(0, len(order), 16)]
    for epoch in range(labeller.epochs):
        rate = labeller.rate * (1 - epoch / labeller.epochs)
        for k in rng.permutation(len(groups)):
            x, mask = padded([vectors[j] for j in groups[k]])
            keep = rng.random(x.shape[2]) > 0.03  # path names are missing on some pages
            y = np.zeros(mask.shape, np.float32)
            for row, j in enumerate(groups[k]):
                y[row, : len(labels[j])] = labels[j]
            step += 1
            for name, g in net.gradients(x * keep, mask, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                net.w[name] = (net.w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


#: Layouts of composed pages, as container (tag and attributes) of a part.
ARTICLES = ["<article>", "<main>", '<div class="content">', '<div id="main">', '<section class="post">', '<div class="entry-content">', '<div class="article-body">', '<div class="story">', "<main><article>", '<div id="content"><div class="text">', '<article class="post">', '<div class="page"><article>', '<td class="body">']
MENUS = ["<nav><ul>", '<div class="menu"><ul>', '<ul id="nav">', '<header><ul class="navbar">', '<div class="breadcrumbs"><ul>', '<div role="navigation"><ul>', '<div class="topbar"><ul>']
NOTES = ["<footer>", '<div class="footer">', '<div id="footer"><p>', '<div class="cookie-notice"><p>', '<div class="notice">', '<div id="consent"><p>', '<div class="legal">', '<div class="banner">', "<header>", '<header class="masthead"><p>', '<div id="header"><h2>', '<div class="disclaimer"><p>']
ADVERTS = ['<div class="ad">', '<div class="ads"><p>', '<div class="advert">', '<div class="sponsored"><p>', '<section class="promo"><p>', '<div id="ad-banner">', '<aside class="ad">', '<div class="advertisement"><p>', '<div class="newsletter"><p>']
SIDES = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<aside class="widget">', '<section class="recommended">', '<div class="widget">', '<div class="social share">', '<div class="teaser">']
FORMS = ["<form>", '<form class="search">', '<div class="login"><form>', '<form id="subscribe">', '<div class="signup"><form>', '<form action="/search">']
COMMENTS = ['<div class="comments">', '<section id="comments">', '<div class="comment">', '<ol class="commentlist">', '<div id="respond">', '<div class="replies">', '<section class="comments"><h2>Comments</h2>', '<div class="user-comments">', '<div id="disqus">', "<aside class=\"comments\">"]


#: Marks the article's texts while a page is composed.
ARTICLE_MARK = "\x01"


def compose(paragraphs: list[str], rng) -> tuple[list[Block], list[int]]:
    """A page in a random layout from real paragraphs, and its labels."""
    made: list[str] = []

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def mine(text: str) -> str:
        return ARTICLE_MARK + text

    def closed(start: str) -> str:
        names = [t.split()[0].strip("<>") for t in start.replace("</h2>", "").split("<") if t]
        return "".join(f"</{n.split('>')[0]}>" for n in reversed(names) if n.split(">")[0] != "h2" or "Comments" not in start)

    def short(low: int, high: int) -> str:
        words = pick(paragraphs).split()
        at = int(rng.integers(max(len(words) - 1, 1)))
        return " ".join(words[at : at + int(rng.integers(low, high))]) or "more"

    def some() -> str:
        if rng.random() < 0.02:  # a very long block
            return " ".join(pick(paragraphs) for _ in range(int(rng.integers(5, 60))))
        return pick(paragraphs) if rng.random() < 0.6 else short(5, 40)

    def other() -> str:
        kind = int(rng.integers(7))
        if kind == 0:
            start = pick(MENUS)
            return start + "".join(f'<li><a href="/{k}">{short(1, 4)}</a></li>' for k in range(int(rng.integers(2, 9)))) + closed(start)
        if kind == 1:
            start = pick(NOTES)
            return start + pick(["&copy; ", "Copyright ", "We use cookies ", "", ""]) + short(2, 25) + closed(start)
        if kind == 2:
            start = pick(ADVERTS)
            return start + (short(3, 30) if rng.random() < 0.7 else some()) + closed(start)
        if kind == 3:
            start = pick(SIDES)
            inner = "".join(pick(["<p>{}</p>", "<h3>{}</h3>", '<a href="/x">{}</a>', "<div>{}</div>"]).format(some() if rng.random() < 0.4 else short(2, 20)) for _ in range(int(rng.integers(1, 5))))
            return start + inner + closed(start)
        if kind == 4:
            start = pick(FORMS)
            return start + f"<label>{short(1, 4)}</label><input><p>{short(2, 12)}</p><button>{short(1, 3)}</button>" + closed(start)
        start = pick(COMMENTS)
        inner = "".join(pick(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', '<li class="comment"><p>{}</p></li>', "<div>{}</div>"]).format(some()) for _ in range(int(rng.integers(1, 6))))
        return start + inner + closed(start)

    def others(most: int) -> None:
        for _ in range(int(rng.integers(0, most))):
            made.append(other())

    others(5)
    start = pick(ARTICLES)
    made.append(start)
    if rng.random() < 0.7:
        made.append(pick(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(mine(short(2, 12))))
    for _ in range(int(rng.integers(1, 14))):
        form = int(rng.integers(9))
        body = mine(some())
        laid = ["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<h2>{}</h2>", '<figure><img src="a.png"><figcaption>{}</figcaption></figure>'][form]
        made.append(laid.format(body) * (2 if rng.random() < 0.04 else 1))  # a text may come twice
        if rng.random() < 0.12:
            made.append(other())
    if rng.random() < 0.3:
        made.append(other())
    made.append(closed(start))
    others(5)
    found = blocks("<html><body>" + "".join(made) + ("</body></html>" if rng.random() < 0.8 else ""))
    labels = [int(ARTICLE_MARK in b.text) for b in found]
    return [b._replace(text=b.text.replace(ARTICLE_MARK, "")) for b in found], labels


def train(pages: DataFrame, labeller: Labeller = Labeller(), id_col: str = "page_id", html_col: str = "html") -> BiLstm | None:
    """The labeller fitted on at most ``sample`` pages and ``composed`` made ones; None without a page."""
    rows = inputs(pages, page=id_col, html=html_col).where("html is not null and html <> ''")
    # First only hashes and lengths: the pages themselves come to the driver once, not from every task.
    hashed = rows.withColumn("place", F.xxhash64("page", "html"))
    listed = hashed.select("place", F.length("html").alias("size")).orderBy("place", "size").limit(labeller.sample).collect()
    total = accumulate(r.size for r in listed)
    fitting = [r.place for k, (r, t) in enumerate(zip(listed, total)) if not k or t <= labeller.characters]
    # Rows of one hash are one page, so that one of them is enough.
    picked = hashed.where(F.col("place") <= fitting[-1]).groupBy("place").agg(F.any_value("html").alias("html")).collect() if fitting else []
    picked.sort(key=lambda r: r.place)
    real = [found for found in (blocks(r.html) for r in picked) if found]
    paragraphs = [b.text for page in real for b in page if said_label(b.path)] or [b.text for page in real for b in page]
    if not paragraphs:
        return None
    rng = np.random.default_rng(labeller.seed)
    made = [compose(paragraphs, rng) for _ in range(labeller.composed)]
    made = [m for m in made if m[0]]
    return fit(real + [m[0] for m in made], [[said_label(b.path) for b in page] for page in real] + [m[1] for m in made], labeller)


def label_pages(net: BiLstm | None, pages: list[list[Block]], features: Features) -> list[np.ndarray]:
    """Probability of article for each block of each page, in batches of pages of similar length."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    full = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(full) and net is not None:
        size = max(1, min(64, 4096 // len(pages[full[min(at + 63, len(full) - 1)]])))
        part = full[at : at + size]
        x, mask = padded(features.pages([pages[k] for k in part]))
        p = net.forward(x, mask)[0]
        for row, k in enumerate(part):
            out[k] = p[row, : len(pages[k])]
        at += size
    return out


def extract(pages: DataFrame, net: BiLstm | None, labeller: Labeller = Labeller(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` for each row: the article's blocks joined by an empty line."""
    rows = inputs(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [blocks(h or "") for h in batch["html"].to_pylist()]
                kept = [[b.text for b, p in zip(page, ps) if p >= labeller.threshold] for page, ps in zip(found, label_pages(net, found, features))]
                texts = ["\n\n".join(k) for k in kept]
                long = pa.int64()
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], long),
                        "n_blocks": pa.array([len(f) for f in found], long), "n_kept": pa.array([len(k) for k in kept], long),
                    }
                )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
