"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Every block is labelled main text or not. Features are the tags of its ancestors, the words of their
class, id and role, and the block's text (length, words, links, punctuation); transitions tie
neighbours. The field is trained on the driver from a bounded sample of pages and decoded with
Viterbi inside tasks, page by page, without any shuffle.

Labelled pages: pages whose markup tells the main text (an ``article``), at most ``TRAIN_PAGES`` of them
and each at most ``TRAIN_CHARS`` long, those with the smallest hash of the id; and copies of them in
other layouts, where the same article stands in a ``div`` or ``main`` of other names, among menus,
sidebars, notices, forms and reader comments, so that the field does not rest on one tag.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.dom import Block, leaf_blocks

TRAIN_PAGES, TRAIN_CHARS = 150, 40_000
LAYOUTS = 4
STEPS, RATE, RIDGE = 100, 0.1, 0.02
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "menu", "head", "noscript", "button", "select", "template", "dialog")
# Usual names of page parts in other layouts.
MAIN_NAMES = ("content", "main-content", "post-body", "entry-content", "article-body", "story", "text", "post")
MENU_NAMES = ("menu", "navbar", "navigation", "breadcrumb", "topbar", "links")
SIDE_NAMES = ("sidebar", "widget", "related", "promo", "teaser", "recommended", "share", "social")
NOTICE_NAMES = ("cookie-notice", "banner", "consent", "popup", "notice", "newsletter", "subscribe")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsored")
FOOT_NAMES = ("footer", "bottom", "copyright", "legal", "imprint")
COMMENT_NAMES = ("comments", "comment-list", "discussion", "responses", "replies")
SEED_PAGE = (
    "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li></ul></nav><article><h1>A quiet "
    "harbour town</h1><p>The harbour was built when the river still carried timber, and it has kept its narrow quays.</p><p>Most "
    "boats leave before dawn, come back around noon, and sell what they have caught on the spot.</p></article><footer>&copy; "
    "The harbour news</footer></body></html>"
)


def features(blocks: list[Block]) -> list[list[str]]:
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        f = ["bias", f"parent={b.tags[-1] if b.tags else ''}", f"words={min(int(math.log2(words)), 8)}"]
        f += {f"in={t}" for t in b.tags if t not in ("html", "body")}
        f += [f"name={name}" for name in b.names]
        f.append(f"links={int(4 * min(1.0, b.link_chars / len(b.text)))}")
        if b.text[-1] in ".!?:;\"')»":
            f.append("stop")
        if b.text.count(",") > 1:
            f.append("commas")
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("copyright")
        f.append("first" if i == 0 else "last" if i == n - 1 else f"third={3 * i // n}")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of label 1 against label 0 per feature; transitions and start of both labels."""

    weights: dict[str, float]
    steps: list[list[float]]
    start: list[float]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        get = self.weights.get
        scores = [sum(get(f, 0.0) for f in fs) for fs in features(blocks)]
        (s00, s01), (s10, s11) = self.steps
        a, b = self.start[0], self.start[1] + scores[0]
        back = []
        for s in scores[1:]:
            from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((not from_a, not from_b))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + s
        label, labels = b > a, []
        for step in reversed(back):
            labels.append(label)
            label = step[label]
        labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[bool]]]) -> Field:
    """Maximum likelihood with a ridge, by Adam; forward and backward sums over all pages at once."""
    pages = [(blocks, labels) for blocks, labels in pages if blocks]
    index: dict[str, int] = {}
    lists = [[[index.setdefault(f, len(index)) for f in fs] for fs in features(blocks)] for blocks, _ in pages]
    longest = max(map(len, lists))
    y = np.zeros((len(pages), longest), int)
    valid = np.zeros((len(pages), longest), bool)
    flat, cells = [], []
    for p, (fs, (_, labels)) in enumerate(zip(lists, pages)):
        y[p, : len(labels)], valid[p, : len(labels)] = labels, True
        for t, f in enumerate(fs):
            flat += f
            cells += [p * longest + t] * len(f)
    flat, cells = np.array(flat), np.array(cells)
    n = len(index)
    theta, mean, square = np.zeros(n + 6), np.zeros(n + 6), np.zeros(n + 6)
    seen = np.bincount(flat, y.ravel()[cells], n)
    pairs = (2 * y[:, :-1] + y[:, 1:])[valid[:, 1:]]
    seen = np.concatenate((seen, np.bincount(pairs, minlength=4), np.bincount(y[:, 0], minlength=2)))

    def log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(1, STEPS + 1):
        w, steps, start = theta[:n], theta[n : n + 4].reshape(2, 2), theta[n + 4 :]
        emit = np.zeros((len(pages), longest, 2))
        emit[:, :, 1] = np.bincount(cells, w[flat], len(pages) * longest).reshape(len(pages), longest)
        ahead = np.zeros_like(emit)
        behind = np.zeros_like(emit)
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            moved = log_sum(ahead[:, t - 1, :, None] + steps, 1) + emit[:, t]
            ahead[:, t] = np.where(valid[:, t, None], moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = log_sum(steps + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(valid[:, t + 1, None], moved, behind[:, t + 1])
        total = log_sum(ahead[:, -1], 1)
        marginal = np.exp(ahead + behind - total[:, None, None]) * valid[:, :, None]
        joint = np.exp(ahead[:, :-1, :, None] + steps + (emit + behind)[:, 1:, None, :] - total[:, None, None, None])
        joint = (joint * valid[:, 1:, None, None]).sum(axis=(0, 1))
        expected = np.concatenate((np.bincount(flat, marginal[:, :, 1].ravel()[cells], n), joint.ravel(), marginal[:, 0].sum(axis=0)))
        gradient = (seen - expected) / len(pages) - RIDGE * theta / math.sqrt(len(pages))
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta = theta + RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in index.items()}
    return Field(weights, theta[n : n + 4].reshape(2, 2).tolist(), theta[n + 4 :].tolist())


def label_by_markup(blocks: list[Block]) -> list[bool]:
    """Inside an article and in none of its boilerplate parts."""
    return [
        "article" in b.tags and not any(t in BOILERPLATE for t in b.tags[b.tags.index("article") :]) for b in blocks
    ]


def _layout(blocks: list[Block], labels: list[bool], spare: list[str], rng: random.Random) -> str:
    """The page's main blocks in another layout, marked as main text, among other parts."""

    def name(names):
        return rng.choice(("class", "id")) + '="' + rng.choice(names) + '"'

    def links(k):
        return "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(rng.sample(short, min(k, len(short)))))

    def safe(text):
        return text.replace("&", "&amp;").replace("<", "&lt;")

    short = [safe(b.text)[:20] for b, main in zip(blocks, labels) if not main] + ["Home", "About", "Contact", "More"]
    other = lambda: safe(rng.choice(spare))
    main = "".join(
        f"<{b.tags[-1]}>{safe(b.text)}</{b.tags[-1]}>" if b.tags[-1] in ("p", "h1", "h2", "li", "div") else f"<p>{safe(b.text)}</p>"
        for b, is_main in zip(blocks, labels)
        if is_main
    )
    opening = rng.choice((f"div {name(MAIN_NAMES)}", "main", f"section {name(MAIN_NAMES)}", "article", "div"))
    inner = ""
    if rng.random() < 0.5:
        inner = rng.choice((f"<div {name(AD_NAMES)}><p>{other()}</p></div>", f"<aside><p>{other()}</p></aside>", f"<div {name(SIDE_NAMES)}>{other()}</div>"))
    comments = ""
    if rng.random() < 0.7:
        each = "".join(f'<div class="comment"><p>{other()}</p></div>' for _ in range(rng.randint(1, 4)))
        comments = f"<{rng.choice(('div', 'section'))} {name(COMMENT_NAMES)}><h3>{rng.choice(('Comments', 'Responses', other()[:20]))}</h3>{each}"
        comments += "</section>" if comments.startswith("<section") else "</div>"
    top = rng.choice((f"<nav><ul>{links(5)}</ul></nav>", f"<div {name(MENU_NAMES)}><ul>{links(5)}</ul></div>", f"<header><p>{other()[:60]}</p><ul>{links(3)}</ul></header>", f"<ul {name(MENU_NAMES)}>{links(4)}</ul>"))
    side = rng.choice(("", f"<aside><h4>{other()[:25]}</h4><p>{other()}</p></aside>", f"<div {name(SIDE_NAMES)}><ul>{links(4)}</ul><p>{other()}</p></div>"))
    notice = rng.choice(("", f"<div {name(NOTICE_NAMES)}><p>{other()}</p><button>OK</button></div>", f"<form><label>{other()[:30]}</label><input><button>Send</button></form>", f"<div {name(AD_NAMES)}>{other()}</div>"))
    foot = rng.choice((f"<footer>&copy; {other()[:60]}</footer>", f"<div {name(FOOT_NAMES)}><p>&copy; {other()[:80]}</p></div>"))
    # Main text is what is marked; what stands inside its element unmarked is not.
    halves = re.sub(r"<(p|h1|h2|li|div)>", r'<\1 data-main="1">', main)
    cut = halves.find("<", len(halves) // 2)
    if inner and cut > 0:
        halves = halves[:cut] + (inner if halves[cut + 1] != "/" else "") + halves[cut:]
    body = f"<{opening}>{halves}{comments if rng.random() < 0.4 else ''}</{opening.split()[0]}>"
    outside = comments if comments and comments not in body else ""
    middle = [body, side] if rng.random() < 0.7 else [side, body]
    return f"<html><body>{top}{notice if rng.random() < 0.5 else ''}{''.join(middle)}{outside}{notice}{foot}</body></html>"


def labelled_pages(pages: list[str]) -> list[tuple[list[Block], list[bool]]]:
    """Training pages from raw pages: as they are, and in ``LAYOUTS`` other layouts each."""
    rng = random.Random(6)
    parsed = [(b, label_by_markup(b)) for b in map(leaf_blocks, [*pages, SEED_PAGE])]
    parsed = [(b, y) for b, y in parsed if any(y)]
    spare = [block.text for b, _ in parsed for block in b if len(block.text) > 20]
    out = list(parsed)
    for b, y in parsed:
        for _ in range(LAYOUTS):
            blocks = leaf_blocks(_layout(b, y, spare, rng))
            out.append((blocks, [block.main for block in blocks]))
    return out


def fit(pages: DataFrame) -> Field:
    """The field for a table of pages (page_id, html), trained on a bounded sample of them."""
    usable = pages.where(f"html is not null and length(html) <= {TRAIN_CHARS} and html like '%<article%'")
    chosen = [r["page_id"] for r in usable.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES).collect()]
    rows = usable.where(F.col("page_id").isin(chosen)).select("html").dropDuplicates().limit(2 * TRAIN_PAGES).collect() if chosen else []
    return train(labelled_pages(sorted(r["html"] for r in rows)))


def _extract(field: Field):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page or "")
                texts.append("\n".join(b.text for b, main in zip(blocks, field.decode(blocks)) if main))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html).

    A null or empty page, and a page without main text, has the empty text. Repeated pages give
    repeated rows. Other columns are not read.
    """
    field = field or fit(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(field), "page_id long, url string, text string, n_chars long")
