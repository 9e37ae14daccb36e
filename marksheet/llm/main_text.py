"""Main text of web pages by a tree-structured graphical model.

Every block element and every text block of a page is a binary variable (content or not). Node potentials are
log-linear in what the node shows, parent-child potentials in the kind of edge. Sum-product messages run once from
the leaves to the root and once back, level by level over all pages of a batch at once, and give exact marginals.
The weights are fitted by gradient ascent on the likelihood of labelled pages, with the same messages.

An element is content if content lies anywhere below it, so what isn't content has none below. Features of a text block, as
its share of legal words and of digits, are taken from the whole block; legal words count outside articles alone, and the
less the more of the page's blocks have them, as that is then what the page is about.

Defined results: null or empty html, and a page whose text blocks are all unlikely, give an empty text; a page
without any hint of its structure keeps what reads like prose; repeated rows give equal results; a null page_id or
url is carried on; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import Page, parse
from .textbuf import runs

#: Kinds of elements and of name words.
TAG_KINDS = {
    "nav": "nav menu", "head": "header hgroup", "foot": "footer", "aside": "aside", "form": "form button select option optgroup textarea fieldset legend dialog", "main": "article main",
    "box": "section div center details", "par": "p", "title": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl dir", "item": "li dt dd summary", "table": "table thead tbody tfoot tr td th caption",
    "quote": "blockquote pre figure figcaption address", "root": "html body",
}
NAME_KINDS = {
    "content": "article content post entry main story body text prose page",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adslot dfp",
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip topbar",
    "side": "sidebar side aside widget related recommend recommended recommendations share social sharing tags trending popular complementary more",
    "talk": "comment comments reply replies respond disqus discussion thread feedback reviews",
    "note": "cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup gdpr paywall warning disclaimer privacy",
    "edge": "footer foot header head masthead contentinfo copyright legal colophon credits byline meta banner",
    "form": "form search login register input",
    "hidden": "hidden",
}
_TAG = {t: k for k, line in enumerate(TAG_KINDS.values()) for t in line.split()}
_NAME: dict[str, list[int]] = {}
for _k, _line in enumerate(NAME_KINDS.values()):
    for _w in _line.split():
        _NAME.setdefault(_w, []).append(_k)
_DIGIT = re.compile(r"\d")
#: Kinds of elements and names below which a text is no longer inside the article.
_MAIN, _APART = list(TAG_KINDS).index("main"), {list(TAG_KINDS).index(k) for k in ("nav", "foot", "aside", "form")}
_CONTENT = list(NAME_KINDS).index("content")
#: Legal words; a block of which LEGAL_SHARE of the words or more are such shows the feature in full.
_LEGAL, LEGAL_SHARE = re.compile("©|copyright|all rights|cookie"), 0.05
N_TAG, N_NAME, N_TEXT = len(TAG_KINDS) + 1, len(NAME_KINDS), 10
N_NODE = 1 + N_TAG + N_NAME + N_TAG + N_TEXT
#: Kinds of edges: element under element, text under element, and the same below an element with a telling name.
N_EDGE = 4


def _places(page: Page) -> tuple[list[bool], dict[int, float]]:
    """For each node, whether it is inside an article; for each text block, how much it shows the feature of legal words."""
    inside: list[bool] = []
    share: dict[int, float] = {}
    for k, (up, tag, names, text) in enumerate(zip(page.parent, page.tag, page.names, page.text, strict=True)):
        if text is not None:
            inside.append(inside[up])
            share[k] = 0.0 if inside[up] else min(len(_LEGAL.findall(text.lower())) / (text.count(" ") + 1) / LEGAL_SHARE, 1.0)
            continue
        told, kind = [x for w in names for x in _NAME.get(w, ())], _TAG.get(tag)
        apart = kind in _APART or any(x != _CONTENT for x in told)
        inside.append(not apart and (kind == _MAIN or _CONTENT in told or (up >= 0 and inside[up])))
    rest = 1 - sum(x > 0 for x in share.values()) / max(1, len(share))
    return inside, {k: x * rest for k, x in share.items()}


class Forest:
    """The trees of several pages as arrays; parents come before children."""

    def __init__(self, pages: list[Page]) -> None:
        base, parent, self.page_of, self.text = 0, [], [], []
        rows, cols, vals, edge = [], [], [], []
        for number, page in enumerate(pages):
            inside, legal = _places(page)
            for k, (up, tag, names, text) in enumerate(zip(page.parent, page.tag, page.names, page.text, strict=True)):
                node = base + k
                parent.append(base + up if up >= 0 else -1)
                self.page_of.append(number)
                self.text.append(text)
                told = [x for w in names for x in _NAME.get(w, ())]
                feats: list[tuple[int, float]] = [(0, 1.0)]
                if text is None:
                    feats.append((1 + _TAG.get(tag, N_TAG - 1), 1.0))
                    feats += [(1 + N_TAG + x, 1.0) for x in set(told)]
                else:
                    owner = page.tag[up]
                    feats.append((1 + N_TAG + N_NAME + _TAG.get(owner, N_TAG - 1), 1.0))
                    at = 1 + N_TAG + N_NAME + N_TAG
                    n, words = len(text), text.count(" ") + 1
                    feats += [(at, 1.0), (at + 1, min(np.log1p(words), 6.0) / 3), (at + 2, page.linked[k] / n), (at + 3, float(text[-1] in ".!?:\"”…")), (at + 4, legal[k]), (at + 5, float(words < 5)), (at + 6, (text.count(".") + text.count(",") + text.count(";")) / words), (at + 7, float(words > 25)), (at + 8, len(_DIGIT.findall(text)) / n), (at + 9, float(inside[k]))]
                rows += [node] * len(feats)
                cols += [c for c, _ in feats]
                vals += [v for _, v in feats]
                edge.append((text is not None) + 2 * any(w in _NAME for w in (page.names[up] if up >= 0 else ())))
            base += len(page.parent)
        self.n = base
        self.parent = np.array(parent, np.int64)
        self.edge = np.array(edge, np.int64)
        self.rows, self.cols, self.vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals)
        depth = np.zeros(base, np.int64)
        for k, up in enumerate(parent):
            if up >= 0:
                depth[k] = depth[up] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts) if base else []

    def node_scores(self, w: np.ndarray) -> np.ndarray:
        """Log potential of content against not for each node."""
        return np.bincount(self.rows, w[self.cols] * self.vals, self.n)

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of each node, P(parent, child) of each edge, log partition. pair: (N_EDGE, 2, 2) log potentials."""
        up = np.zeros((self.n, 2))
        up[:, 1] = self.node_scores(w)
        message = np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            m = np.logaddexp(up[level, 0][:, None] + pair[self.edge[level], :, 0], up[level, 1][:, None] + pair[self.edge[level], :, 1])
            message[level] = m
            np.add.at(up, self.parent[level], m)
        belief = up.copy()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            mother = self.parent[level]
            cavity = belief[mother] - message[level]
            full = cavity[:, :, None] + pair[self.edge[level]] + up[level][:, None, :]
            joint[level] = full
            belief[level] = np.logaddexp(full[:, 0, :], full[:, 1, :])
        roots = self.levels[0] if self.levels else np.zeros(0, np.int64)
        z = np.logaddexp(belief[:, 0], belief[:, 1])
        prob = np.exp(belief[:, 1] - z)
        joint = np.exp(joint - z[:, None, None])
        joint[roots] = 0
        return prob, joint, float(z[roots].sum())


class Model:
    def __init__(self, w: np.ndarray, pair: np.ndarray) -> None:
        self.w, self.pair = w, pair

    def texts(self, pages: list[Page]) -> list[str]:
        forest = Forest(pages)
        prob, _, _ = forest.marginals(self.w, self.pair)
        out: list[list[str]] = [[] for _ in pages]
        for k, text in enumerate(forest.text):
            if text is not None and prob[k] >= 0.5:
                out[forest.page_of[k]].append(text)
        return ["\n\n".join(x) for x in out]


def fit(pages: list[Page], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.12, ridge: float = 0.02) -> Model:
    """labels: 0 or 1 for each node of each page. Ascends the penalised log likelihood by Adam from zero; no randomness."""
    forest = Forest(pages)
    y = np.concatenate(labels).astype(float)
    mother = np.maximum(forest.parent, 0)
    child = forest.parent >= 0
    pair_seen = np.zeros((N_EDGE, 2, 2))
    np.add.at(pair_seen, (forest.edge[child], y[mother[child]].astype(int), y[child].astype(int)), 1)
    node_seen = np.bincount(forest.cols, forest.vals * y[forest.rows], N_NODE)
    theta = np.zeros(N_NODE + N_EDGE * 4)
    m = v = np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, pair = theta[:N_NODE], theta[N_NODE:].reshape(N_EDGE, 2, 2)
        prob, joint, _ = forest.marginals(w, pair)
        pair_hoped = np.zeros_like(pair_seen)
        np.add.at(pair_hoped, forest.edge[child], joint[child])
        g = np.concatenate([node_seen - np.bincount(forest.cols, forest.vals * prob[forest.rows], N_NODE), (pair_seen - pair_hoped).ravel()]) / len(pages) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:N_NODE].copy(), theta[N_NODE:].reshape(N_EDGE, 2, 2).copy())


# ---------------------------------------------------------------- labelled pages


def labelled_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of made-up words in one of many layouts; for each text block in page order, whether it is content."""
    out: list[str] = []
    truth: list[bool] = []
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    topic = rng.random() < 0.15  # the article is about what notices and footers speak of
    legal = ["cookie", "cookies", "copyright", "all rights reserved"]

    def text(content: bool, a: int, b: int, end: str = ".", spiced: float = 0.0) -> str:
        truth.append(content)
        said = prose(a, b)
        if rng.random() < (0.7 * topic if content else spiced):
            said += " " + rng.choice(legal) + rng.choice(["", f" {word()} {word()}"])
        return said + end

    def box(tag: str, names: list[str], inner) -> None:
        name = rng.choice([*names, None])
        attr = "" if name is None else rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"'])
        out.append(f"<{tag}{attr}>")
        inner()
        out.append(f"</{tag}>")

    def link_list(n: int) -> None:
        out.append("<ul>")
        for _ in range(n):
            out.append(f'<li><a href="/{word()}">{text(False, 1, 3, "")}</a></li>')
        out.append("</ul>")

    def menu() -> None:
        rng.choice([lambda: box("nav", ["menu", "nav", "navbar"], lambda: link_list(rng.randint(3, 7))), lambda: sure("div", ["menu", "nav", "breadcrumb"], lambda: link_list(rng.randint(2, 6)))])()

    def sure(tag: str, names: list[str], inner) -> None:
        out.append(f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">')
        inner()
        out.append(f"</{tag}>")

    def advert() -> None:
        sure("div", ["ad", "ads", "advert", "sponsored", "promo", "ad-banner"], lambda: out.append(rng.choice(["{}", "<p>{}</p>", "<a href=x>{}</a>"]).format(text(False, 4, 25))))

    def notice() -> None:
        sure(rng.choice(["div", "section"]), ["cookie-notice", "consent", "newsletter", "alert", "notice", "popup"], lambda: out.append(f"<p>{text(False, 6, 25, spiced=0.5)}</p><button>{text(False, 1, 2, '')}</button>"))

    def side() -> None:
        def inner() -> None:
            out.append(f"<h3>{text(False, 1, 3, '')}</h3>")
            link_list(rng.randint(2, 5))
            if rng.random() < 0.5:
                out.append(f"<p>{text(False, 6, 30)}</p>")

        if rng.random() < 0.5:
            box("aside", ["sidebar", "related", "widget"], inner)
        else:
            sure("div", ["sidebar", "related", "widget", "share", "recommended"], inner)

    def talk() -> None:
        def inner() -> None:
            out.append(f"<h2>{text(False, 1, 2, '')}</h2>")
            for _ in range(rng.randint(1, 4)):
                out.append(f'<{(t := rng.choice(["div", "li", "article"]))} class="comment"><p>{text(False, 4, 50)}</p></{t}>')

        sure(rng.choice(["section", "div", "ol"]), ["comments", "discussion", "replies", "comment-list"], inner)

    def form() -> None:
        box("form", ["search", "login", "form"], lambda: out.append(f"<label>{text(False, 1, 3, ':')}</label><div>{text(False, 1, 4)}</div><button>{text(False, 1, 2, '')}</button>"))

    def foot(tag: str = "footer") -> None:
        (box if tag == "footer" else sure)(tag, ["footer", "site-footer", "copyright"], lambda: out.append(f"<p>&copy; {text(False, 2, 12, spiced=0.3)}</p>" if rng.random() < 0.6 else f"&copy; {text(False, 3, 20, spiced=0.3)}"))

    def article() -> None:
        style = rng.random()
        if rng.random() < 0.12:  # a few words are an article, too
            if rng.random() < 0.5:
                out.append(f"<h1>{text(True, 1, 3, '')}</h1>")
            out.append(f"<p>{text(True, 1, 8)}</p>")
            if rng.random() < 0.5:
                rng.choice([side, advert, notice])()
            return
        title = f"<h1>{text(True, rng.choice([1, 3]), 14, rng.choice(['', '.']))}</h1>"
        out.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
        if rng.random() < 0.15:
            out.append(f"{text(True, 1, 30, rng.choice([',', '.']))}<br>")
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if rng.random() < 0.06:  # legal phrases in articles are text, too
                truth.append(True)
                out.append(f"<p>{rng.choice(['', prose(3, 12) + '. '])}{rng.choice(['All rights reserved.', 'Copyright holders agree.', 'A cookie was baked.', 'Released under a licence.'])}</p>")
            if style < 0.4:
                out.append(f"<p><b>{text(True, 2, 80)}<br>" if kind < 0.3 else f"<p>{text(True, 1, 120)}</p>")
            elif kind < 0.6:
                out.append(f"<p>{text(True, 1, 110)}</p>")
            elif kind < 0.68:
                out.append(f"<h2>{text(True, 1, 6, '')}</h2>")
            elif kind < 0.76:
                out.append("<ul>" + "".join(f"<li>{text(True, 1, 14, rng.choice(['', '.', ';']))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote><p>{text(True, 4, 40)}</p></blockquote>")
            elif kind < 0.86:
                out.append("<table>" + "".join(f"<tr><td>{text(True, 1, 4, '')}</td><td>{text(True, 1, 4, '')}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.90:
                out.append(f"<pre>{text(True, 3, 12)}</pre>")
            elif kind < 0.93:
                advert()
            elif kind < 0.96:
                out.append(f"<div>{text(True, 8, 60)}</div>")
            else:
                rng.choice([side, notice])()
        if rng.random() < 0.12:
            talk()

    def maybe(p: float, f) -> None:
        if rng.random() < p:
            f()

    out.append(f"<!DOCTYPE html><html><head><title>{prose(3, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>")
    if rng.random() < 0.6:
        box("header", ["masthead", "site-header"], lambda: (out.append(f"<div>{text(False, 1, 5, '')}</div>"), maybe(0.5, menu)))
    for p, f in ((0.75, menu), (0.5, advert), (0.3, notice), (0.2, form), (0.2, side)):
        maybe(p, f)
    shape, wraps = rng.random(), rng.choice([0, 0, 0, 1, 2, 4])
    out.extend(rng.choice(["<div>", f'<div class="{word()}">', f'<div id="{rng.choice(["wrapper", "page", "container"])}">']) for _ in range(wraps))
    if shape < 0.55:
        box("article", ["post", "entry", "article"], article)
    elif shape < 0.72:
        box("main", ["content", "main"], article)
    elif shape < 0.80:  # nothing but the page itself holds the article
        article()
    elif shape < 0.84:
        out.append("<div>")
        article()
        out.append("</div>")
    else:
        sure("div", ["content", "post", "article-body", "main-content", "entry-content"], article)
    out.append("</div>" * wraps)
    for p, f in ((0.4, side), (0.45, talk), (0.25, advert), (0.25, form), (0.15, notice)):
        maybe(p, f)
    maybe(0.8, lambda: foot(rng.choice(["footer", "footer", "div"])))
    return "".join(out) + rng.choice(["</body></html>", ""]), truth


def node_labels(page: Page, truth: list[bool]) -> np.ndarray:
    """Text blocks as told; an element is content if some text below it is."""
    n = len(page.parent)
    good = np.zeros(n, int)
    leaves = [k for k in range(n) if page.text[k] is not None]
    good[leaves] = truth
    for k in range(n - 1, 0, -1):
        good[page.parent[k]] |= good[k]
    return good


_models: dict[tuple[int, int], Model] = {}


def default_model(n_pages: int = 400, seed: int = 7) -> Model:
    """Fitted on n_pages made-up labelled pages; the same weights each time."""
    if (n_pages, seed) not in _models:
        rng = random.Random(seed)
        made = [labelled_page(rng) for _ in range(n_pages)]
        pages = [parse(source) for source, _ in made]
        _models[n_pages, seed] = fit(pages, [node_labels(p, t) for p, (_, t) in zip(pages, made, strict=True)])
    return _models[n_pages, seed]


# ---------------------------------------------------------------- Spark


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages(page_id, url, html, ...) to (page_id, url, text, n_chars); one pass, no shuffle."""
    model = model or default_model()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "html", 1_000_000):
            texts = model.texts([parse(x or "") for x in run.rows.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([run.rows.column(0), run.rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
