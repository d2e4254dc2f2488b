"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags. Each block is described by
its tag path (tags, classes and ids of the open elements), hashed words and a few measures. A
bidirectional LSTM in numpy reads the blocks of the whole page in order and gives every block the
probability of being part of the article.

It is trained here, on a bounded sample of pages labelled by their own semantic elements and on
layouts composed at random from the texts of these pages.
"""

from __future__ import annotations

import html as markup
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import arrays, common

#: Pages, chosen by a hash of their id, that the labeller is trained on, and composed ones.
SAMPLE_PAGES, COMPOSED_PAGES = 240, 480
PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 96, 24, 6, 20
EPOCHS, BATCH_PAGES, RATE = 14, 24, 0.01
#: Pages of similar length that are labelled together.
LABEL_PAGES = 128

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S)
_ATTR = re.compile(r"\b(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
# Fixed values of HTML: elements that break a line of text, that have no content, that are never shown.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript textarea iframe svg math object select".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
ENDS_P = BLOCK - {"body", "html", "button", "label", "option", "legend", "summary", "caption", "tbody", "td", "th", "thead", "tr", "tfoot"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links
    main: bool  # marked as main text, in composed pages


@lru_cache(maxsize=1 << 14)
def _described(tag: str, attributes: str) -> tuple[str, bool]:
    """A tag with the words of its class, id and role, and whether it is marked."""
    if "=" not in attributes:
        return tag, False
    words, marked = [tag], False
    for name, *values in _ATTR.findall(attributes):
        if name.lower() == "data-main":
            marked = True
        else:
            words += _WORD.findall(" ".join(values).lower())
    return " ".join(words), marked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; white space is one space, character references are decoded."""
    out: list[Block] = []
    names: list[str] = []  # open elements
    shown: list[str] = []  # the same with their classes
    marks: list[bool] = []
    parts: list[str] = []
    state = {"linked": 0, "path": (), "main": False}

    def close() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((markup.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, state["path"], state["linked"], state["main"]))
            parts.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if unseen:
            return
        if not parts:
            if not text.strip():
                return
            state["path"], state["main"] = tuple(shown), any(marks)
        parts.append(text)
        if "a" in names:
            state["linked"] += len(text)

    unseen, at, end = 0, 0, len(page)

    def pop(n: int) -> None:
        nonlocal unseen
        while len(names) > n:
            unseen -= names[-1] in UNSEEN
            names.pop(), shown.pop(), marks.pop()

    while at < end:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in BLOCK or tag in UNSEEN:
                close()
            if tag in names:
                pop(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag == "br":
            add(" ") if parts else None
            continue
        if tag in BLOCK:
            close()
            if tag in ENDS_P and "p" in names:
                pop(len(names) - 1 - names[::-1].index("p"))
            if tag in SAME:
                inner = max((i for i, x in enumerate(names) if x in SCOPE[tag]), default=-1)
                open_same = [i for i in range(inner + 1, len(names)) if names[i] in SAME[tag]]
                if open_same:
                    pop(open_same[0])
            if tag == "body" and "head" in names:
                pop(names.index("head"))
        if tag in VOID or found[3].endswith("/>") and tag in UNSEEN:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        described, marked = _described(tag, found[3])
        names.append(tag), shown.append(described), marks.append(marked)
        unseen += tag in UNSEEN
    close()
    return out


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed vector of a tag path: every element's words, the nearest three once more by place."""
    vector = _PATHS.get(path)
    if vector is None:
        vector = np.zeros(PATH_DIMS, np.float32)
        for depth, element in enumerate(reversed(path)):
            words = element.split()
            for w in words[:12] + ([f"{depth}:{words[0]}"] if depth < 3 else []):
                code = zlib.crc32(w.encode())
                vector[code % PATH_DIMS] += 1.0 if code & 0x10000 else -1.0
        vector = np.tanh(vector / 2)
        if len(_PATHS) >= 20_000:
            _PATHS.clear()
        _PATHS[path] = vector
    return vector


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page one row per block: tag path, hashed words and measures."""
    found, sizes = [b for page in pages for b in page], np.array([len(p) for p in pages], np.int64)
    out = np.zeros((len(found), PATH_DIMS + WORD_DIMS + MEASURES), np.float32)
    if found:
        words, ends = arrays.words(pa.array([b.text for b in found], pa.large_string()))
        coded = words.dictionary_encode()
        hashed = np.fromiter((zlib.crc32(w) % WORD_DIMS for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(coded.dictionary))
        n = np.diff(ends)
        cells = np.repeat(np.arange(len(n)), n) * WORD_DIMS + (hashed[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64))
        counts = np.bincount(cells, minlength=len(n) * WORD_DIMS).reshape(len(n), WORD_DIMS)
        number: dict[tuple[str, ...], int] = {}
        of = [number.setdefault(b.path, len(number)) for b in found]
        out[:, :PATH_DIMS] = np.stack([_path_vector(p) for p in number])[of]
        out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(np.maximum(n, 1))[:, None] / 4
        length = np.array([len(b.text) for b in found], np.float32)
        linked = np.array([b.linked for b in found], np.float32) / np.maximum(length, 1)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = (np.arange(len(found)) - first + 0.5) / np.repeat(sizes, sizes)
        stops = np.array([b.text.count(".") + b.text.count(",") for b in found], np.float32) / np.maximum(n, 1)
        out[:, -MEASURES:] = np.stack([np.log1p(length) / 6, np.minimum(linked, 1), place, stops, np.log1p(n) / 4, np.array([len(b.path) for b in found]) / 10], 1)
    return np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else []


class Labeller:
    """Bidirectional LSTM with one output per step; all arrays are plain numpy."""

    def __init__(self, seed: int = 0, inputs: int = PATH_DIMS + WORD_DIMS + MEASURES, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.weights = {f"{k}{d}": v for d in "fb" for k, v in (("x", scale(inputs, 4 * hidden)), ("h", scale(hidden, 4 * hidden)), ("b", np.repeat([0, 1, 0, 0], hidden).astype(np.float32)))}
        self.weights |= {"o": scale(2 * hidden + inputs, 1) * 0.5, "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states over ``x`` (steps, pages, inputs); the state of a page holds where it has no block."""
        w, n = self.weights, self.hidden
        drive = x @ w[f"x{side}"] + w[f"b{side}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        states, tape = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            gates = drive[t] + h @ w[f"h{side}"]
            gate = 1 / (1 + np.exp(-np.clip(gates[:, : 3 * n], -30, 30)))
            i, f, o, g = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :], np.tanh(gates[:, 3 * n :])
            new = f * c + i * g
            out = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, o, g, out, m))
            c, h = np.where(m, new, c), np.where(m, o * out, h)
            states[t] = h
        return states, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = [self._run(x, mask, d, False)[0] for d in "fb"]
        z = np.concatenate([*states, x], 2) @ self.weights["o"] + self.weights["c"]
        return 1 / (1 + np.exp(-np.clip(z[..., 0], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradients by back-propagation through time."""
        w, n = self.weights, self.hidden
        runs = [self._run(x, mask, d, True) for d in "fb"]
        joined = np.concatenate([runs[0][0], runs[1][0], x], 2)
        p = 1 / (1 + np.exp(-np.clip((joined @ w["o"] + w["c"])[..., 0], -30, 30)))
        total = max(mask.sum(), 1)
        loss = -(np.where(y, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / total
        dz = ((p - y) * mask / total)[..., None].astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["o"] = joined.reshape(-1, joined.shape[2]).T @ dz.reshape(-1, 1)
        grads["c"] = dz.sum((0, 1))
        back = dz @ w["o"].T
        for k, side in enumerate("fb"):
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            for t, h, c, i, f, o, g, out, m in reversed(runs[k][1]):
                dh = dh + back[t][:, k * n : (k + 1) * n]
                own, keep_h, keep_c = np.where(m, dh, 0), np.where(m, 0, dh), np.where(m, 0, dc)
                d_new = own * o * (1 - out**2) + np.where(m, dc, 0)
                d_gates = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), own * out * o * (1 - o), d_new * i * (1 - g**2)], 1)
                grads[f"x{side}"] += x[t].T @ d_gates
                grads[f"h{side}"] += h.T @ d_gates
                grads[f"b{side}"] += d_gates.sum(0)
                dh, dc = keep_h + d_gates @ w[f"h{side}"].T, keep_c + d_new * f
        return float(loss), grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 0) -> Labeller:
        """Train on pages given as features and labels, by Adam over batches of similar lengths."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        order, step = sorted(range(len(pages)), key=lambda i: len(pages[i][1])), 0
        batches = [order[i : i + BATCH_PAGES] for i in range(0, len(order), BATCH_PAGES)]
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                x, mask = padded([pages[i][0] for i in batches[b]])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(batches[b]):
                    y[: len(pages[i][1]), j] = pages[i][1]
                _, grads = self.gradients(x, mask, y)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g**2 - v)
                    self.weights[k] = self.weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of several pages as (steps, pages, inputs), and where blocks are."""
    steps = max((len(r) for r in rows), default=0)
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), bool)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, True
    return x, mask


_AWAY = frozenset("nav aside footer form menu dialog button label".split())


def semantic_labels(found: list[Block]) -> list[bool] | None:
    """Labels from a page's own elements; None if it has neither article nor main."""
    tags = [[e.split()[0] for e in b.path] for b in found]
    if not any("article" in t or "main" in t for t in tags):
        return None
    words = [set(" ".join(b.path).split()) for b in found]
    return [("article" in t or "main" in t) and not _AWAY & set(t) and not w & _NOISE_WORDS for t, w in zip(tags, words, strict=True)]


# Names that authors give to the parts of a page, for composed layouts.
_NAMES = {
    "menu": "menu nav navigation navbar topnav breadcrumbs breadcrumb links main-menu site-nav tabs pagination".split(),
    "head": "header masthead site-header top branding logo title-bar banner-top hero".split(),
    "foot": "footer site-footer bottom colophon copyright legal imprint credits".split(),
    "side": "sidebar side widget related aside rail recommended popular tags archive more-stories".split(),
    "notice": "cookie cookies notice consent alert gdpr message popup newsletter subscribe paywall modal".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner adbox sponsor".split(),
    "comment": "comments comment discussion responses replies reactions comment-list disqus reader-comments".split(),
    "share": "share social sharing follow toolbar".split(),
    "main": "content main post entry article article-body story text body-copy post-content page-content main-content entry-content".split(),
    "wrap": "wrapper container page site row col layout inner wrap".split(),
}
_NOISE_WORDS = frozenset(w for k in ("ad", "comment", "notice", "share", "side") for n in _NAMES[k] for w in _WORD.findall(n)) - {"side", "top", "message", "list", "more", "stories", "reader", "tags", "archive", "popular"}


def composed_page(rng: random.Random, prose: list[str], small: list[str]) -> str:
    """A page with a random layout; its main text stands in elements marked ``data-main``."""
    say, word = lambda: markup.escape(rng.choice(prose)), lambda: markup.escape(rng.choice(small))
    short = lambda: rng.choice([word, word, lambda: say()[: rng.randrange(20, 160)]])()

    def named(kind: str, tags: str, inner: str, extra: str = "") -> str:
        tag, name = rng.choice(tags.split()), rng.choice(_NAMES[kind])
        named_by = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{rng.choice(_NAMES["wrap"])} {name}"'])
        plain = tag not in ("div", "section", "ul", "p") and rng.random() < 0.6
        return f"<{tag}{'' if plain else named_by}{extra}>{inner}</{tag}>"

    def links(n: int) -> str:
        return rng.choice(["<ul>{}</ul>", "{}"]).format("".join(f'<li><a href="/{i}">{word()}</a></li>' for i in range(n)))

    def comments() -> str:
        one = lambda: f'<div class="comment"><p class="author">{word()}</p><p>{say()}</p></div>' if rng.random() < 0.6 else f"<li><p>{say()}</p></li>"
        return named("comment", "section div ol", f"<h3>{word()}</h3>" * rng.randrange(2) + "".join(one() for _ in range(rng.randrange(1, 6))))

    ad = lambda: named("ad", "div aside section", rng.choice([f"<p>{short()}</p>", short(), f'<a href="x">{short()}</a>']))
    notice = lambda: named("notice", "div section dialog", f"<p>{short()}</p>" + "<button>ok</button>" * rng.randrange(2))
    form = lambda: f"<form><label>{word()}</label><input name=q><button>{word()}</button></form>"
    side = lambda: named("side", "aside div", f"<h3>{word()}</h3>" + rng.choice([links(rng.randrange(2, 8)), f"<p>{short()}</p>"]))
    menu = lambda: named("menu", "nav div ul", links(rng.randrange(3, 10)))
    share = lambda: named("share", "div ul", links(rng.randrange(1, 4)))

    body = []
    for _ in range(rng.choice([1, 2, 4, 8, 15, 30])):
        body.append(rng.choice([lambda: f"<p>{say()}</p>"] * 9 + [lambda: f"<h2>{short()}</h2>", lambda: f"<ul><li>{short()}</li><li>{say()}</li></ul>", lambda: f"<blockquote><p>{say()}</p></blockquote>", lambda: f"<p><b>{say()}<br>", lambda: f"<table><tr><td>{word()}</td><td>{short()}</td></tr></table>", lambda: f"<pre>{say()}</pre>", lambda: f"<div>{say()}</div>", lambda: f"<p>{short()}</p>"])())
    marked = lambda inner: f"<mark-main data-main=1>{inner}</mark-main>"
    pieces = [marked(f"<h1>{short()}</h1>" if rng.random() < 0.8 else f"<header><h1>{short()}</h1></header>")] if rng.random() < 0.9 else []
    for part in [body[i : i + 4] for i in range(0, len(body), 4)]:
        pieces.append(marked("".join(part)))
        if rng.random() < 0.15:
            pieces.append(rng.choice([ad, share, side])())
    if rng.random() < 0.3:
        pieces.append(rng.choice([share, comments, form])())
    main = named("main", "article main article div section", "".join(pieces))
    if rng.random() < 0.4:
        main = named("wrap", "div", main + (comments() if rng.random() < 0.5 else ""))
    before = [named("head", "header div", f"<p>{word()}</p>" + (menu() if rng.random() < 0.5 else "")), menu(), notice(), ad(), form(), side()]
    after = [comments(), side(), ad(), named("foot", "footer div", f"&copy; {short()}" if rng.random() < 0.7 else f"<p>{short()}</p>" + links(3)), notice(), form(), menu()]
    pick = lambda parts: "".join(p for p in parts if rng.random() < 0.45)
    return f"<html><head><title>{word()}</title></head><body>{pick(before)}{main}{pick(after)}</body></html>"


def train(pages: list[str], seed: int = 0) -> Labeller:
    """A labeller from the markup of a bounded sample of pages; the same for the same pages."""
    rng = random.Random(seed)
    read = [blocks(p) for p in pages]
    known = [(b, y) for b in read if b and (y := semantic_labels(b)) is not None]
    texts = [b.text for found in read for b in found]
    prose = [t for t in texts if len(t) >= 40] or ["words of some length that make a sentence, and one more."]
    small = [" ".join(t.split()[:3]) for t in texts] or ["link"]
    for _ in range(COMPOSED_PAGES):
        found = blocks(composed_page(rng, prose, small))
        for b in found:  # the mark itself is no part of the page
            b.path = tuple(e for e in b.path if e != "mark-main")
        known.append((found, [b.main for b in found]))
    data = [(x, np.array(y, np.float32)) for x, (_, y) in zip(features([b for b, _ in known]), known, strict=True)]
    return Labeller(seed).fit([d for d in data if len(d[1])], seed=seed)


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of being main text for each block of each page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order, rows = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i])), features(pages)
    at = 0
    while at < len(order):
        n = max(1, min(LABEL_PAGES, 20_000 // len(pages[order[min(at + LABEL_PAGES, len(order)) - 1]])))
        batch = order[at : at + n]
        x, mask = padded([rows[i] for i in batch])
        p = model.probabilities(x, mask)
        for j, i in enumerate(batch):
            out[i] = p[: len(pages[i]), j]
        at += n
    return out


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """Main text of each page: its article blocks joined by an empty line."""
    read = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, p in zip(found, chance, strict=True) if p >= 0.5) for found, chance in zip(read, label(model, read), strict=True)]


def fit(df: DataFrame, key: str = "page_id", html: str = "html") -> Labeller:
    """Labeller trained on ``SAMPLE_PAGES`` pages, those with the smallest hashes of their keys."""
    pages = df.where(F.col(html).isNotNull()).select(F.xxhash64(F.col(key).cast("long")).alias("_order"), F.col(html).alias("_html"))
    # The last hash is found without the pages: otherwise every partition would send a sample of its own.
    last = pages.select("_order").orderBy("_order").limit(SAMPLE_PAGES).agg(F.max("_order").alias("last")).first()["last"]
    rows = pages.where(F.col("_order") <= last).orderBy("_order", "_html").limit(SAMPLE_PAGES).collect() if last is not None else []
    return train([r["_html"] for r in rows])


def extract(df: DataFrame, model: Labeller, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``df``: key, url, ``text``, ``n_chars``.

    A null or empty page, or one without an article, has the empty text. Repeated rows and null
    keys or urls are kept row by row; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), F.col(html).alias("_html"))
    types = common.schema("_key long, _url string, text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "_html", arrays.SLICE_BYTES // 3):
                texts = main_texts(model, arrays.plain_texts(part.column("_html")).to_pylist())
                yield common.arrow_out({"_key": part.column("_key"), "_url": part.column("_url"), "text": texts, "n_chars": [len(t) for t in texts]}, types)

    return rows.mapInArrow(run, types).withColumnsRenamed({"_key": key, "_url": url})
