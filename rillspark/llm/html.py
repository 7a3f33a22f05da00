"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks, runs of text without a block boundary. Each block gets a vector of its tag
path (tags, classes and ids of its ancestors), its hashed words and a few ratios. A bidirectional LSTM in numpy reads
the whole sequence, so every block is judged with the document around it. The model is trained on the driver, in
seconds, on pages that a seeded generator lays out; its size does not depend on the input.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

PATH, WORDS, HIDDEN = 256, 16, 24
_RATIOS = 8
SIZE = PATH + WORDS + _RATIOS
#: Pages labelled at once.
BATCH = 64
#: Blocks, padding counted, that are labelled at once, unless one page alone has more.
BATCH_BLOCKS = 1 << 14
#: Nearest elements around a block that its path holds.
DEPTH = 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_GONE = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
# fixed values of HTML: elements without content, with raw content, and that break a line of text
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title iframe noframes noembed xmp".split())
# elements whose text is not shown as text of the page
_UNSEEN = set("template svg canvas object".split())
_BLOCK = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY = {"p": _BLOCK - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": _BLOCK - {"head"}}


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


def _names(attrs: str) -> tuple[str, ...]:
    out = [f"{k.lower()}:{w}" for k, v in _NAMES.findall(attrs) for w in _PART.findall(v.strip("\"'").lower())]
    if _GONE.search(attrs):
        out.append("hidden")
    return tuple(out)


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space runs as one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    ink = [0, 0]  # characters of the block, and of those inside links
    at, n = 0, len(html)
    unseen = any(f"<{t}" in html.lower() for t in _UNSEEN)

    def close() -> None:
        text = " ".join("".join(pieces).split())
        if text and not any(s[0] == "head" for s in stack[:4]):
            out.append(Block(tuple(stack[-DEPTH:]), text, ink[1] / max(1, ink[0])))
        pieces.clear()
        ink[0] = ink[1] = 0

    def add(raw: str) -> None:
        if raw and not (unseen and any(s[0] in _UNSEEN for s in stack)):
            t = unescape(raw) if "&" in raw else raw
            pieces.append(t)
            k = len(t) - t.count(" ")
            ink[0] += k
            if any(s[0] == "a" for s in stack[-DEPTH:]):
                ink[1] += k

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag in _BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[0] in _BLOCK for s in stack[k:]):
                        close()
                    del stack[k:]
                    break
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not attrs.rstrip().endswith("/"):
                at = stop.end() if stop else n
            pieces.append(" ")
            continue
        if tag == "br" or tag == "img":
            pieces.append(" ")
        if tag in _BLOCK:
            close()
            while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if k is not None and tag in _CLOSED_BY["p"] and not any(s[0] in ("button", "table", "td") for s in stack[k:]):
                del stack[k:]
        if tag not in _VOID:
            stack.append((tag, _names(attrs)))
    close()
    return out


@lru_cache(maxsize=1 << 16)
def _spot(name: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "replace"))
    return h % size, 1.0 if h >> 31 else -1.0


def vectors(page: list[Block]) -> np.ndarray:
    """One vector for each block."""
    x = np.zeros((len(page), SIZE), np.float32)
    for i, b in enumerate(page):
        row = x[i]
        for depth, (tag, names) in enumerate(reversed(b.path)):
            w = max(0.35, 1.0 - 0.12 * depth)
            for name in (tag, *names):
                k, s = _spot(name, PATH)
                row[k] += s * w
        if b.path:
            k, s = _spot("leaf " + b.path[-1][0], PATH)
            row[k] += s
        words = b.text.lower().split()
        for word, times in Counter(words).items():
            k, s = _spot(word, WORDS)
            row[PATH + k] += times * s / len(words) ** 0.5 * 0.2
        t = b.text
        row[PATH + WORDS :] = (np.log1p(len(t)) / 4, b.linked, t[-1] in ".!?\"'…", np.log1p(len(words)) / 3, sum(c.isdigit() for c in t) / len(t), i / len(page), np.log1p(i) / 3, 1.0)
    return x


class Labeller:
    """A bidirectional LSTM over block vectors and a logistic output for each block."""

    def __init__(self, seed: int = 11):
        g = np.random.Generator(np.random.PCG64(seed))
        h = HIDDEN
        self.w = {f"{d}{k}": (g.standard_normal(s) * (0.6 / s[0] ** 0.5)).astype(np.float32) for d in "fb" for k, s in (("x", (SIZE, 4 * h)), ("h", (h, 4 * h)))}
        for d in "fb":
            b = np.zeros((1, 4 * h), np.float32)
            b[:, h : 2 * h] = 1.0
            self.w[d + "c"] = b
        self.w["o"] = (g.standard_normal((2 * h + SIZE, 1)) * 0.05).astype(np.float32)
        self.w["oc"] = np.zeros((1, 1), np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States of every step of x (steps, pages, SIZE), in the order given; padding keeps the state."""
        h = HIDDEN
        steps, pages = x.shape[:2]
        s, c = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        z = x.reshape(-1, SIZE) @ self.w[d + "x"] + self.w[d + "c"]
        z = z.reshape(steps, pages, 4 * h)
        out, tape = np.empty((steps, pages, h), np.float32), []
        for t in range(steps):
            g = z[t] + s @ self.w[d + "h"]
            gates = 1 / (1 + np.exp(-np.clip(g[:, : 3 * h], -30, 30)))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            u = np.tanh(g[:, 3 * h :])
            m = mask[t][:, None]
            new = np.where(m, f * c + i * u, c)
            th = np.tanh(new)
            tape.append((s, c, i, f, o, u, th, m))
            s, c = np.where(m, o * th, s), new
            out[t] = s
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probability of main text of each block; x is (steps, pages, SIZE), blocks first, padding last."""
        a, ta = self._run("f", x, mask)
        b, tb = self._run("b", x[::-1], mask[::-1])
        y = np.concatenate([a, b[::-1], x], axis=2)
        p = 1 / (1 + np.exp(-np.clip(y @ self.w["o"] + self.w["oc"], -30, 30)))[..., 0]
        return p, (y, ta, tb)

    def _back(self, d: str, x: np.ndarray, tape: list, ds_all: np.ndarray, grad: dict) -> None:
        h = HIDDEN
        ds, dc = np.zeros_like(ds_all[0]), np.zeros_like(ds_all[0])
        dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            s, c, i, f, o, u, th, m = tape[t]
            ds = ds + ds_all[t]
            live = ds * m
            dnew = live * o * (1 - th * th) + dc * m
            dz[t] = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - u * u)], axis=1)
            grad[d + "h"] += s.T @ dz[t]
            ds = dz[t] @ self.w[d + "h"].T + ds * ~m
            dc = dnew * f + dc * ~m
        flat = dz.reshape(-1, 4 * h)
        grad[d + "x"] += x.reshape(-1, SIZE).T @ flat
        grad[d + "c"] += flat.sum(0, keepdims=True)

    def fit(self, pages: list[np.ndarray], marks: list[np.ndarray], rounds: int, seed: int = 5) -> None:
        """Adam on cross-entropy, pages of similar length together."""
        g = np.random.Generator(np.random.PCG64(seed))
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        by = np.argsort([len(p) for p in pages], kind="stable")
        step = 0
        for r in range(rounds):
            parts = [by[k : k + 16] for k in range(0, len(by), 16)]
            for q in g.permutation(len(parts)):
                x, mask = padded([pages[k] for k in parts[q]])
                y = np.zeros(mask.shape, np.float32)
                for j, k in enumerate(parts[q]):
                    y[: len(marks[k]), j] = marks[k]
                p, (feats, ta, tb) = self.forward(x, mask)
                d = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                grad["o"] = feats.reshape(-1, feats.shape[2]).T @ d.reshape(-1, 1)
                grad["oc"] = d.sum((0, 1)).reshape(1, 1)
                dy = d @ self.w["o"].T
                self._back("f", x, ta, dy[..., :HIDDEN], grad)
                self._back("b", x[::-1], tb, dy[::-1, :, HIDDEN : 2 * HIDDEN], grad)
                step += 1
                rate = 0.01 if r < rounds / 2 else 0.004 if r < rounds * 3 / 4 else 0.001
                for k, v in self.w.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                    m2[k] = 0.99 * m2[k] + 0.01 * grad[k] ** 2
                    v -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8) + rate * 1e-3 * v

    def main_blocks(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        by = np.argsort([len(p) for p in pages], kind="stable")
        by = [k for k in by if len(pages[k])]
        while by:
            take = max(1, min(BATCH, BATCH_BLOCKS // len(pages[by[-1]])))
            own, by = by[-take:], by[:-take]
            if own:
                p, _ = self.forward(*padded([pages[k] for k in own]))
                for j, k in enumerate(own):
                    out[k] = p[: len(pages[k]), j] >= 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x, mask = np.zeros((n, len(pages), SIZE), np.float32), np.zeros((n, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def sample_page(g: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page and the texts of its main blocks, in order."""

    def pick(items: str) -> str:
        return str(g.choice(items.split()))

    def word() -> str:
        return "".join(pick("an be co da en fi go ha in ju ka le mi no or pa que re sa ti un ve wi er tion ing sch lle ado") for _ in range(g.integers(1, 4)))

    def text(low: int, high: int, stop: bool = True, odd: float = 0.04) -> str:
        w = [word() for _ in range(g.integers(low, high))]
        if g.random() < odd:  # shouting, repetition and stray symbols occur in main text as well
            mark = pick("*** ### $$$ %%% !!")
            w = [x + mark for x in w] if g.random() < 0.6 else [w[0]] * len(w) if g.random() < 0.5 else [x.upper() + "!!" for x in w]
        t = " ".join(x + ("." if stop and g.random() < 0.1 else "," if g.random() < 0.05 else "") for x in w)
        return t[:1].upper() + t[1:] + ("." if stop else "")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{text(1, 4, False)}</a></li>' for _ in range(n))

    def named(tag: str, names: str) -> str:
        return f'<{tag} {pick("class class id")}="{pick(names)}">'

    def junk(kind: str) -> str:
        long = g.random() < 0.5
        body = text(12, 60) if long else text(2, 12, bool(g.random() < 0.6))
        if kind == "menu":
            return pick("x y") == "x" and f"<nav><ul>{links(g.integers(2, 8))}</ul></nav>" or f"{named('div', 'menu navbar navigation nav topnav breadcrumbs breadcrumb tabs')}<ul>{links(g.integers(2, 8))}</ul></div>"
        if kind == "header":
            return g.random() < 0.6 and f"<header>{pick('<h1> <div> <p> <h2>')}{text(1, 6, False)}</header>" or f"{named('div', 'header site-header banner masthead topbar logo')}<p>{body}</p></div>"
        if kind == "footer":
            inner = f"&copy; {body}" if g.random() < 0.5 else f"<p>{body}</p>"
            return g.random() < 0.7 and f"<footer>{inner}</footer>" or f"{named('div', 'footer site-footer copyright legal bottom')}{inner}</div>"
        if kind == "sidebar":
            inner = f"<h3>{text(1, 4, False)}</h3>" + (f"<p>{body}</p>" if g.random() < 0.5 else f"<ul>{links(g.integers(2, 6))}</ul>")
            return g.random() < 0.5 and f"<aside>{inner}</aside>" or f"{named('div', 'sidebar side aside widget related recommended trending popular toc right-rail tags share social')}{inner}</div>"
        if kind == "notice":
            return f"{named(pick('div section p aside div'), 'notice cookie cookies cookie-banner consent gdpr alert banner warning popup modal paywall privacy message')}{body}</div>"
        if kind == "ad":
            return f"<!-- ad {g.integers(9999)} -->{named(pick('div aside section div div'), 'ad ads advert advertisement sponsored sponsor promo promotion banner-ad adbox dfp')}{g.random() < 0.5 and '<p>' or ''}{body}</div>"
        if kind == "form":
            return f"<form action='/{word()}'><label>{text(1, 4, False)}</label><input name=q><p>{body}</p><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>" if g.random() < 0.7 else f"{named('div', 'newsletter subscribe signup search login contact-form')}<p>{body}</p><input type=text></div>"
        rows = "".join(f"{pick('<li> <div> <p> <article>')}<b>{word()}</b> <p>{text(5, 50)}</p>" for _ in range(g.integers(1, 5)))
        return f"{named(pick('section div ol div'), 'comments comment commentlist comment-list discussion replies reply responses disqus reader-comments')}<h3>{text(1, 3, False)}</h3>{rows}</{pick('section div')}>"

    def paragraph() -> tuple[str, list[str]]:
        t, r = text(*((1, 6) if g.random() < 0.25 else (3, 90)), odd=0.18), g.random()
        if r < 0.55:
            return f"<p>{t}</p>", [t]
        if r < 0.7:
            return f"<p><b>{t}<br>", [t]
        if r < 0.77:
            w = t.split(" ")
            k = int(g.integers(0, len(w)))
            w[k] = f"<a href='#'>{w[k]}</a>"
            return f"<p>{' '.join(w)}</p>", [t]
        if r < 0.9:
            items = [text(1, 25, odd=0.18) for _ in range(g.integers(1, 5))]
            tag, shut = pick("ul ul ol"), pick("</li> x").strip("x")
            if g.random() < 0.2:
                return "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in items) + "</table>", items
            return f"<{tag}>" + "".join(f"<li>{x}{shut}" for x in items) + f"</{tag}>", items
        if r < 0.95:
            return f"<h2>{t}</h2>", [t]
        tag = pick("blockquote div pre")
        return f"<{tag}>{t}</{tag}>", [t]

    inner, own = [], []
    if g.random() < 0.8:
        t = text(2, 14, bool(g.random() < 0.3))
        inner.append(f"<h1>{t}</h1>")
        own.append(t)
    for _ in range(1 + min(30, int(g.exponential(6)))):
        part, kept = paragraph()
        inner.append(part)
        own.extend(kept)
        if g.random() < 0.06:
            inner.append(junk(pick("ad sidebar notice form")))
    if g.random() < 0.35:
        tag = named("div", "wrapper container row inner col column section block")
        inner = [tag, *inner, "</div>"]
    opening, closing = ("<article>", "</article>") if g.random() < 0.5 else ("<main>", "</main>") if g.random() < 0.3 else (named(pick("div section td div"), "content article post entry story main-content body-text post-content article-body entry-content text page"), "</div>")
    before = [junk(pick("menu header notice ad sidebar form")) for _ in range(g.integers(0, 4))]
    after = [junk(pick("sidebar ad comments form notice comments")) for _ in range(g.integers(0, 4))]
    foot = [junk("footer")] if g.random() < 0.85 else []
    if g.random() < 0.4:
        before.append(named("div", "wrapper container page site layout row outer"))
        after.append("</div>")
    page = f"<html><head><title>{text(2, 8, False)}</title></head><body>{''.join(before)}{opening}{''.join(inner)}{closing}{''.join(after)}{''.join(foot)}</body></html>"
    return page, own


@lru_cache(maxsize=4)
def trained(pages: int = 1000, rounds: int = 8, seed: int = 3) -> Labeller:
    """A labeller of made-up pages; the same one for the same arguments."""
    g = np.random.Generator(np.random.PCG64(seed))
    xs, ys = [], []
    for _ in range(pages):
        html, main = sample_page(g)
        page = blocks(html)
        if page:
            wanted = {" ".join(unescape(t).split()) for t in main}
            xs.append(vectors(page))
            ys.append(np.array([b.text in wanted for b in page], np.float32))
    model = Labeller()
    model.fit(xs, ys, rounds)
    return model


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main blocks in page order, joined by two line feeds.

    Null or empty html, and pages without a main block, give an empty text. Pages are read whole; nothing is dropped or
    cut inside a block. Null ids and repeated rows are rows like others."""
    model = trained()
    kind = pages.schema[page_id].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "html"):
            split = [blocks(h) if h else [] for h in part.column(2).to_pylist()]
            main = model.main_blocks([vectors(b) for b in split])
            texts = ["\n\n".join(x.text for x, m in zip(b, ok, strict=True) if m) if b else "" for b, ok in zip(split, main, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(label, f"page_id {kind}, url string, text string, n_chars bigint")
