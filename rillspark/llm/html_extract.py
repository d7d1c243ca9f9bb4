"""Main text of web pages, by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the borders of block elements. A block's input is made of its tag path (tags,
classes and ids of its ancestors, hashed), its words (hashed) and a few measures (length, share of links, place in the page, share of
the page's text in the same container). A bidirectional LSTM in numpy reads all blocks of the page and labels each as main text or not,
so that every label depends on the whole document.

There are no labelled pages. The model is trained on at most SAMPLE pages of at most LONGEST characters of the table itself, rebuilt with
known labels: the text of their content elements, in paragraphs, lists, quotes and tables, is put into containers of many kinds, between
and among menus, headers, footers, sidebars, notices, adverts, forms and comments. In a part of these pages the names of classes and ids are random
and only plain divs and tables are used, so that structure has to tell what names do not. These bounds are for training only.

Results for odd input: null, empty or markup-free html is handled like any other (text outside of any element is a block); a page
without main text gives an empty text; unclosed and misnested tags are closed where the next block begins; an unclosed head ends before
the first text or element that may not stand in it, and of an unclosed svg, iframe, template, noscript or textarea only the tag is left
out; an unclosed script or style reaches to the page's end, as in browsers; an unclosed comment ends at the next "<" or ">"; a quote that is not closed in a tag is
a character like others; very long pages are read whole; rows with the same id are done each for itself; an empty table gives an
empty result; columns of the names text, n_chars and n_blocks are replaced by the results.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import hashed_sample, slices
from rillspark.llm.near_dedup import word_hashes

#: Most pages that the model is trained on, their length in characters, and how many of their blocks are used.
SAMPLE, LONGEST, MOST_BLOCKS = 400, 100_000, 40
PATH, TAGS, WORDS, MEASURES, HIDDEN = 96, 48, 32, 11, 24
WIDTH = PATH + WORDS + MEASURES
STEPS, PAGES_A_STEP, RATE = 400, 24, 0.01
#: Marks main text while a page is rebuilt; a private character.
MARK = "\ue000"

# Elements by kind.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"br", "button", "label", "option", "select"}
SAME_CLOSES = frozenset("li dd dt tr td th option p".split())

# a quote begins a value only after "="; one that is not closed is a character like others
_ATTRIBUTES = r"(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
_REST = rf"(?=[\s/>]){_ATTRIBUTES}>"
_SKIPS = r"<!--.*?-->|<(script|style)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
_TOKEN = re.compile(_SKIPS + rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?][^>]*+>", re.S | re.I)
# Elements without text of the page; where one is not closed, only its tag is left out.
_APART = frozenset("noscript template svg iframe textarea".split())
_APART_TAG = re.compile(_SKIPS + rf"|<(/?)({'|'.join(sorted(_APART))}){_REST}", re.S | re.I)
_HEAD_PART = re.compile(_SKIPS + rf"|([^<]+)|</(head)\s*>|<(title|noframes|noscript|template){_REST}|</?(?:base|basefont|bgsound|link|meta){_REST}|<[!?][^>]*+>", re.S | re.I)
_CLOSED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("title", "noframes")}
_OPEN_COMMENT = re.compile(r"<!--[^<>]*+>?")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")


class Block:
    """Text of a leaf block, its path as a tuple of names, and how many of its characters are in links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _names(tag: str, rest: str) -> tuple[str, ...]:
    if "=" not in rest:
        return (tag,)
    parts = [p for _, *v in _NAMED.findall(rest) for p in _PART.findall("".join(v).lower())]
    return (tag, *(f".{p}" for p in parts))


def _apart(page: str) -> dict[int, int]:
    """Where the closed elements of _APART begin and end."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {tag: [] for tag in _APART}
    for m in _APART_TAG.finditer(page):
        if m[3]:
            waiting = open_at[m[3].lower()]
            if not m[2]:
                if not (m[3].lower() == "svg" and m[0].endswith("/>")):
                    waiting.append(m.start())
            elif waiting:
                ends[waiting.pop()] = m.end()
    return ends


def _head_end(page: str, at: int, apart: dict[int, int], never: set[str]) -> int:
    """Where a head ends whose content begins at `at`: after </head>, or else before the first text or element that may not stand in it.

    never: elements known not to be closed any more, so that no part of a page is searched twice.
    """
    text_at = None
    while m := _HEAD_PART.match(page, at):
        end = m.end()
        if m[3]:
            return end
        if m[2] and text_at is None and not m[2].isspace():
            text_at = at
        tag = (m[4] or "").lower()
        if tag in _APART:
            end = apart.get(at, 0)
        elif tag:
            closed = None if tag in never else _CLOSED[tag].search(page, end)
            if not closed:
                never.add(tag)
            end = closed.end() if closed else 0
        if not end:
            break
        at = end
    return at if text_at is None else text_at


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    path: tuple[str, ...] = ()
    linked = at = 0

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append(Block(text, path, linked))
            texts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal path, linked
        if not texts and not text.isspace():
            path = tuple(n for _, names in stack for n in names)
        if texts or not text.isspace():
            texts.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text)

    apart: dict[int, int] | None = None
    never: set[str] = set()
    closed = page.rfind("-->") + 1
    page = page[:closed] + _OPEN_COMMENT.sub("", page[closed:])
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                close()
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            close()
        if not m[2] and (tag == "head" or tag in _APART):
            close()
            apart = _apart(page) if apart is None else apart
            at = _head_end(page, at, apart, never) if tag == "head" else apart.get(m.start(), at)
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID_TAGS:
            if tag in CLOSES_P or tag in SAME_CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    open_tag = stack[k][0]
                    if open_tag == "p" or (open_tag == tag and tag in SAME_CLOSES):
                        del stack[k:]
                        break
                    if open_tag in BLOCK_TAGS:
                        break
            stack.append((tag, _names(tag, m[4])))
    if at < len(page):
        add(page[at:])
    close()
    return out


_SEEN: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of a path, tags apart from classes and ids; the nearer ancestors count more."""
    found = _SEEN.get(path)
    if found is None:
        found = np.zeros(PATH, np.float32)
        for k, name in enumerate(reversed(path)):
            place = zlib.crc32(name.encode())
            found[TAGS + place % (PATH - TAGS) if name[0] == "." else place % TAGS] += 1.0 / (1 + 0.15 * k)
        if len(_SEEN) > 20_000:
            _SEEN.clear()
        _SEEN[path] = found
    return found


def _shares(page: list[Block]) -> np.ndarray:
    """Of each block's container and the container around it: its share of the page's text; and the container's share of links."""
    text: dict[tuple[str, ...], int] = {}
    links: dict[tuple[str, ...], int] = {}
    around = []
    for b in page:
        ends = [k for k in range(len(b.path) - 1, -1, -1) if b.path[k][0] != "."][:3]  # where the innermost elements begin
        inner, outer = (b.path[: ends[k]] if k < len(ends) else () for k in (0, 1))
        around.append((inner, outer))
        for key in {inner, outer, b.path[: ends[2]] if len(ends) > 2 else ()}:
            text[key] = text.get(key, 0) + len(b.text)
            links[key] = links.get(key, 0) + b.linked
    total = max(1, sum(len(b.text) for b in page))
    return np.array([(text[i] / total, text[o] / total, links[i] / max(1, text[i])) for i, o in around], np.float32).reshape(-1, 3)


def vectors(page: list[Block]) -> np.ndarray:
    """One input row for each block of a page."""
    n = len(page)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    texts = [b.text.encode() for b in page]
    lengths = np.array([len(t) for t in texts])
    starts = np.r_[0, np.cumsum(lengths)]
    hashes, at = word_hashes(np.frombuffer(b"".join(texts), np.uint8), starts)
    row = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(row, minlength=n)
    cells = np.bincount(row * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, :PATH] = [_path_vector(b.path) for b in page]
    out[:, PATH : PATH + WORDS] = cells / np.sqrt(np.maximum((cells.astype(np.float64) ** 2).sum(axis=1), 1))[:, None]
    out[:, PATH + WORDS :] = np.c_[
        np.log1p(lengths) / 5, np.log1p(words) / 4, [b.linked / max(1, len(b.text)) for b in page], np.arange(n) / n, 1 - np.arange(n) / n,
        [b.text[-1] in ".!?" for b in page], [len(b.path) / 10 for b in page], np.ones(n), _shares(page),
    ]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output; weights in float32."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        start = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {f"{name}{d}": w for d in "fb" for name, w in (("x", start(WIDTH, 4 * HIDDEN)), ("h", start(HIDDEN, 4 * HIDDEN)), ("b", np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)))}
        self.weights |= {"o": start(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, page, HIDDEN) of one direction; x is (time, page, WIDTH). Padded steps leave the state as it is."""
        w = self.weights
        drive = x @ w["x" + d] + w["b" + d]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = drive[t] + h @ w["h" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            s = np.tanh(c_new)
            h_new = m * (o * s) + (1 - m) * h
            if keep:
                kept.append((t, h, c, i, f, o, g, s, m))
            h, c = h_new, c_new
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.weights["o"] + self.weights["c"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss over the unmasked blocks, by back-propagation through time."""
        w, passes = self.weights, {d: self._pass(x, mask, d, True) for d in "fb"}
        both = np.concatenate([passes[d][0] for d in "fb"], axis=2)
        error = (_sigmoid((both @ w["o"] + w["c"])[:, :, 0]) - y) * mask / max(1.0, mask.sum())
        grad = {"o": np.einsum("tph,tp->h", both, error)[:, None], "c": np.array([error.sum()])}
        back = error[:, :, None] * w["o"][:, 0]
        for d, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh_next = dc_next = np.zeros((x.shape[1], HIDDEN), np.float32)
            gh = np.zeros_like(w["h" + d])
            for t, h, c, i, f, o, g, s, m in reversed(passes[d][1]):
                dh = part[t] + dh_next
                dc = m * dh * o * (1 - s * s) + dc_next
                dz = np.concatenate([m * dc * g * i * (1 - i), m * dc * c * f * (1 - f), m * dh * s * o * (1 - o), m * dc * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh_next = dz @ w["h" + d].T + (1 - m) * dh
                dc_next = m * dc * f + (1 - m) * dc
            grad |= {"h" + d: gh, "x" + d: np.einsum("tpw,tpz->wz", x, dz_all, optimize=True), "b" + d: dz_all.sum(axis=(0, 1))}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> Labeller:
        """Adam on random pages; the weights are the mean over the last third of the steps."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        mean, n_mean = {k: np.zeros(v.shape) for k, v in self.weights.items()}, 0
        for step in range(1, STEPS + 1 if pages else 1):
            chosen = [pages[k] for k in rng.integers(0, len(pages), PAGES_A_STEP)]
            x, mask, y = padded([p[0] for p in chosen], [p[1] for p in chosen])
            x[:, :, PATH : PATH + WORDS] *= rng.random((*x.shape[:2], 1)) < 0.4  # words tell little across sites
            grad = self.gradients(x, mask, y)
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if step > STEPS * 2 // 3:
                n_mean += 1
                mean = {k: m + (self.weights[k] - m) / n_mean for k, m in mean.items()}
        if n_mean:
            self.weights = {k: m.astype(np.float32) for k, m in mean.items()}
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = max(1, len(pages[order[-1]]))
            take = order[-max(1, min(256, 20_000 // longest)) :]
            del order[-len(take) :]
            x, mask, _ = padded([pages[k] for k in take])
            found = self.logits(x, mask) > 0
            for j, k in enumerate(take):
                out[k] = found[: len(pages[k]), j]
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask, y = np.zeros((longest, len(pages), WIDTH), np.float32), np.zeros((longest, len(pages)), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
        if labels is not None:
            y[: len(page), k] = labels[k]
    return x, mask, y


# Names for containers of main text, and for what is not. They are used in a part of the training pages only.
MAIN_CONTAINERS = ("article", "main", "div.content", "div.post", "div.entry", "div.article-body", "section", "div.story", "div.main", "section.text", "div.page", "article.post")
OTHER_CONTAINERS = (
    "nav", "header", "footer", "aside", "form", "div.ad", "div.advert", "div.sidebar", "div.cookie-notice", "div.comments", "ul.menu", "div.comment", "section.comments", "div.related", "div.share",
    "div.banner", "div.promo", "div.newsletter", "aside.sidebar", "div.header", "div.footer", "div.nav", "div.breadcrumbs", "div.widget", "div.popup", "div.social", "section.related", "div.notice", "ol.comments", "div.login", "div.subscribe",
)


class _Builder:
    """Makes a page of main blocks between others of many kinds. Main text begins with MARK.

    named: whether names and kinds of elements tell anything; if not, containers are divs, sections and tables with random names.
    """

    def __init__(self, others: list[str], rng: np.random.Generator):
        self.others, self.rng, self.named = others, rng, rng.random() < 0.65

    def one(self, choices):
        return choices[self.rng.integers(len(choices))]

    def words(self, most: int) -> str:
        return " ".join(self.one(self.others).split()[: self.rng.integers(1, most + 1)]).rstrip(".!?")

    def random_name(self) -> str:
        letters = "".join(self.one("bcdfghklmnprstvwz") + self.one("aeiou") for _ in range(self.rng.integers(1, 4)))
        return f'{self.one(("class", "id"))}="{letters}{self.one(("", "-"))}{self.rng.integers(100)}"' if self.rng.random() < 0.8 else ""

    def container(self, names: tuple[str, ...]) -> tuple[str, str]:
        if self.named:
            tag, _, name = ("article", "", "") if names is MAIN_CONTAINERS and self.rng.random() < 0.3 else self.one(names).partition(".")
            return (f'<{tag} class="{name}">' if name else f"<{tag}>"), f"</{tag}>"
        tag = self.one(("div", "div", "section"))
        return f"<{tag} {self.random_name()}>", f"</{tag}>"

    def link(self, most: int = 3) -> str:
        return f'<a href="/{self.rng.integers(1000)}">{html.escape(self.words(most))}</a>'

    def menu(self) -> str:
        links = [self.link() for _ in range(self.rng.integers(2, 8))]
        return self.one(("<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " ".join(links), "".join(f"<div>{x}</div>" for x in links), "<h3>" + html.escape(self.words(3)) + "</h3>" + "".join(f"<p>{x}</p>" for x in links)))

    def comments(self) -> str:
        text = lambda: html.escape(self.one(self.others)[: self.rng.integers(20, 400)])
        frame = self.one(("<div><b>{0}</b> <i>{1}</i><p>{2}</p>{3}</div>", "<li>{0} {1}<br>{2} {3}</li>", "<div>{0}</div><div>{2}</div><div>{3}</div>"))
        found = "".join(frame.format(html.escape(self.words(2)), f"{self.rng.integers(1, 29)}:{self.rng.integers(10, 60)}", text(), '<a href="#">Reply</a>') for _ in range(self.rng.integers(1, 5)))
        return f"<h3>{html.escape(self.words(2))}</h3>{found}" if self.rng.random() < 0.5 else found

    def other(self) -> str:
        """What is not main text; prose only where names or replies tell it from main text."""
        start, end = self.container(OTHER_CONTAINERS)
        kinds = [self.menu, self.menu, self.comments, lambda: html.escape(self.words(8)), lambda: "<form>" + "".join(f"<label>{html.escape(self.words(2))}</label><input name=x>" for _ in range(2)) + "<button>OK</button></form>"]
        if self.named:
            kinds += 4 * [lambda: self.one(("{}", "<p>{}</p>")).format(html.escape(self.one(self.others)[:300]))]
        else:
            kinds += [lambda: f"&copy; {html.escape(self.words(4))}", lambda: f"{html.escape(self.words(6))} {self.link()}"]
        return start + self.one(kinds)() + end

    def body(self, heading: str, own: list[str]) -> str:
        mark = lambda t: MARK + html.escape(t)
        out = f"<h1>{mark(heading)}</h1>" if heading else ""
        for t in own:
            kind, words = self.rng.integers(16), t.split()
            if kind == 0 and len(words) > 8:
                rows = [words[k : k + 4] for k in range(0, min(len(words), 20), 4)]
                out += f"<p>{mark(' '.join(words[20:]))}</p>" if len(words) > 20 else ""
                out += "<table>" + "".join("<tr>" + "".join(f"<td>{mark(w)}</td>" for w in row) + "</tr>" for row in rows) + "</table>"
            elif kind == 1:
                step = max(6, len(words) // 6)
                out += "<ul>" + "".join(f"<li>{mark(' '.join(words[k : k + step]))}</li>" for k in range(0, len(words), step)) + "</ul>"
            elif kind == 2 and len(words) > 4:
                out += f'<p>{mark(" ".join(words[:3]))} <a href="/y">{html.escape(words[3])}</a> {html.escape(" ".join(words[4:]))}</p>'
            else:
                frames = ("<blockquote>{}</blockquote>", "<h2>{}</h2>", "<div>{}</div>", "<p><b>{}<br>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "{}<br><br>")
                out += (frames[kind - 3] if 3 <= kind < 3 + len(frames) else "<p>{}</p>").format(mark(t))
            if self.named and self.rng.random() < 0.06:
                tag = self.one(("div", "aside", "section"))
                out += f'<{tag} class="{self.one(("ad", "promo", "related", "share", "newsletter", "subscribe"))}">{self.one((self.menu(), html.escape(self.words(20))))}</{tag}>'
        return out

    def page(self, heading: str, own: list[str]) -> str:
        starts, ends = zip(*(self.container(MAIN_CONTAINERS) for _ in range(self.rng.integers(1, 2 if self.named else 4))), strict=True)
        main = "".join(starts) + self.body(heading, own) + "".join(reversed(ends))
        before, after = ("".join(self.other() for _ in range(self.rng.integers(0, 4))) for _ in range(2))
        if self.rng.random() < 0.5:  # the most usual frame
            bars = ("<nav>{}</nav>", "<footer>{}</footer>") if self.named else ("<div>{}</div>", "<div>{}</div>")
            before = bars[0].format("<ul>" + "".join(f"<li>{self.link(1)}</li>" for _ in range(self.rng.integers(2, 8))) + "</ul>") + before
            after += bars[1].format(f"&copy; site &middot; {html.escape(self.one(self.others)[:200] if self.named else self.words(8))}")
        if not self.named and self.rng.random() < 0.35:  # columns of a layout table
            cells = "".join(f"<td {self.random_name()}>{x}</td>" for x in (before, main, after) if x)
            inside = f"<table><tr>{cells}</tr></table>"
        else:
            inside = before + main + after
        if self.rng.random() < (0.3 if self.named else 0.45):
            inside = f"<div {self.random_name()}>{inside}</div>"
        return f"<html><head><title>{html.escape(heading)}</title></head><body>{inside}</body></html>"


def _content(found: list[Block]) -> tuple[str, list[str]]:
    """Heading and blocks of a content element, if the page has one; otherwise its blocks outside links."""
    inside = [b for b in found if "article" in b.path or "main" in b.path] or [b for b in found if not b.linked]
    heading = next((b.text for b in inside if "h1" in b.path), "")
    return heading, [b.text for b in inside if "h1" not in b.path]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = SAMPLE) -> Labeller:
    """A labeller trained on `most` pages at most (those with the smallest hash of their id), rebuilt with known labels."""
    fit = F.length(html_col).between(1, LONGEST)
    chosen = hashed_sample(pages.where(fit).select(F.col(html_col).alias("html"), F.col(id_col).alias("id")), "id", most)
    parsed = [_content(blocks(r["html"])) for r in chosen.collect()]
    parsed = [(h, own[:MOST_BLOCKS]) for h, own in parsed if own]
    rng = np.random.default_rng(3)
    others = [t for _, own in parsed for t in own if t.split()] or ["text"]
    ready = []
    for k in range(3 * len(parsed)):
        heading, own = parsed[k % len(parsed)]
        if rng.random() < 0.5:  # the page's first block begins with the heading in many pages, and in many not
            heading = own[0][:60].strip()
        found = blocks(_Builder(others, rng).page(heading, own))
        y = np.array([MARK in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace(MARK, "")
        found, y = [b for b in found if b.text], y[[bool(b.text) for b in found]]
        if found:
            ready.append((vectors(found), y))
    return Labeller().fit(ready)


def extracted(pages: DataFrame, labeller: Labeller, html_col: str = "html") -> DataFrame:
    """`pages` without its html, with text (main blocks joined by one space), n_chars, and n_blocks (of the whole page)."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "n_blocks")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string, n_chars long, n_blocks long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col, 2_000_000):
            found = [blocks(h or "") for h in batch.column(html_col).to_pylist()]
            main = labeller.label([vectors(p) for p in found])
            texts = [" ".join(b.text for b, yes in zip(p, m, strict=True) if yes) for p, m in zip(found, main, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in found], pa.int64())], names=[*kept, "text", "n_chars", "n_blocks"])

    return pages.select(*kept, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
