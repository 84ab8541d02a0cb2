"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks: runs of text between the starts and ends of block elements.  Each block has a
vector: hashed names on its tag path (tags, classes, ids), hashed words, its length, its share of link text, its place,
whether a name that not the whole page shares speaks of another part, and how much of the page's text outside links has its path.  A
bidirectional LSTM in numpy reads the sequence and labels every block as main text or not, so what stands before and
after a block counts for it.  The text of a page is its main blocks in page order, one a line.

The labeller is trained on at most ``sample_pages`` pages (the smallest hashes of their ids, none longer than
``sample_chars``; at most ``sample_blocks`` blocks of each).  Where a page names its parts (``article`` against ``nav``, ``footer``, ``aside`` and the like) its
blocks label themselves; from these, training pages with other containers, with comments, notices, forms and adverts
in other places, are put together, so that the labeller does not lean on one layout or on names: half of them tell
nothing by the names of their main parts (``training_pages``).

Defined cases: null or empty html, and pages without main blocks, have an empty text; comments, scripts, styles and
titles are never text, also when they are not closed; unclosed tags are closed as browsers do for paragraphs, list
items and cells; null ids and repeated rows get a row each; without pages to train on nothing is main text; an empty
table gives an empty result; other columns play no part.  Line breaks inside a block are white space.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</?(?P<odd>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>|<[!?][^>]*>", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
#: Elements of the HTML standard that begin a block, whose content is no text, or that have no end.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea noscript template iframe svg math object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
_NO_PARAGRAPH = BLOCKS - {"button", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "body", "html", "head"}

Leaf = tuple[tuple[str, ...], str, int]


def leaves(html: str) -> list[Leaf]:
    """(names on the path, text, characters of links) of every block with text, in page order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Leaf] = []
    text: list[str] = []
    linked, in_link, at, lower = 0, 0, 0, None

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            if said:
                out.append((tuple(x for _, names in stack for x in names), said, min(linked, len(said))))
            text.clear()
        linked = 0

    def pop(names: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            text.append(unescape(html[at:]))
            break
        if m.start() > at:
            said = unescape(html[at : m.start()])
            text.append(said)
            linked += len(said) * (in_link > 0)
        at = m.end()
        name = (m["name"] or m["odd"] or "").lower()
        closing = m["close"] == "/" or html.startswith("</", m.start())
        if name in RAW and not closing and not (m["attrs"] or "").endswith("/"):
            lower = html.lower() if lower is None else lower
            end = lower.find("</" + name, at) if len(lower) == len(html) else html.find("</" + name, at)
            stop = html.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else len(html)
            text.append(" ")
        elif name == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        elif name in BLOCKS:
            flush()
            in_link = 0 if name in ("p", "div", "article", "section") else in_link
            if closing:
                pop({name})
                continue
            if name in CLOSES:
                pop(CLOSES[name]) if not stack or stack[-1][0] not in ("ul", "ol", "table", "tbody") else None
            if name in _NO_PARAGRAPH and any(x == "p" for x, _ in stack):
                pop({"p"})
            if name not in VOID:
                attrs = m["attrs"] or ""
                named = [w for v in _NAMED.findall(attrs) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()) if w] if attrs else []
                stack.append((name, (name, *("." + w for w in named), *([".hidden"] if attrs and _HIDDEN.search(attrs) else []))))
        elif name == "br":
            text.append(" ")
    flush()
    return out


#: Names that say what a part of a page is.
OTHER_TAGS = ["nav", "header", "footer", "aside", "form", "menu", "dialog"]
OTHER_NAMES = (
    "ad ads advert advertisement banner sponsor sponsored promo cookie consent notice alert message sidebar widget menu navbar navigation breadcrumb breadcrumbs "
    "pagination comments comment reply replies respond responses reactions discussion feedback guestbook disqus related recommended share social newsletter subscribe signup login search popup modal overlay "
    "copyright legal footer header masthead topbar bottom toolbar tags".split()
)
_OTHER = frozenset(OTHER_TAGS) | {"." + x for x in OTHER_NAMES}

PATH_SIZE, WORD_SIZE, EXTRAS = 48, 24, 10
SIZE = PATH_SIZE + WORD_SIZE + EXTRAS


def _hashed(name: str) -> np.ndarray:
    return np.random.RandomState(crc32(name.encode())).normal(size=PATH_SIZE) / np.sqrt(8)


class Vectors:
    """Vectors of leaves; paths and names met before are kept, up to a bound."""

    def __init__(self):
        self.names: dict[str, np.ndarray] = {}
        self.paths: dict[tuple, np.ndarray] = {}

    def path(self, names: tuple[str, ...]) -> np.ndarray:
        got = self.paths.get(names)
        if got is None:
            if len(self.paths) > 20_000 or len(self.names) > 20_000:
                self.paths, self.names = {}, {}
            rows = [self.names[n] if n in self.names else self.names.setdefault(n, _hashed(n)) for n in sorted(set(names))]
            got = self.paths[names] = np.sum(rows, axis=0) if rows else np.zeros(PATH_SIZE)
        return got

    def of(self, page: list[Leaf]) -> np.ndarray:
        out = np.zeros((len(page), SIZE), np.float32)
        plain, total, before = Counter(), 1, None  # characters outside links: by path, and in the page
        for names, text, linked in page:
            plain[names] += len(text) - linked
            total += len(text) - linked
        shared = set.intersection(*(set(names) for names, _, _ in page)) if len(page) > 1 else set()  # names of the whole page tell nothing
        telling = _OTHER - shared
        for k, (names, text, linked) in enumerate(page):
            words = text.encode().split()
            at = np.fromiter(map(crc32, words), np.int64, len(words)) % WORD_SIZE
            out[k, :PATH_SIZE] = self.path(names)
            out[k, PATH_SIZE:-EXTRAS] = np.bincount(at, minlength=WORD_SIZE) / (len(words) + 3.0)
            out[k, -EXTRAS:] = np.log1p(len(text)) / 5, linked / len(text), text[-1] in ".!?\"»", k == 0, k == len(page) - 1, min(len(words), 20) / 20, plain[names] / total, names == before, k / len(page), not telling.isdisjoint(names)
            before = names
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM over (steps, pages, features); gates in the order input, forget, output, new."""

    def __init__(self, weights: np.ndarray, hidden: int):
        self.w, self.h = weights, hidden

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, self.h), x.dtype)
        out, kept = np.zeros((steps, pages, self.h), x.dtype), []
        drive = x @ self.w[: x.shape[2]] + self.w[-1]
        u = self.w[x.shape[2] : -1]
        for t in range(steps):
            z = drive[t] + h @ u
            s, n = _sigmoid(z[:, : 3 * self.h]), np.tanh(z[:, 3 * self.h :])
            i, f, o = s[:, : self.h], s[:, self.h : 2 * self.h], s[:, 2 * self.h :]
            before, m = (h, c), mask[t][:, None]
            c = np.where(m, f * c + i * n, c)
            th = np.tanh(c)
            h = np.where(m, o * th, h)
            out[t] = h
            kept.append((before, i, f, o, n, th, m))
        return out, kept

    def backward(self, x: np.ndarray, kept: list, slope: np.ndarray) -> np.ndarray:
        grad, d = np.zeros_like(self.w), x.shape[2]
        u = self.w[d:-1]
        dh = dc = np.zeros_like(slope[0])
        for t in range(len(kept) - 1, -1, -1):
            (h0, c0), i, f, o, n, th, m = kept[t]
            dh = dh + slope[t]
            dcc = np.where(m, dh * o * (1 - th**2), 0) + dc
            dz = np.where(m, np.concatenate([dcc * n * i * (1 - i), dcc * c0 * f * (1 - f), dh * th * o * (1 - o), dcc * i * (1 - n**2)], 1), 0)
            grad[:d] += x[t].T @ dz
            grad[d:-1] += h0.T @ dz
            grad[-1] += dz.sum(0)
            dh = np.where(m, dz @ u.T, dh)
            dc = np.where(m, dcc * f, dc)
        return grad


@dataclass
class Labeller:
    weights: list[np.ndarray]  # forwards, backwards, output
    hidden: int

    @staticmethod
    def new(hidden: int = 16, seed: int = 5) -> Labeller:
        random = np.random.RandomState(seed)
        made = [(random.normal(size=(SIZE + hidden + 1, 4 * hidden)) / np.sqrt(SIZE + hidden)).astype(np.float32) for _ in range(2)]
        for w in made:
            w[-1] = 0
            w[-1, hidden : 2 * hidden] = 1
        return Labeller([*made, (random.normal(size=2 * hidden + SIZE + 1) * 0.1).astype(np.float32)], hidden)

    def _run(self, pages: list[np.ndarray]) -> tuple:
        steps, n = max(map(len, pages)), len(pages)
        x, turned, mask = np.zeros((steps, n, SIZE), np.float32), np.zeros((steps, n, SIZE), np.float32), np.zeros((steps, n), bool)
        for k, p in enumerate(pages):
            x[: len(p), k], turned[: len(p), k], mask[: len(p), k] = p, p[::-1], True
        ahead, kept_a = Direction(self.weights[0], self.hidden).forward(x, mask)
        back, kept_b = Direction(self.weights[1], self.hidden).forward(turned, mask)
        straight = np.zeros_like(back)
        for k, p in enumerate(pages):
            straight[: len(p), k] = back[: len(p), k][::-1]
        top = np.concatenate([ahead, straight, x], 2)
        return x, turned, mask, kept_a, kept_b, top, _sigmoid(top @ self.weights[2][:-1] + self.weights[2][-1])

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of being main text for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        first = 0
        while first < len(order):  # pages of like length together, bounded in cells
            last = first + 1
            while last < len(order) and last - first < 256 and len(pages[order[last]]) * (last - first + 1) < 20_000:
                last += 1
            some = order[first:last]
            p = self._run([pages[k] for k in some])[-1]
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
            first = last
        return out

    def train(self, pages: list[np.ndarray], targets: list[np.ndarray], epochs: int = 12, rate: float = 0.01, batch: int = 32, seed: int = 6) -> None:
        random, step = np.random.RandomState(seed), 0
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for epoch in range(epochs):
            order = random.permutation(len(pages))
            pace = rate * (1 - 0.9 * epoch / epochs)
            for first in range(0, len(order), batch):
                part = order[first : first + batch]
                x, turned, mask, kept_a, kept_b, top, p = self._run([pages[k] for k in part])
                y = np.zeros_like(p)
                for j, k in enumerate(part):
                    y[: len(targets[k]), j] = targets[k]
                error = np.where(mask, p - y, 0) / mask.sum()
                slope = error[..., None] * self.weights[2][:-1]
                h, back = self.hidden, np.zeros((*error.shape, self.hidden), np.float32)
                for j, k in enumerate(part):
                    back[: len(pages[k]), j] = slope[: len(pages[k]), j, h : 2 * h][::-1]
                grads = [
                    Direction(self.weights[0], h).backward(x, kept_a, slope[..., :h].astype(np.float32)),
                    Direction(self.weights[1], h).backward(turned, kept_b, back),
                    np.append((error[..., None] * top).sum((0, 1)), error.sum()),
                ]
                step += 1
                for w, (m, v), g in zip(self.weights, moments, grads):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


#: Containers of main text in training pages.
MAIN = [["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".main", ".content"], ["div", ".post"], ["div", ".entry", ".content"], ["section", ".article"], ["div", ".story"], ["div", ".article", ".body"], ["div", ".text"]]
_INNER = [["p"], ["p"], ["p"], ["div"], ["h2"], ["ul", "li"], ["ol", "li"], ["blockquote", "p"], ["section", "p"], ["pre"], ["table", "tr", "td"], ["dl", "dd"], []]
#: Parts that no name tells from the main text: (elements around, elements of one entry).
_UNNAMED = [["div"], ["div"], ["ul", "li"], ["section"], ["table", "tr", "td"], ["ol", "li"], ["div", "div"], []]


def own_label(names: tuple[str, ...]) -> bool:
    """What the names on a path say of a block."""
    return ("article" in names or "main" in names) and _OTHER.isdisjoint(names)


def training_pages(pages: list[list[Leaf]], sample_blocks: int = 60, made: int = 6, seed: int = 4) -> list[tuple[list[Leaf], list[bool]]]:
    """Every page as it is, and ``made`` times with other containers and other parts around, within and after the main text.

    In half of the made pages the main text stands in containers without a telling name: plain ones, ones with made-up
    words as names, or none.  Menus and footers may then be unnamed as well, known by links and place alone, and readers'
    comments stand under names never met before, as entries of a name, a text and a link.  Main texts of one block are
    among them.  Of a page of more than ``sample_blocks`` blocks, the first two thirds and last third of that number are used.
    """
    random = np.random.RandomState(seed)
    pick = lambda options: options[random.randint(len(options))]
    word = lambda: "".join(random.choice(list("abcdefghilmnoprstu"), random.randint(3, 10)))
    out = []
    for page in pages:
        last = sample_blocks // 3
        page = page[: sample_blocks - last] + page[-last:] if len(page) > sample_blocks else page
        labels = [own_label(names) for names, _, _ in page]
        if not any(labels):
            continue
        out.append((page, labels))
        page_main = [x for x, y in zip(page, labels) if y]
        rest = [x for x, y in zip(page, labels) if not y] or page_main[:1]
        for _ in range(made):
            plain = random.rand() < 0.5
            length = random.rand()
            main = [pick(page_main)] if length < 0.1 else page_main[: random.randint(1, 12)] if length < 0.45 else page_main
            outer = pick([[], [], ["div"], ["div", ".wrapper"], ["div", ".container"], ["div", ".page"], ["div", "." + word()], ["div", ".with", "." + pick(OTHER_NAMES)]])
            container = pick([[], [], ["div"], ["div"], ["div", "." + word()], ["section"], ["table", "tr", "td"], ["div", "div"]]) if plain else pick(MAIN)
            body, blocks = ["html", "body", *outer], []

            def add(path: list[str], text: str, linked: int, label: bool = False) -> None:
                blocks.append(((tuple(path), text, linked), label))

            def part(inside: list[str]) -> None:
                names = [pick(OTHER_TAGS)] if random.rand() < 0.4 else [pick(["div", "div", "section", "ul", "p", "span", "aside", "header", "footer"]), "." + pick(OTHER_NAMES)]
                for _ in range(random.randint(1, 5)):
                    _, text, linked = pick(rest) if random.rand() < 0.6 else pick(main)
                    add([*inside, *names, *pick([["p"], ["p"], ["ul", "li"], ["div"], ["div", "p"], ["label"], ["button"], []])], text, pick([0, 0, linked, len(text)]))

            def links(inside: list[str]) -> None:
                names = [*pick(_UNNAMED), *(["." + word()] if random.rand() < 0.4 else [])]
                for _ in range(random.randint(1, 7)):
                    text = " ".join(pick(rest if random.rand() < 0.5 else main)[1].split()[: random.randint(1, 5)])
                    add([*inside, *names], text, len(text))

            def remarks(inside: list[str], within: bool) -> None:
                bare = random.rand() < 0.5  # inside an article only its name tells these from a section
                names = [pick(["section", "div", "ol", "ul"]), "." + (pick(OTHER_NAMES) if (within and bare) or random.rand() < 0.3 else word())]
                entry = pick([[], [], ["div"], ["li"], ["div", "." + word()]])
                if random.rand() < 0.6:
                    add([*inside, *names, pick(["h2", "h3", "p"])], " ".join(pick(rest)[1].split()[:3]), 0)
                for _ in range(random.randint(1, 5)):
                    said = pick(page_main)[1].split()
                    if not bare:
                        add([*inside, *names, *entry, *pick([["p"], ["div"], []])], " ".join(said[:2]), pick([0, len(" ".join(said[:2]))]))
                    add([*inside, *names, *entry, *pick([["p"], ["p"], ["div"]])], " ".join(said[: random.randint(3, 40)]), 0)
                    if not bare and random.rand() < 0.6:
                        add([*inside, *names, *entry], word(), pick([0, 5]))

            around = (lambda inside: links(inside) if random.rand() < 0.5 else part(inside)) if plain else part
            for _ in range(random.randint(0 if plain else 1, 4)):
                around(body)
            section = [pick(["section", "div"]), "." + word()]  # some of the text may stand in a part with a name of its own
            named = random.randint(0, 2 * len(main) + 1)
            for k, (_, text, linked) in enumerate(main):
                inner = ["h1"] if k == 0 and len(main) > 1 and random.rand() < 0.7 else ["p"] if plain and random.rand() < 0.6 else pick(_INNER)
                add([*body, *container, *(section if container and k > named else []), *inner], text, linked, True)
                if random.rand() < 0.12 and container:
                    part([*body, *container])
            if random.rand() < 0.5:
                within = random.rand() < 0.5
                remarks([*body, *container] if within else body, within)
            for _ in range(random.randint(0 if plain else 1, 4)):
                around([*body, *(container if random.rand() < 0.2 and not plain else [])])
            out.append(([x for x, _ in blocks], [y for _, y in blocks]))
    return out


def fit_labeller(pages: DataFrame, sample_pages: int = 300, sample_chars: int = 100_000, sample_blocks: int = 60) -> Labeller | None:
    """Train on a bounded sample of pages that name their parts."""
    names = F.col("html").rlike(r"(?i)<(article|main)[\s/>]")
    short = pages.select("page_id", "html").where((F.length("html") <= sample_chars) & F.col("page_id").isNotNull() & names)
    ids = short.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    rows = short.join(F.broadcast(ids), "page_id").dropDuplicates(["page_id"]).collect()  # at most sample_pages pages leave the scan
    rows.sort(key=lambda r: r["page_id"])
    vectors = Vectors()
    made = training_pages([leaves(r["html"]) for r in rows], sample_blocks)
    if not made:
        return None
    labeller = Labeller.new()
    labeller.train([vectors.of(p) for p, _ in made], [np.array(y, np.float32) for _, y in made])
    return labeller


_KEPT: dict[int, Vectors] = {}


def main_text(htmls: list[str | None], labeller: Labeller | None, threshold: float = 0.5) -> list[list[str]]:
    """The main blocks of every page."""
    pages = [leaves(h) if h else [] for h in htmls]
    if labeller is None:
        return [[] for _ in pages]
    vectors = _KEPT.setdefault(0, Vectors())
    chances = labeller.probabilities([vectors.of(p) for p in pages])
    return [[text for (_, text, _), p in zip(page, chance) if p > threshold] for page, chance in zip(pages, chances)]


def extracted(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """(page_id, url, text): one row for each page."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        out: list[str] = []
        for first in range(0, batch.num_rows, 512):
            out += ["\n".join(x) for x in main_text(batch["html"][first : first + 512].to_pylist(), labeller)]
        return pa.table({"page_id": batch["page_id"].cast(pa.int64()), "url": batch["url"].cast(pa.string()), "text": pa.array(out, pa.string())})

    return per_batch(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string")
