"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A leaf block is a run of text between two block-level tags. Its features are the tags and the class and id words above
it, its own tag, and the shape of its text (length, share of links, ending). The field has a label per block, article
or not, weights per feature and label and per pair of neighbouring labels. It is trained by maximum likelihood on the
labelled pages of :mod:`folioflow.llm.labelled_pages` and decoded by Viterbi. Pages are worked on
one by one inside a task, in time linear in their length, and never shuffled.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.labelled_pages import labelled_pages

PAGES, ROUNDS, RATE, RIDGE = 400, 150, 0.1, 1e-3

# HTML's element kinds.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object textarea title head canvas audio video".split())
#: A start tag of the key ends an open element of the value.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
} | {t: ("p",) for t in BLOCK if t not in ("li", "dt", "dd", "tr", "td", "th", "option", "body", "html", "head", "button", "caption")}
#: Elements that such an implied end does not reach beyond.
SCOPE = frozenset("table ul ol dl td th button select body html article section div main aside nav".split())

TAGS = "nav header footer aside form article main section ul ol table figure dialog button select label blockquote address".split()
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc topics pagination pager",
    "head": "header masthead banner topbar branding",
    "foot": "footer foot copyright legal colophon",
    "side": "sidebar side aside widget widgets related recommended trending popular rail more",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe gdpr overlay paywall signup login",
    "reader": "comment comments reply replies discussion disqus respond reviews",
    "share": "share sharing social",
    "text": "article content post entry story main body text page",
}
KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
OWN = "p h1 h2 h3 h4 h5 h6 li td th dd dt pre figcaption blockquote div".split()
SHAPES = ["short", "brief", "middle", "long", "links none", "links some", "links most", "sentence", "sign", "first"]
NAMES = [f"in {t}" for t in TAGS] + [f"class {k}" for k in WORDS] + [f"tag {t}" for t in OWN] + SHAPES + ["always"]
INDEX = {n: i for i, n in enumerate(NAMES)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDE = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


@lru_cache(1 << 14)
def _attributes(raw: str) -> tuple[frozenset[int], bool]:
    """(feature numbers of class and id words, whether the element is hidden)."""
    words = (w for _, v in _NAMED.findall(raw) for w in re.split(r"[^a-z]+", v.lower()))
    return frozenset(INDEX[f"class {KIND[w]}"] for w in words if w in KIND), bool(_HIDE.search(raw))


def blocks(page: str) -> list[tuple[str, tuple[int, ...]]]:
    """(text, feature numbers) of every leaf block in page order."""
    out: list[tuple[str, tuple[int, ...]]] = []
    stack: list[tuple[str, frozenset[int], bool]] = []
    open_tags: dict[str, int] = {}
    above: dict[int, int] = {}
    texts: list[str] = []
    links = skip = anchors = 0

    def flush() -> None:
        nonlocal links
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                own = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
                out.append((text, _features(text, links, own, above, not out)))
        links = 0

    def pop() -> str:
        nonlocal skip, anchors
        tag, marks, hides = stack.pop()
        open_tags[tag] -= 1
        skip -= hides
        anchors -= tag == "a"
        for m in marks:
            above[m] -= 1
        return tag

    place, end = 0, len(page)
    while place < end:
        match = _TOKEN.search(page, place)
        start = match.start() if match else end
        if start > place and not skip:
            part = page[place:start]
            texts.append(part)
            links += len(part) if anchors else 0
        if not match:
            break
        place = match.end()
        slash, name, raw = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if slash:
            if not open_tags.get(tag):
                if tag in BLOCK:
                    flush()
                continue
            if tag in BLOCK:
                flush()
            while pop() != tag:
                pass
            continue
        if tag in BLOCK:
            flush()
            for other in CLOSES.get(tag, ()):
                if open_tags.get(other):
                    depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == other or stack[i][0] in SCOPE), -1)
                    if depth >= 0 and stack[depth][0] == other:
                        while len(stack) > depth:
                            pop()
        elif tag == "br":
            texts.append(" ")
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):  # raw text up to the end tag
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, place)
            place = close.end() if close else end
            continue
        marks, hidden = _attributes(raw) if raw else (frozenset(), False)
        if f"in {tag}" in INDEX:
            marks = marks | {INDEX[f"in {tag}"]}
        hides = hidden or tag in HIDDEN
        stack.append((tag, marks, hides))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        skip += hides
        anchors += tag == "a"
        for m in marks:
            above[m] = above.get(m, 0) + 1
    flush()
    return out


def _features(text: str, links: int, own: str, above: dict[int, int], first: bool) -> tuple[int, ...]:
    words = text.count(" ") + 1
    found = [m for m, n in above.items() if n]
    if f"tag {own}" in INDEX:
        found.append(INDEX[f"tag {own}"])
    found.append(INDEX["short" if words < 4 else "brief" if words < 10 else "middle" if words < 25 else "long"])
    found.append(INDEX["links none" if not links else "links some" if links * 2 < len(text) else "links most"])
    if text[-1] in ".!?:;\"'”’»。！？…)":
        found.append(INDEX["sentence"])
    if "©" in text or "®" in text:
        found.append(INDEX["sign"])
    if first:
        found.append(INDEX["first"])
    found.append(INDEX["always"])
    return tuple(sorted(found))


class Field:
    """Weights of the field: per feature and label, per pair of labels, per first label."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin
        self.known: dict[tuple[int, ...], tuple[float, float]] = {}

    def labels(self, features: list[tuple[int, ...]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not features:
            return []
        (aa, ab), (ba, bb) = self.move.tolist()
        back = []
        a = b = 0.0
        for n, f in enumerate(features):
            if f not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[f] = tuple(self.emit[list(f)].sum(axis=0).tolist())
            ea, eb = self.known[f]
            if n == 0:
                a, b = self.begin[0] + ea, self.begin[1] + eb
                continue
            back.append((a + aa < b + ba, a + ab < b + bb))
            a, b = max(a + aa, b + ba) + ea, max(a + ab, b + bb) + eb
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def extract(self, page: str) -> str:
        found = blocks(page)
        keep = self.labels([f for _, f in found])
        return "\n".join(t for (t, _), k in zip(found, keep, strict=True) if k)


def train(pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a ridge: forward-backward over all pages at once, Adam steps."""
    pages = [p for p in pages if p[0]]
    size, n, width = max(len(f) for f, _ in pages), len(pages), len(NAMES)
    x, y, mask = np.zeros((n, size, width)), np.zeros((n, size), int), np.zeros((n, size))
    for i, (features, labels) in enumerate(pages):
        for t, f in enumerate(features):
            x[i, t, list(f)] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, 1
    gold = np.eye(2)[y] * mask[..., None]
    gold_move = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:] * mask[:, 1:, None])
    theta = np.zeros(2 * width + 6)
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        emit, move, begin = theta[: 2 * width].reshape(width, 2), theta[2 * width : -2].reshape(2, 2), theta[-2:]
        score = x @ emit
        forward, backward = np.zeros((n, size, 2)), np.zeros((n, size, 2))
        forward[:, 0] = begin + score[:, 0]
        for t in range(1, size):
            nxt = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, nxt, forward[:, t - 1])
        for t in range(size - 2, -1, -1):
            nxt = np.logaddexp.reduce(move + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, nxt, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        point = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        pair = forward[:, :-1, :, None] + move + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        gradient = np.concatenate(
            [np.einsum("ntf,ntk->fk", x, point - gold).ravel(), (pair - gold_move).ravel(), (point[:, 0] - gold[:, 0]).sum(axis=0)]
        ) / n + RIDGE * theta
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.999 * spread + 0.001 * gradient**2
        theta = theta - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return Field(theta[: 2 * width].reshape(width, 2), theta[2 * width : -2].reshape(2, 2), theta[-2:])


def labelled_blocks(seed: int, n: int) -> list[tuple[list[tuple[int, ...]], list[int]]]:
    """Features and labels of labelled pages: a block is article if its text is one of the page's article blocks."""
    out = []
    for page, article in labelled_pages(seed, n):
        found = blocks(page)
        out.append(([f for _, f in found], [int(t in article) for t, _ in found]))
    return out


def trained(seed: int = 1, n: int = PAGES) -> Field:
    return train(labelled_blocks(seed, n))


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages``.

    Null html is empty and gives an empty text; repeated rows get their text each; an empty table gives no rows;
    other columns are ignored.
    """
    field = field or trained()

    def scan(batches):
        for batch in batches:
            texts = [field.extract(t or "") for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
