"""Labelled training pages: layouts written for this library, filled with invented words.

Every page comes with the texts of its article blocks; all other blocks are labelled as not article.
"""

from __future__ import annotations

import random

#: Ways to hold an article: opening and closing markup.
ARTICLES = (
    ("<article>", "</article>"),
    ("<main><article class='post'>", "</article></main>"),
    ("<main>", "</main>"),
    ("<div class='content'>", "</div>"),
    ("<div id='main'><div class='entry-content'>", "</div></div>"),
    ("<section class='story'>", "</section>"),
    ("<div>", "</div>"),
    ("<div class='page-body'><section>", "</section></div>"),
)
#: Ways to hold what is not article; {} takes blocks made by the second entry.
OTHERS = (
    ("<nav><ul>{}</ul></nav>", "links"),
    ("<nav class='breadcrumbs'>{}</nav>", "spans"),
    ("<div class='menu'><ul>{}</ul></div>", "links"),
    ("<ul id='topics'>{}</ul>", "links"),
    ("<header><h1>{}</h1></header>", "words"),
    ("<header class='masthead'><div>{}</div></header>", "words"),
    ("<div class='banner'><p>{}</p></div>", "sentence"),
    ("<footer>{}</footer>", "rights"),
    ("<footer><ul>{}</ul></footer>", "links"),
    ("<div id='footer'><p>{}</p></div>", "rights"),
    ("<footer><p>{}</p></footer>", "sentence"),
    ("<aside><h3>{}</h3></aside>", "words"),
    ("<aside><p>{}</p></aside>", "sentence"),
    ("<div class='sidebar'><ul>{}</ul></div>", "links"),
    ("<div class='widget related'><h4>{}</h4></div>", "words"),
    ("<section class='related-posts'>{}</section>", "paragraph"),
    ("<div class='ad'>{}</div>", "sentence"),
    ("<div class='ad'>{}</div>", "paragraph"),
    ("<div class='advert sponsored'><p>{}</p></div>", "sentence"),
    ("<div class='cookie-notice'><p>{}</p><button>Ok</button></div>", "sentence"),
    ("<dialog><p>{}</p></dialog>", "sentence"),
    ("<div class='newsletter popup'><p>{}</p></div>", "sentence"),
    ("<form><label>{}</label><input><button>Go</button></form>", "words"),
    ("<form class='search'><p>{}</p><select><option>a<option>b</select></form>", "words"),
    ("<section class='comments'><h3>2</h3><p>{}</p></section>", "sentence"),
    ("<div id='comments'><ol>{}</ol></div>", "remarks"),
    ("<div class='share social'>{}</div>", "links"),
)


def labelled_pages(seed: int, n: int) -> list[tuple[str, set[str]]]:
    """``n`` pages as (html, texts of the article's blocks)."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_word(rng) for _ in range(rng.randrange(low, high)))


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 4, 14).capitalize() + "." for _ in range(rng.randrange(low, high)))


def _fill(rng: random.Random, kind: str) -> str:
    if kind == "links":
        return "".join(f"<li><a href='/x'>{_words(rng, 1, 5)}</a></li>" for _ in range(rng.randrange(2, 9)))
    if kind == "spans":
        return " ".join(f"<a href='/x'>{_word(rng)}</a>" for _ in range(3))
    if kind == "words":
        return _words(rng, 1, 6).capitalize()
    if kind == "sentence":
        return _sentences(rng, 1, 3)
    if kind == "rights":
        return f"&copy; {_word(rng)}.example &middot; {_sentences(rng, 0, 2)}"
    if kind == "paragraph":
        return "".join(f"<p>{_sentences(rng, 1, 4)}</p>" for _ in range(2))
    return "".join(f"<li><b>{_word(rng)}</b><p>{_sentences(rng, 1, 3)}</p></li>" for _ in range(rng.randrange(1, 4)))


def _article(rng: random.Random) -> tuple[str, list[str]]:
    parts, texts = [], []

    def add(before: str, text: str, after: str) -> None:
        parts.append(before + text + after)
        texts.append(text)

    if rng.random() < 0.8:
        add("<h1>", _words(rng, 2, 10).capitalize(), "</h1>")
    for _ in range(rng.randrange(1, 9)):
        kind = rng.random()
        if kind < 0.65:
            add(rng.choice(["<p>", "<p><b>", "<p class='x'>"]), _sentences(rng, 1, 9), rng.choice(["</p>", "", "<br>"]))
        elif kind < 0.75:
            add("<h2>", _words(rng, 1, 6).capitalize(), "</h2>")
        elif kind < 0.83:
            parts.append("<ul>")
            for _ in range(rng.randrange(2, 5)):
                add("<li>", _words(rng, 2, 12), "</li>")
            parts.append("</ul>")
        elif kind < 0.88:
            add("<blockquote><p>", _sentences(rng, 1, 3), "</p></blockquote>")
        elif kind < 0.92:
            add("<pre>", _words(rng, 2, 12), "</pre>")
        elif kind < 0.96:
            parts.append("<table><tr>")
            for _ in range(3):
                add("<td>", _words(rng, 1, 5), "</td>")
            parts.append("</tr></table>")
        else:
            add("<div>", _sentences(rng, 1, 5), "</div>")
    if rng.random() < 0.3:
        add("<p>", _words(rng, 1, 3).capitalize() + ".", "</p>")
    return "".join(parts), texts


def _page(rng: random.Random) -> tuple[str, set[str]]:
    before, after = rng.choice(ARTICLES)
    body, texts = _article(rng)
    others = [o.format(_fill(rng, kind)) for o, kind in rng.sample(OTHERS, rng.randrange(2, 9))]
    cut = rng.randrange(len(others) + 1)
    inside = rng.random()
    if inside < 0.2:  # something foreign within the article
        body += others.pop() if others else ""
        cut = min(cut, len(others))
    head = f"<head><title>{_word(rng)}</title><style>p{{}}</style><script>x('</p>')</script></head>"
    page = f"<!DOCTYPE html><html>{head}<body>{''.join(others[:cut])}{before}{body}{after}{''.join(others[cut:])}</body></html>"
    return page, set(texts)
