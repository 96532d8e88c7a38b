"""Main text: held-out labelled pages, the table's pages against a plain reading, and odd markup."""

import html
import re
from itertools import product

import numpy as np
import pytest

from folioflow.llm import html_crf as crf

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def field():
    return crf.trained()


def test_held_out_pages(field):
    pages = crf.labelled_blocks(77, 200)
    right = [a == b for features, labels in pages for a, b in zip(field.labels(features), labels, strict=True)]
    assert np.mean(right) > 0.99


def test_viterbi_matches_trying_every_labelling(field):
    for features, _ in crf.labelled_blocks(5, 40):
        features = features[:9]
        emit = [field.emit[list(f)].sum(axis=0) for f in features]

        def score(ys, emit=emit):
            return field.begin[ys[0]] + sum(e[y] for e, y in zip(emit, ys, strict=True)) + sum(field.move[a, b] for a, b in zip(ys, ys[1:], strict=False))

        best = max(score(ys) for ys in product((0, 1), repeat=len(features)))
        assert score(field.labels(features)) == pytest.approx(best)


def plain(page):
    """Reading for pages whose article stands in one article element of headings and paragraphs."""
    article = page[page.index("<article>") : page.index("</article>")]
    parts = re.split(r"</?(?:p|h1|article)>", article)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark, sf):
    from folioflow.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op5_main_text"](spark, sf).collect()}
    assert len(got) == len(rows)
    same = [got[r["page_id"]]["text"] == plain(r["html"]) for r in rows]
    assert np.mean(same) >= 0.98
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd_markup(field):
    body = "<article><p>One fine sentence here, with words.</p><p>Two &amp; three\n\t lines.</p></article>"
    want = "One fine sentence here, with words.\nTwo & three lines."
    assert field.extract(f"<body>{body}</body>") == want
    assert field.extract(f"<nav><a href='>'>menu</a></nav><script>if (a < b) '</p>'</script><!-- <p>no</p> -->{body}") == want
    assert field.extract(f"<style>p {{}}</style>{body}<div hidden>unseen</div><template><p>not shown</p></template>") == want
    assert field.extract(body.replace("</p>", "")) == want
    for page in ("", "<", "<p", "</p></p>", "<a href='", "plain words only", "<p>" * 5000, "<b>" * 20000 + "</i>" * 20000, "<a b=\"" * 2000, "<!--", "<script>"):
        assert isinstance(field.extract(page), str)


def test_odd_rows(spark, field):
    rows = [(1, None, None, "x", "y"), (None, "u", "", "", ""), (2, "u", "<p>w", "", ""), (2, "u", "<p>w", "", ""), (3, "u", "<p>" + "word " * 100000, "", "")]
    got = crf.main_text(spark.createDataFrame(rows, SCHEMA), field).collect()
    assert len(got) == 5 and {r["text"] for r in got if r["page_id"] in (1, None)} == {""}
    assert crf.main_text(spark.createDataFrame([], SCHEMA), field).collect() == []
