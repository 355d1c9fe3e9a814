"""Texts and pages made to break a matcher or a parser."""

import numpy as np
import pytest

from polyrisk.llm import htmltext
from polyrisk.llm.htmltext import main_text

BIG = 200_000
LONG = "word " * 60


@pytest.mark.parametrize(
    "unit",
    ["b.", "a@", "a@b.", "1.", "1-", "1234 ", "123-45-6789 ", "+1 ", "(555) ", "12/", "2020-01-01", "4111 1111 1111 1111 ", "+4420 79460958 ", "x.y@z.com,", "%+-"],
)
def test_pii_in_very_long_texts(spark, unit):
    from polyrisk.llm.pii import pseudonymise

    text = unit * (BIG // len(unit))
    rows = [(1, text), (2, f"x a@{text}c y"), (3, f"+{text}")]
    got = pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()
    assert [r.doc_id for r in got] == [1, 2, 3] and all(r.text for r in got)


def test_pii_hosts_of_many_labels_and_clashing_columns(spark):
    from polyrisk.llm.pii import pseudonymise

    host = "h" + ".b" * 3000
    rows = [(1, f"see someone@{host} now", "kept"), (2, "someone@example.org", "kept")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, __found string").withColumnsRenamed({"doc_id": "__new"})
    got = {r["__new"]: r for r in pseudonymise(frame, "k").collect()}
    name = got[2].text.split("@")[0]
    assert name != "someone" and got[1].text == f"see {name}@{host} now" and got[1]["__found"] == "kept"


def test_malformed_declarations():
    body = f"<article><p>{LONG}</p></article>"
    for mark in ("<![foo[x]]>", "<![", "<!", "<!foo", "<![CDATA[a]]>", "<![if !IE]>", "<!->", "<?php x", "</", "<a b='", "<!DOCTYPE [<!x"):
        assert main_text(f"<p>a</p>{mark}> {body}") in (LONG.strip(), ""), mark
        assert main_text(f"{body}{mark}") == LONG.strip(), mark
    assert main_text(f"<![foo[x]]>{body}") == LONG.strip()


def test_one_bad_page_leaves_the_others(spark):
    rows = [(1, "u", f"<p>a</p><![foo[x]]><article><p>{LONG}</p></article>"), (2, "u", f"<article>{LONG}</article>")]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: LONG.strip(), 2: LONG.strip()}


def test_deep_nesting():
    for tag in ("div", "b", "p", "li", "section"):
        page = f"<{tag}>" * 20_000 + LONG + f"</{tag}>" * 20_000 + "</x>" * 20_000
        assert main_text(page) == LONG.strip()


def test_teaser_articles_are_no_part_of_the_main_one():
    teaser = "<article><h3>Other</h3><a href=x>Read on</a></article>"
    page = f"<main><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></main><div>{teaser * 4}</div>"
    assert main_text(page) == f"Title {LONG}{LONG}".strip()


def test_sections_named_like_boilerplate():
    for name in ("discussion", "note alert"):
        page = f"<article><h1>Title</h1><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>end</p></article>"
        assert main_text(page) == f"Title {LONG}{LONG}end"
    remarks = "<div class=comment><p>me too</p></div>" * 5
    assert main_text(f"<article><p>{LONG}</p><section id=discussion>{remarks}</section></article>") == LONG.strip()


def test_the_clusters_decide(monkeypatch):
    teaser = "<article><h3>Other</h3><a href=x>Read on</a></article>"
    page = f"<main><p>{LONG}</p></main>{teaser * 3}"
    want = main_text(page)
    monkeypatch.setattr(htmltext, "clusters", lambda ratios, sigma: (np.ones(len(ratios), bool),) * 2)
    assert main_text(page) != want == LONG.strip()
