"""Extraction on pages written by hand, with the texts that a reader would take from them."""

from __future__ import annotations

import pytest

from rillspark.llm import html_extract

P1 = "The river rose by two metres during the night, and the lower road was closed at once."
P2 = "By the morning most of the water had gone, but the bridge will stay shut until Friday."
P3 = "Engineers are to look at its piers on Thursday, when the level should be low enough."
H = "Bridge shut after the flood"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'
NOTE = "&copy; 2024 The Valley Paper"

PAGES = {
    "article": (f"<body><nav>{MENU}</nav><article><h1>{H}</h1><p>{P1}</p><p>{P2}</p></article><footer>{NOTE}</footer></body>", f"{H} {P1} {P2}"),
    "plain divs": (f'<body><div id="k3">{MENU}</div><div id="m7"><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div id="z1">{NOTE}</div></body>', f"{H} {P1} {P2} {P3}"),
    "nested divs": (f'<body><div id="a"><div id="b">{MENU}</div><div id="c"><div id="d"><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></div><div id="e">{NOTE}</div></div></body>', f"{H} {P1} {P2} {P3}"),
    "layout table": (f"<body><table><tr><td>{MENU}</td><td><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></td></tr></table><div>{NOTE}</div></body>", f"{H} {P1} {P2} {P3}"),
    "table inside": (f"<body><nav>{MENU}</nav><article><h1>{H}</h1><p>{P1}</p><table><tr><td>Monday</td><td>2.1 m</td></tr><tr><td>Tuesday</td><td>0.4 m</td></tr></table><p>{P2}</p></article><footer>{NOTE}</footer></body>", f"{H} {P1} Monday 2.1 m Tuesday 0.4 m {P2}"),
    "subscribe beside": (f'<body><div class="td-header">{MENU}</div><div class="td-post-content"><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class="subscribe">Subscribe to our newsletter</div><footer>{NOTE}</footer></body>', f"{H} {P1} {P2} {P3}"),
    "comments": (f'<body><nav>{MENU}</nav><article><h1>{H}</h1><p>{P1}</p><p>{P2}</p></article><section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I drove past it on Sunday and it looked bad.</p><a href="#">Reply</a></div></section><footer>{NOTE}</footer></body>', f"{H} {P1} {P2}"),
}


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_layouts(labeller, name):
    page, expected = PAGES[name]
    found = html_extract.blocks(page)
    main = labeller.label([html_extract.vectors(found)])[0]
    assert " ".join(b.text for b, yes in zip(found, main, strict=True) if yes) == expected


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p title='broken>lost</p>", ["lost"]),
        ("<p title=it's>one</p><p>don't</p>", ["one", "don't"]),
        ('<p title="a > b">one</p>', ["one"]),
        ("<p>one<!-- open <p>two", ["one", "two"]),
        ("<p>one<!-- <p>no --><p>two", ["one", "two"]),
    ],
)
def test_odd_marks(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


def test_many_open_comments_take_linear_time():
    assert [b.text for b in html_extract.blocks("<!-- " * 50_000 + "> one")] == ["one"]
