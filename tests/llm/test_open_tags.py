"""Pages with a head or other elements that are not closed lose nothing but tags."""

from __future__ import annotations

import pytest

from rillspark.llm import html_extract


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><body><p>one<p>two</body></html>", ["one", "two"]),
        ("<head><meta charset=x><script>a<b</script><style>p{}</style><div>one</div>", ["one"]),
        ("<head>\n<title>t</title>one<p>two", ["one", "two"]),
        ("<head>odd<title>t</title><link rel=x></head><p>one", ["one"]),
        ("<head><noscript><p>no</noscript><template><template></template>no</template><base href=x>one", ["one"]),
        ("<head><title>one<p>two", ["one", "two"]),
        ("<head><div>one</div></head><p>two", ["one", "two"]),
        ("<head-line>one</head-line><p>two", ["one", "two"]),
        ('<p>one<svg class="i"/><p>two<svg><text>no</text></svg>three', ["one", "two", "three"]),
        ("<p>one<svg><svg>no</svg>no</svg>two", ["one", "two"]),
        ("<p>one<svg><p>two", ["one", "two"]),
        ("<p>one<svg><p>two<svg>no</svg><p>three", ["one", "two", "three"]),
        ("<p>one<iframe src=x><p>two<noscript>three<p>four<template>five<textarea>six", ["one", "two", "three", "four", "five", "six"]),
        ("<p>one<iframe>no</iframe>two<noscript><p>no</noscript>three<template><template>no</template>no</template>four<textarea>no</TEXTAREA >five", ["one", "two", "three", "four", "five"]),
        ("<p>one<svg><!-- </svg> -->no</svg>two<script>'<svg>'</script>three", ["one", "two", "three"]),
        ("<p>one<script>no", ["one"]),
    ],
)
def test_open_tags(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


def test_many_open_tags_take_linear_time():
    page = "<svg><template><iframe>" * 20_000 + "one"
    assert [b.text for b in html_extract.blocks(page)] == ["one"]
    assert [b.text for b in html_extract.blocks("<head>" * 20_000 + "one")] == ["one"]
    assert [b.text for b in html_extract.blocks("<head><title>" * 20_000 + "one")] == ["one"]
