"""The page scanner on cut, deep and hostile markup, and the labeller on markup that says little."""

import time

import numpy as np
import pytest

from hydroledger.llm import html_blocks


def texts(page):
    return [b.text for b in html_blocks.Reader().blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>text</p><p>more <a href='http", ["text", "more"]),
        ("<p>text</p><a " + " ".join(f'k{i}="v{i}"' for i in range(200)), ["text"]),
        ("<p>1 <2 and 3 <b", ["1 <2 and 3 <b"]),
        ('<p title="abc>text</p><p>more</p>', ["text", "more"]),
        ('<p title="a > b">text</p>', ["text"]),
        ("<p>one<!-- <p>two</p> --> three<!-- four", ["one three"]),
        ("<p>a<![CDATA[ <p>b ]]>c<!doctype d>e<?php f ?>g", ["aceg"]),
        ("<p/>x<br/>y<div / >z</div>", ["x y", "z"]),
        ("<p>&#" + "9" * 100_000 + "; &#" + "0" * 5_000 + "65; &amp;</p>", ["� A &"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ],
)
def test_blocks_of_odd_markup(page, want):
    assert texts(page) == want


def test_scanner_reads_each_character_once():
    """Ten times the page takes about ten times as long, not a hundred times."""
    shapes = (
        lambda n: '<a x="1" ' * n,
        lambda n: "<a " * n,
        lambda n: '<a "' * (n + 1),
        lambda n: "<a '\"" * (n + 1),
        lambda n: "<" * n,
        lambda n: "<!--" * n,
        lambda n: "<div>x" * n,
        lambda n: "<div>" * n + "</nav>" * n,
        lambda n: "<p><section>" + "<foo>" * n + "<p>a</p>" * n,
        lambda n: "<p " + 'class="' * (n + 1) + ">x",
        lambda n: "<p>" + "&#" * n,
    )
    for shape in shapes:
        took = []
        for n in (3_000, 30_000):
            page = shape(n)
            begin = time.perf_counter()
            texts(page)
            took.append(time.perf_counter() - begin)
        assert took[1] < 40 * max(took[0], 0.005), (shape(2), took)


def test_paths_follow_the_open_elements():
    reader = html_blocks.Reader()
    page = '<div class="a b"><nav>x</nav><div class="a">y</div>z</div>w'
    x, y, z, w = (b.path for b in reader.blocks(page))
    slot = lambda name: html_blocks._slot(name, html_blocks.PATH_SLOTS)
    assert set(x) == {slot(n) for n in ("div", "of:a", "of:b", "nav", "leaf:nav")}
    assert set(y) == set(z) == {slot(n) for n in ("div", "of:a", "of:b", "leaf:div")}
    assert w == ()


def test_all_words_of_a_block_count():
    p = html_blocks.start_weights()
    known = {}
    block = lambda text: html_blocks.Block(text, (), 0.0)
    rows = [html_blocks._words(block(t), known) for t in ("", "a b", "w " * 700, "w " * 699 + "q")]
    got = html_blocks._ragged_mean(p["word"], rows)
    for row, found in zip(rows, got):
        size = max(1, len(row))
        want = p["word"][row].sum(0) / max(np.sqrt(size), size / 4)
        np.testing.assert_allclose(found, want, atol=1e-12)
    assert not np.allclose(got[2], got[3])


@pytest.fixture(scope="module")
def pages():
    """Named pages to learn from: menus, articles and footers have words of their own."""
    rng = np.random.default_rng(3)
    word = lambda kind, n: " ".join(f"{kind}{k}" for k in rng.integers(0, 400, n))
    made = []
    for _ in range(100):
        body = "".join(f"<p>{word('a', int(rng.integers(5, 60)))}.</p>" for _ in range(6))
        made.append(
            f"<body><nav><a>{word('m', 3)}</a></nav><article>{body}</article>"
            f"<footer>{word('f', 12)}</footer></body>"
        )
    return made


def test_words_of_named_parts(pages):
    reader = html_blocks.Reader()
    parts = html_blocks.named_parts([reader.blocks(x) for x in pages])
    assert {k: {w[0] for w in each} for k, each in parts.items()} == {
        "menu": {"m"},
        "article": {"a"},
        "footer": {"f"},
    }


def test_articles_in_plain_elements(pages):
    """An article in a ``<div>`` without a name, between a cookie notice and a copyright."""
    weights = html_blocks.learn(pages)
    rng = np.random.default_rng(8)
    some = lambda n: " ".join(f"new{k}" for k in rng.integers(0, 5000, n))
    read, marks = [], []
    for _ in range(60):
        size = int(rng.integers(2, 9))
        body = "".join(f"<p>{some(int(rng.integers(20, 80)))}.</p>" for _ in range(size))
        page = (
            f'<body><div class="cookie">{some(12)}</div><div>{body}</div>'
            f'<div class="copyright">&copy; {some(4)}</div></body>'
        )
        read.append(html_blocks.Reader().blocks(page))
        marks.append([False] + [True] * size + [False])
    right = [
        [x >= 0.5 for x in scores] == wanted
        for scores, wanted in zip(html_blocks.label(weights, read), marks)
    ]
    assert sum(right) >= 54
