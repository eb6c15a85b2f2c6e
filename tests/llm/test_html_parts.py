"""Articles without <article> whose text is in lists, tables, quotes and sections."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from verspan.llm import html_extract
from verspan.llm.html_extract import main_text

WORDS = "Some words, and more of them; the end of it. "
SIDE = '<div class="menu"><a href="/">Home</a></div><div class="box"><a href="/x">Other page</a> <a href="/y">One more</a></div>'
PARTS = {
    "list": f"<p>{WORDS * 7}</p><ul><li>{WORDS * 7}</li><li>{WORDS * 6}</li></ul>",
    "table": f"<p>{WORDS * 3}</p><table><tr><td>{WORDS * 9}</td><td>{WORDS * 8}</td></tr></table><p>Short</p>",
    "quote": f"<p>{WORDS * 2}</p><blockquote><p>{WORDS * 12}</p></blockquote><p>{WORDS}</p>",
    "sections": f'<section class="one"><p>{WORDS * 8}</p></section><section class="two"><h2>Head</h2><p>{WORDS * 4}</p></section>',
    "link": f'<p>{WORDS * 5}<a href="/z">linked words</a> go on.</p>',
}


def wanted(part: str) -> str:
    import re

    blocks = re.split(r"</?(?:p|ul|li|table|tr|td|blockquote|section|h2)\b[^>]*>", part)
    return "\n".join(t for t in (re.sub(r"<[^>]*>", "", b).strip() for b in blocks) if t)


@pytest.mark.parametrize("name", sorted(PARTS))
def test_parts_are_kept(name):
    page = f'<html><body>{SIDE}<div class="content">{PARTS[name]}</div><div class="legal"><p>All rights</p></div></body></html>'
    assert main_text(page) == wanted(PARTS[name])


def test_sibling_divisions():
    page = f'<html><body>{SIDE}<div class="first"><p>{WORDS * 9}</p></div><div class="second"><p>{WORDS * 6}</p></div></body></html>'
    assert main_text(page) == wanted(f"<p>{WORDS * 9}</p><p>{WORDS * 6}</p>")


NEUTRAL = f"<html><body><div class=\"k1\"><span>one</span> <span>two</span></div><div class=\"k2\"><p>{WORDS * 9}</p><p>{WORDS * 4}</p></div><div class=\"k3\">{'<span>Box tag</span> ' * 30}</div></body></html>"


def test_ratios_select_without_telling_names():
    assert main_text(NEUTRAL) == wanted(f"<p>{WORDS * 9}</p><p>{WORDS * 4}</p>")


def test_constant_ratios_select_nothing(monkeypatch):
    """Without the ratios every path is a seed, and what is not the article stays in."""
    monkeypatch.setattr(html_extract, "fused_ratios", lambda sums, paths: np.ones(len(sums)))
    assert "Box" in main_text(NEUTRAL)


def test_smoothing_is_the_sum_over_all_pairs():
    rng = random.Random(3)
    paths = html_extract.Paths()
    for i in range(60):
        paths.child(rng.randrange(len(paths.parent)), str(i), "b")
    own = {v: rng.random() for v in rng.sample(range(len(paths.parent)), 20)}

    def up(v):
        return [v, *(up(paths.parent[v]) if v else [])]

    def steps(u, v):
        a, b = up(u), up(v)
        return len(a) + len(b) - 2 * len(set(a) & set(b))

    got = html_extract.smoothed(own, paths)
    assert all(abs(got[v] - sum(x * 0.5 ** steps(u, v) for u, x in own.items())) < 1e-9 for v in range(len(got)))


@pytest.mark.parametrize("part", ["<b>x ", "<div><p>x ", "</i><p>x ", "<ul><li>x "])
def test_broken_pages_take_linear_time(part):
    began = time.time()
    main_text(part * 50_000)
    assert time.time() - began < 20


def test_names_weigh_but_do_not_decide():
    """Article text whose names only hold a noise word stays; a short box with such a name goes; a whole name decides."""
    p = "The quick brown fox, it is said, jumps over the lazy dog; nobody knows why. It did so again, and again. "
    page = f"""<html><body><div class="page"><article><h1>Title</h1><p>{p * 3}</p><p class="notice-board-story">{p * 2}</p>
    <div class="comment-free review"><p>{p * 2}</p></div><section id="related-work"><p>{p * 2}</p></section>
    <div class="related-links"><div>Hot now</div><div>More</div></div><div class="comment"><p>{p}</p></div><p>{p * 3}</p></article></div></body></html>"""
    got = html_extract.main_text(page)
    assert got.count("quick brown") == 3 + 2 + 2 + 2 + 3 and "Hot now" not in got and got.startswith("Title")


def test_deep_pages_are_linear():
    import time

    began = time.time()
    assert "deep text" in html_extract.main_text("<div>" * 100_000 + "deep text, it is. " * 20)
    html_extract.main_text("<div><p>x " * 100_000)
    assert time.time() - began < 10
