"""Page extraction: raw elements, names inside articles, constant headings, and hosts of long pages."""

import random
import time

import pytest

from meridia.llm import html_extraction as H


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p>one</p><svg class="i"/><p>two three</p></article>', "one\n\ntwo three"),
        ("<article><p>one</p><iframe src=x><p>two three</p></article>", "one\n\ntwo three"),
        ("<article><p>one</p><iframe src=x><p>no</p></iframe><p>two</p></article>", "one\n\ntwo"),
        ("<article><p>one</p><script>var a = 1<p>two</article>", "one\n\ntwo"),
        ("<article><p>a<!-- not closed <p>b</article>", "a not closed\n\nb"),
        ("<article><p>a<!-- closed <p>no --><p>b</article>", "a\n\nb"),
        ('<article><p>a</p><svg><title>no</title><path d="x"/></svg><p>b</p></article>', "a\n\nb"),
        ('<article><div class="market-share"><p>a</p></div><div class="social-history">b</div><p class="notice-period">c</p></article>', "a\n\nb\n\nc"),
        ('<article><p>a</p><div class="share-buttons">no</div><div class="ad-slot-2">no</div><ul class="comment-list"><li>no</ul><p class="x related-articles">no</p></article>', "a"),
    ],
)
def test_cases(html, text):
    assert H.content(H.parse(html)) == text
    frame = "<html><body><div class=top>The same frame here</div>{}<div class=end>And its end</div></body></html>"
    pages = [frame.format(f"<article><h1>Other {k} words</h1><p>something quite different {k} {k * 7} in page {k}</p></article>") for k in range(5)]
    wrapper = H.induce([*pages, frame.format(html)])
    assert H.content(H.parse(frame.format(html)), wrapper) == text


def recipe(k, rng):
    food = lambda: " ".join(rng.choices("salt flour eggs butter onions basil rice beans pepper lemon oil garlic".split(), k=6))
    rows = "".join(f"<tr><td>{food()}</td><td>{rng.randrange(900)}</td></tr>" for _ in range(3))
    return f"<html><body><div class=hd>Kitchen of all</div><article><h1>{food()} {k}</h1><h2>Ingredients</h2><ul><li>{food()}</li><li>{food()}</li></ul><h2>Method</h2><p>{food()} {k}</p><table><caption>Values</caption><tr><th>What</th><th>How much</th></tr>{rows}</table><dl><dt>Serves</dt><dd>{k}</dd></dl><h2>Follow us everywhere</h2><p>Follow our kitchen by post</p></article></body></html>"


def test_constant_headings_of_what_varies_stay():
    rng = random.Random(4)
    pages = [recipe(k, rng) for k in range(12)]
    wrapper = H.induce(pages)
    for html in pages:
        got = H.content(H.parse(html), wrapper).split("\n\n")
        assert {"Ingredients", "Method", "Values", "What", "How much", "Serves"} <= set(got)
        assert "Follow us everywhere" not in got and "Follow our kitchen by post" not in got and "Kitchen of all" not in got


def test_a_host_of_long_pages():
    """64 pages of 1,600 sections in turn, and of sections in random order."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    for kinds in (["h3", "p"], None):
        pages = []
        for _ in range(64):
            tags = (kinds or []) * 1600 if kinds else rng.choices(["h3", "p", "ul", "pre", "table", "blockquote"], k=1600)
            pages.append("<html><body><div class=hd>the same head</div><div class=body>" + "".join(f"<{t}>{word()} {word()}</{t}>" for t in tags) + "</div></body></html>")
        began = time.process_time()
        wrapper = H.induce(pages)
        got = H.content(H.parse(pages[0]), wrapper)
        assert time.process_time() - began < 60 and "the same head" not in got and got.count("\n\n") > 1500


def test_heaviest_chain_by_brute_force():
    import itertools

    rng = random.Random(7)
    for _ in range(200):
        pairs = [(rng.randrange(5), rng.randrange(5), rng.randrange(1, 6)) for _ in range(rng.randrange(0, 8))]
        pairs = list({(i, j): (i, j, w) for i, j, w in pairs}.values())
        best = 0
        for r in range(len(pairs) + 1):
            for some in itertools.combinations(sorted(pairs), r):
                if all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(some)):
                    best = max(best, sum(w for *_, w in some))
        weight, chain = H._heaviest(pairs, 5)
        assert weight == best == sum(w for i, j, w in pairs if (i, j) in chain)
