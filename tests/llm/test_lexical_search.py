"""Ranked search against every item and document scored by itself, and on the defined edge cases."""

import math
import random
import re
from collections import Counter

import pytest

from meridia.llm import lexical_search

A_TO_Z = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(A_TO_Z) for t in TERM.findall(text or "")]


def brute(docs, items, k=10, once=True):
    tf = [Counter(terms(t)) for _, t in docs]
    n_docs, n_words = sum(bool(c) for c in tf), sum(map(Counter.total, tf))
    df = Counter(t for c in tf for t in c)
    own = {}
    for item_id, text in items:
        own.setdefault(item_id, Counter()).update(terms(text))
    out = []
    for item_id, words in own.items():
        found = []
        for (doc_id, _), c in zip(docs, tf, strict=True):
            if c:
                m = 10 + 90 * c.total() * n_docs // n_words
                score = sum((1 if once else times) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in words.items() if c[t])
                if score > 0:
                    found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def data():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["Übung", "ÜBUNG", "日本", "The", "the", "THE", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 60, 307])]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(700)]
    docs += [(i, docs[3][1]) for i in range(1000, 1300)]  # a large group of copies
    docs += [(None, docs[3][1]), (None, docs[5][1]), (5, docs[5][1]), (7, None), (8, ""), (9, "-- !"), (10, "w1 " * 40_000)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(40)] + [(3, "w1 w2 The"), (None, "w9 the"), (None, "w8"), (50, None), (51, ""), (52, "nowhere"), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("part_bytes", [1 << 24, 900])
@pytest.mark.parametrize("once", [True, False])
def test_against_all_pairs(spark, part_bytes, once):
    docs, items = data()
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, score string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert rows(lexical_search.rank(d, q, once=once, max_part_bytes=part_bytes)) == brute(docs, items, once=once)


def test_stored_index_and_small_blocks(spark, tmp_path):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    stored = lexical_search.store_index(lexical_search.build_index(d, block_bytes=20_000), str(tmp_path / "index"))
    nothing = spark.createDataFrame([], "doc_id long, text string")
    for some in (items[:9], items[9:]):
        q = spark.createDataFrame([(str(i) if i is not None else None, t) for i, t in some], "item_id string, text string")
        got = rows(lexical_search.rank(nothing, q, k=3, index=stored))
        assert got == brute(docs, [(str(i) if i is not None else None, t) for i, t in some], k=3)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.rank(docs, items).count() == 0 and lexical_search.rank(docs, some).count() == 0
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lexical_search.rank(texts, items).count() == 0
