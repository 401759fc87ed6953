"""Source mixing against its laws, counted word by word, and on the defined edge cases."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meridia.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, target int"


def filled(sizes, weights, most=3):
    """Targets by sharing again and again, as the rule says."""
    total, stopped = sum(sizes.values()), {}
    while True:
        left, open_weight = total - sum(stopped.values()), sum(w for s, w in weights.items() if s not in stopped)
        over = {s: most * sizes[s] for s, w in weights.items() if s not in stopped and open_weight and w * left / open_weight >= most * sizes[s]}
        if not over:
            return {s: stopped.get(s, w * left / open_weight if open_weight else 0.0) for s, w in weights.items()}
        stopped |= over


def data(rng):
    docs = []
    for k, (source, n) in enumerate({"b": 400, "a": 30, None: 60, "": 25, "é": 3, "z": 900, "empty": 4, "one": 1}.items()):
        for i in range(n):
            words = 0 if source == "empty" else rng.choice([0, 1, 3, 20, 20, 90, 400]) if source != "one" else 7
            docs.append((1000 * k + i, None if words == 0 and i % 2 else " \t".join(f"w{rng.randrange(50)}" for _ in range(words)), source))
    docs += [(5, "same text here", "z")] * 500 + [(None, "same text here", "z")] * 40 + [(6, "word " * 30_000, "b")]
    return [(*d, "clash", 1) for d in docs]


@pytest.mark.parametrize("block", [16, 1024])
def test_laws(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    docs = data(random.Random(3))
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    documents, pieces = mixing.mixture(df, block_words=block, shard_words=4000)
    got = mixing.taken(documents, pieces).collect()
    count = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, text, source, *_ in docs:
        sizes[source] += count(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    assert len(got) == len(docs) and sum(targets.values()) == pytest.approx(sum(sizes.values()))
    total = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        whole = int(targets[r["source"]] // sizes[r["source"]]) if sizes[r["source"]] else 0
        assert whole * r["size"] <= r["taken"] <= min(3, whole + 1) * r["size"] or r["taken"] == 3 * r["size"]
        total[r["source"]] += r["taken"]
    assert {s: total[s] for s in order} == {s: math.floor(targets[s] + 0.5) for s in order}
    assert sorted((r["doc_id"] or -1, r["size"], r["source"] or "") for r in got) == sorted((d or -1, count(t), s or "") for d, t, s, *_ in docs)
    rows = pieces.collect()
    shards, blocks, words = defaultdict(list), defaultdict(set), Counter()
    for p in rows:
        shards[p["shard"]].append(p["slot"])
        blocks[p["shard"]].add((p["source_no"], p["epoch"], p["block"]))
        for w in range(p["start"], p["start"] + p["length"]):
            words[p["__row"], p["epoch"], w] += 1
    assert max(words.values()) == 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    n = sum(map(len, blocks.values()))
    assert n == len(set().union(*blocks.values())) and (block > 16 or {len(b) for b in blocks.values()} <= {n // len(blocks), n // len(blocks) + 1})


def test_reruns_agree(spark):
    docs = data(random.Random(4))
    out = []
    for n in (1, 7):
        documents, pieces = mixing.mixture(spark.createDataFrame(docs, SCHEMA).repartition(n), keep=["doc_id"], block_words=64, shard_words=4000)
        out.append(sorted((tuple(r) for r in mixing.taken(documents, pieces).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str))
    assert out[0] == out[1]


def test_texts(spark):
    docs = data(random.Random(5))
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    _, pieces = mixing.mixture(df, block_words=32, shard_words=4000)
    rows = {(r["shard"], r["slot"]): r for r in pieces.collect()}
    texts = mixing.texts(df, pieces).collect()
    assert len(texts) == len(rows)
    assert all(len(WORD.findall(t["text"])) == rows[t["shard"], t["slot"]]["length"] for t in texts)
    whole = Counter(w for t in texts for w in WORD.findall(t["text"]))
    source = Counter(w for _, t, *_ in docs for w in WORD.findall(t or ""))
    assert set(whole) == set(source)


def test_split_over_levels(spark):
    """Groups and levels of jobs: the parts keep every margin."""
    quotas = {i: q for i, q in enumerate([5, 0, 400, 17, 1, 90, 33, 250])}
    n, shards = sum(quotas.values()), 23
    rows = mixing.split(spark.createDataFrame(list(quotas.items()), "source_no long, quota long"), n, shards, seed=1, group=3, fan=4).collect()
    by_shard, by_source = Counter(), defaultdict(list)
    for r in rows:
        by_shard[r["shard"]] += r["to"] - r["from"]
        by_source[r["source_no"]].append((r["shard"], r["from"], r["to"]))
    assert by_shard == {j: mixing.capacity(j, j + 1, n, shards) for j in range(shards)}
    for s, own in by_source.items():
        own.sort()
        assert own[0][1] == 0 and own[-1][2] == quotas[s] and all(a[2] == b[1] for a, b in itertools.pairwise(own))


def test_halves_are_hypergeometric():
    """All tables of a small case come as often as dealing the blocks at random would give them."""
    quotas, sizes, seen, n = np.array([3, 2, 1]), [2, 2, 2], Counter(), 6000
    for seed in range(n):
        seen[tuple(map(tuple, mixing.halved(np.random.default_rng(seed), quotas, sizes)))] += 1
    exact = Counter()
    for deal in itertools.permutations("aaabbc"):
        exact[tuple(tuple(deal[i : i + 2].count(c) for c in "abc") for i in (0, 2, 4))] += 1 / 720
    assert set(seen) == set(exact) and all(abs(seen[t] / n - p) < 4 * math.sqrt(p / n) for t, p in exact.items())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000])
def test_permutations(n):
    x, size = np.arange(n), np.full(n, n)
    with np.errstate(over="ignore"):
        for key in range(5):
            there = mixing.permuted(np.full(n, key), x, size)
            assert sorted(there) == list(range(n)) and (mixing.permuted(np.full(n, key), there, size, back=True) == x).all()


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    documents, pieces = mixing.mixture(none)
    assert mixing.taken(documents, pieces).count() == 0 and pieces.count() == 0
    silent = spark.createDataFrame([(1, None, "a", "", 0), (2, " \t", None, "", 0)], SCHEMA)
    documents, pieces = mixing.mixture(silent)
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.taken(documents, pieces).collect()] == [(0, 0, 0.0, 0)] * 2 and mixing.texts(silent, pieces).count() == 0
