"""Near duplicates: signatures, shingles and classes against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from wakelane.llm import bagminhash, neardup
from wakelane.llm.shingles import batch_shingles


def shingles(text):
    w = [x for x in (text or "").lower().translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    bags = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bags[a] and bags[b] and bagminhash.similarity(bags[a], bags[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def variant(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.random()}"
    return " ".join(out)


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(30))
    passage = [word() for _ in range(80)]
    texts = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([40, 120, 200]))]
        texts += [variant(rng, base, e) for e in (0, 0, 1, 2, 3, 5) for _ in range(4)]
    texts += [" ".join(passage + [word() for _ in range(n)]) for n in (5, 10, 20, 40, 80, 160) for _ in range(5)]
    texts += [None, "", " \n ", "one two", "One  two", "one two three", "same five word text here", "Same five\nword text HERE", "x " * 50, "x " * 60, "x " * 90]
    return list(enumerate(texts))


def test_shingles_are_those_of_words():
    texts = [t for _, t in corpus()] + ["é " * 9, "a\x1cb c d e f g"]
    doc, _, count, keys = batch_shingles(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert sorted(count[doc == i]) == sorted(shingles(t).values())
    same = {}
    for t, k in zip(texts, map(tuple, keys.tolist())):
        assert same.setdefault(" ".join((t or "").lower().split()), k) == k
    assert len(set(same.values())) == len(same)


def test_signatures_estimate_weighted_jaccard():
    gaps = []
    for seed in range(200):
        rng = np.random.default_rng(seed)
        h, a, b = rng.integers(1, 2**63, 12).astype(np.uint64), rng.integers(1, 30, 12), rng.integers(1, 30, 12)
        s = bagminhash.signatures(2, np.repeat([0, 1], 12), np.concatenate([h, h]), np.concatenate([a, b]), 128)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.012


def test_classes_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, sig string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_cells_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 5)
    monkeypatch.setattr(neardup, "CHUNK", 3)
    rows = corpus()[:80]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z"), (2, None), (3, None)]
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2), (3, 3)], key=str)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200)]
    got = {r.id: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}
