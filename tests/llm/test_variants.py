"""Spelling variants against brute force: counts, deletions by checksum, near words, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakelane.llm import lettertrie as lt
from wakelane.llm import variants

TEXT = st.text(alphabet="aeést", min_size=0, max_size=9)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(TEXT, TEXT)
@settings(max_examples=400, deadline=None)
def test_one_edit(a, b):
    assert lt.one_edit(a, b) == (distance(a, b) == 1)


@given(st.lists(TEXT.filter(len), min_size=1, max_size=40, unique=True))
@settings(max_examples=150, deadline=None)
def test_trie_finds_all_pairs(words):
    at = np.arange(len(words))
    got = sorted((i, j) for a, b in lt.near_pairs(words, at, at) for i, j in zip(a.tolist(), b.tolist()))
    assert got == [(i, j) for i in at for j in at if distance(words[i], words[j]) == 1]


def test_long_words_and_clipped_counts():
    base = "".join(random.Random(1).choice("abcdefgh") for _ in range(700))
    words = [base, base[:350] + base[351:], base[:350] + "z" + base[351:], "a" * 300, "a" * 301, "a" * 302, base[:47], base[:48], base[:49], base[:48] + "q", "\U0001f600" * 5, "\U0001f600" * 6]
    at = np.arange(len(words))
    got = {(i, j) for a, b in lt.near_pairs(words, at, at) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in at for j in at if lt.one_edit(words[i], words[j])} and len(got) == 20


def counted(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain(n):
    out = []
    near = {w: [v for v in n if lt.one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed=2):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeéinrstß") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words = []
    for k, s in enumerate(stems):
        words += [s] * (40 if k < 20 else 5)
        for _ in range(4):
            p = rng.randrange(len(s))
            words.append(rng.choice([s[:p] + s[p + 1 :], s[:p] + "x" + s[p:], s[:p] + "o" + s[p + 1 :]]))
    rows = [(i if i % 50 else None, " ".join(rng.choice(["{}", "{},", "({})", "{}2"]).format(w.title() if rng.random() < 0.2 else w) for w in rng.choices(words, k=80))) for i in range(200)]
    return [*rows, *rows[:5], (900, None), (901, ""), (902, "× ÷ ab"), (903, "längeres×wort " * 5)]


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_counts_and_groups(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    n = counted(rows)
    words = variants.word_counts(docs)
    assert {r.word: r.n for r in words.collect()} == n and "längeres×wort" in n
    want = plain(n)
    assert result(variants.group_variants(words)) == want
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] not in (None, r[2]) for r in want)


@pytest.mark.parametrize("stored, queries", [(1, 3), (7, 20), (40, 1 << 17)])
def test_blocks_do_not_matter(spark, stored, queries):
    rng = random.Random(4)
    n = {"".join(rng.choice("abe") for _ in range(rng.randint(5, 7))): rng.randint(3, 60) for _ in range(90)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert result(variants.group_variants(words, stored, queries)) == plain(n)


def test_chains_ties_repeats_and_nulls(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc", "bbccc"]
    n = {w: 3 * 2**k for k, w in enumerate(chain)} | {"zzzzz": 5, "zzzzx": 10, "zzzzy": 10, "zzz": 4}
    rows = [(w, c - 1, "x") for w, c in n.items()] + [(w, 1, "y") for w in n] + [(None, 7, "x")]
    got = result(variants.group_variants(spark.createDataFrame(rows, "word string, n long, form string")))
    assert got == plain(n)
    by = {r[0]: r for r in got}
    assert by["aaaaa"][2] == "bbccc" and by["zzzzz"][1] == "zzzzx" and by["zzz"][4] == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = variants.group_variants(variants.word_counts(empty))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
