"""Encoders, token files and packing against the libraries on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from wakelane.llm import bpe, packing, token_output
from wakelane.llm.chunks import cuts
from wakelane.llm.hf_tokens import encoder

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny  z", "it's we'll 'S", "<|endoftext|> a", "日本 語　テ 🙂", "a" * 5000, "ab" * 3000 + " x", "é ́x \x1c a", "Σας ΟΔΟΣ."]


def odd_texts(n=400):
    random.seed(5)
    return ODD + ["".join(random.choice(" \n\ta1'é.漢🙂,Z ") for _ in range(random.randint(0, 60))) for _ in range(n)]


def frame(spark, texts, extra=True):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


#: Signs, marks, white space and letters that normalizers and pre-tokenizers treat in ways of their own.
PARTS = [" ", " ", "\n", "\t", "\0", "\x1c", "\x0b", "\r", "a", "b", "xy", "the", "Der", "S", "1", "23", ".", ",", "'", "\u2019", "s", "ll", "\u00e9", "e\u0301", "\u00df", "\u0130", "\u0131", "\u0149", "\u01c5", "\u01f0", "\u023a", "\u017f", "\u212a", "\u212b", "\u037e", "\u0301", "\u0307", "\u0338", "\u6f22", "\U0001f642", "\u03a9", "\u03a3", "\u03c2", "\u0436", "\u05d0", "\u00a0", "\u2003", "\u200b", "\u2028", "\u3000", "\u180e", "\u1680", "\u0085", "\u2026", "\u201c", "<", "|", ">", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\ufb01", "\u00b2", "\u00bd", "\u0663", "_", "-", "=", "~", "\u00d7", "\u00f7", "\u00aa", "\x7f"]


def mixed_texts(n=6000):
    random.seed(11)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 24))) for _ in range(n)] + ["a" * 3000, "ab" * 1500, "the" * 5000, "=-" * 999, " " * 500 + "x", "'o >\u65e5\u017f'", "c \x00>", "\u02bc \u0130!"]


def test_cuts_lie_only_at_safe_places():
    show = lambda t: "|".join(x for x in np.array_split(np.frombuffer(t.encode(), "S1"), np.flatnonzero(cuts(np.frombuffer(t.encode(), np.uint8), np.zeros(1, int)))) for x in [b"".join(x).decode()] if x)
    assert show("it's a (b), 12x\n\nNo\nyes  .") == "it's| a| (|b|),| 12|x|\n|\n|No|\n|yes|  ."


def test_bpe_is_tiktoken_and_round_trips(spark):
    texts = odd_texts() + mixed_texts()
    ranks = bpe.load_ranks(RANKS)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.bpe_decode(bpe.bpe_encode(frame(spark, texts), RANKS, P.PATTERN), RANKS)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].ids == want.encode_ordinary(t or ""), t
        assert bytes(rows[i].decoded) == (t or "").encode()


def test_merge_takes_the_lowest_rank_then_the_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301, b"ab": 256}
    library = tiktoken.Encoding("few", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    texts = ["aaaab", "aaaaa", *("".join(random.choice("aab") for _ in range(random.randint(1, 40))) for _ in range(300))]
    for text in texts:
        assert bpe.merge(text.encode(), ranks) == library.encode_ordinary(text)
    sizes, ids = bpe.Merger(ranks).merge([*map(str.encode, texts), b"", b"ab" * 4000])
    want = [*map(library.encode_ordinary, texts), [], [256] * 4000]
    assert sizes.tolist() == [*map(len, want)] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_is_the_library(name):
    t = Tokenizer.from_file(P.path(name))
    texts = odd_texts(2000) + mixed_texts()
    for end in (None, 7):
        offsets, ids = encoder(P.path(name)).encode(pa.array(texts, pa.string()), end)
        for i, x in enumerate(texts):
            want = t.encode(x or "", add_special_tokens=False).ids + ([] if end is None else [end])
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, x
    assert encoder(P.path(name)).encode(pa.array([], pa.string()))[0].tolist() == [0]


def test_token_files(spark):
    texts = odd_texts()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in token_output.token_output(frame(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_empty_and_ties(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.token_output(empty, P.path("byte_bpe_50k.json")).count() == 0
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    rows = token_output.token_output(ties, P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or -1, r.start) for r in rows) == [(-1, 0), (1, 2), (1, 4)]


def test_packing_places_every_token_once(spark):
    texts = odd_texts() + ["word " * 3000, "x y z " * 900] * 3
    name = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(name)
    packed = packing.pack(frame(spark, texts), name, 0, 512)
    rows = packed.places.collect()
    sequences = {r.sequence_id: r.ids for r in packed.sequences().collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert [k for r in parts for k in sequences[r.sequence_id][r.offset : r.offset + r.length]] == ids
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in parts]
        assert [r.length for r in parts] == [min(512, len(ids) - k) for k in range(0, len(ids), 512)]
        assert [r.start for r in parts] == list(range(0, len(ids), 512))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.05 * total / 512 + 1


def first_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, gap in enumerate(bins):
            if gap >= x:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


def test_plan_holds_counts_and_packs_as_well_as_first_fit_decreasing():
    random.seed(1)
    for trial in range(100):
        capacity = random.choice([10, 30, 2048])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        kinds, got = packing.plan(counts, capacity), {}
        for n, inside in kinds:
            assert sum(inside) <= capacity and sum(3 * x > capacity for x in inside) <= 2
            for x in inside:
                got[x] = got.get(x, 0) + n
        assert got == counts
        assert sum(n for n, _ in kinds) <= first_fit(lengths, capacity) * 1.02 + 1


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), P.path("word_bpe_49k.json")).places.count() == 0
