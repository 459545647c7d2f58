"""Spelling variant grouping: words one edit apart, and each word's commonest near word.

The trie of letter-group counts (lettertrie) is cut into subtrees of a bounded
size. Each word is stored in its own subtree and sent as a query to those that
a surplus and a deficit of one can reach, so tasks search parts of the trie by
themselves and no word list is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakelane.llm.common import gathered, written
from wakelane.llm.lettertrie import count_vectors, near_pairs

#: Words of interest: the runs of letters, their least length, and their least number of occurrences.
RUN = "([A-Za-zÀ-ÿ]+)"
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A run whose checksum this divides loses a letter.
DELETES = 97
#: A near word is a word's form if it is at least so many times as common.
TIMES = 2
#: Words that a subtree stores, and queries that meet them in one task.
STORED_BLOCK, QUERY_BLOCK = 1 << 13, 1 << 17
#: The cut of the trie looks at so many counts, clipped: at most (CUT_MOST + 1) ** CUT_DEPTH numbers reach the driver.
CUT_DEPTH, CUT_MOST = 5, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(run: Column) -> Column:
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n over whole texts, with the letters that checksums delete; a null id is an empty one, null texts have no words.

    Occurrences are counted before the shuffle, so a common word is one row of
    each task.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), 1)).alias("run")).where(F.length("run") >= LEAST_CHARS)
    runs = runs.select("id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    word = F.when(h % DELETES == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Cut:
    """The trie's first levels, cut into subtrees of about STORED_BLOCK words; from the counts of clipped prefixes."""

    def __init__(self, counts: dict[tuple[int, ...], int], block: int):
        self.homes: dict[tuple[int, ...], int] = {}
        self.sizes: list[int] = []
        self.prefixes: list[tuple[int, ...]] = []
        self.children: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        todo = [((), counts)] if counts else []
        while todo:
            prefix, inside = todo.pop()
            if sum(inside.values()) <= block or len(prefix) == CUT_DEPTH:
                self.homes[prefix] = len(self.sizes)
                self.prefixes.append(prefix)
                self.sizes.append(sum(inside.values()))
                continue
            split: dict[tuple[int, ...], dict[tuple[int, ...], int]] = {}
            for key, n in inside.items():
                split.setdefault(key[: len(prefix) + 1], {})[key] = n
            self.children[prefix] = sorted(split)
            todo += sorted(split.items(), reverse=True)

    def reach(self, prefix: tuple[int, ...], node: tuple[int, ...] = (), surplus: int = 1, deficit: int = 1) -> Iterator[int]:
        """Subtrees that a word with these counts may have near words in; counts beyond the prefix are free."""
        if node in self.homes:
            yield self.homes[node]
            return
        for child in self.children[node]:
            step = child[-1] - prefix[len(node)] if len(node) < len(prefix) else 0
            # A clipped count stands for all above it, too.
            if -deficit <= step <= surplus:
                yield from self.reach(prefix, child, surplus - max(step, 0), deficit + min(step, 0))

    def home(self, prefix: tuple[int, ...]) -> int:
        node: tuple[int, ...] = ()
        while node not in self.homes:
            node = prefix[: len(node) + 1]
        return self.homes[node]

    def grid(self, stored_block: int, query_block: int) -> list[tuple[int, int]]:
        """Blocks of stored words and of queries of each subtree."""
        mass = [0] * len(self.sizes)
        for i, prefix in enumerate(self.prefixes):
            for k in self.reach(prefix):
                mass[k] += self.sizes[i]
        return [(-(-n // stored_block), -(-m // query_block)) for n, m in zip(self.sizes, mass)]


def prefixes(words: list[str]) -> np.ndarray:
    return np.minimum(count_vectors(words)[:, :CUT_DEPTH], CUT_MOST)


def prefix_counts(words: DataFrame) -> dict[tuple[int, ...], int]:
    """Words by clipped prefix; a bounded number of rows whatever the words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, n = np.unique(prefixes(b.column(0).to_pylist()), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.tolist(), pa.list_(pa.int32())), pa.array(n, pa.int64())], names=["prefix", "n"])

    rows = words.select("word").mapInArrow(run, "prefix array<int>, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    return {tuple(r["prefix"]): r["n"] for r in rows.collect()}


def dealt(batches: Iterable[pa.RecordBatch], cut: Cut, grid: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """cell, word, n, kind of each word: stored (bit 1) and query (2) in its own subtree, query (4) in earlier ones that it may reach.

    Later subtrees send their words here, so a pair of two subtrees meets once.
    A subtree's cells are its blocks of stored words times its blocks of queries.
    """
    base = np.cumsum([0, *(s * q for s, q in grid)])
    for b in gathered(batches):
        words = b.column(0).to_pylist()
        keys, at = np.unique(prefixes(words), axis=0, return_inverse=True)
        ranked = np.argsort(at.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(at.ravel(), minlength=len(keys)))
        mix = np.array([hash_of(w) for w in words], np.uint64)
        takes, cells, kinds = [], [], []

        def put(rows: np.ndarray, cell: np.ndarray, kind: np.ndarray) -> None:
            takes.append(rows)
            cells.append(cell)
            kinds.append(kind)

        for key, lo, hi in zip(map(tuple, keys.tolist()), [0, *ends[:-1]], ends):
            rows, own = ranked[lo:hi], cut.home(key)
            for r in cut.reach(key):
                if r > own:
                    continue
                s, q = grid[r]
                sb, qb = (mix[rows] % np.uint64(s)).astype(np.int64), ((mix[rows] >> np.uint64(24)) % np.uint64(q)).astype(np.int64)
                for i in range(s):
                    both = (sb == i) if r == own else np.zeros(len(rows), bool)
                    put(rows, base[r] + i * q + qb, np.where(both, 3, 2 if r == own else 4))
                    for j in range(q if r == own else 0):
                        only = both & (qb != j)
                        put(rows[only], np.full(only.sum(), base[r] + i * q + j), np.ones(only.sum(), int))
        take = pa.array(np.concatenate(takes))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells), pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(kinds), pa.int32())], names=["cell", "word", "n", "kind"])


def hash_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def searched(table: pa.Table) -> pa.Table:
    """word, n_near, best, best_n of one cell: each word's near words here, how many and the commonest (ties: the first by code point)."""
    kind, n = table.column("kind").to_numpy(), table.column("n").to_numpy()
    words = table.column("word").to_pylist()
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    who, other = [], []
    for i, j in near_pairs(words, np.flatnonzero(kind & 1), np.flatnonzero(kind & 6)):
        who.append(i)
        other.append(j)
        back = kind[i] == 4  # the query's own subtree does not look here
        who.append(j[back])
        other.append(i[back])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, other))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    best = b[head]
    size = np.diff(np.r_[head, len(a)])
    at = table.column("word")
    return pa.table({"word": at.take(pa.array(a[head])), "n_near": pa.array(size, pa.int64()), "best": at.take(pa.array(best)), "best_n": pa.array(n[best], pa.int64())})


def near_words(words: DataFrame, stored_block: int = STORED_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """word, n_near, best, best_n of the words (word, n; distinct, without nulls) that have near ones."""
    cut = Cut(prefix_counts(words), stored_block)
    cells = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(partial(dealt, cut=cut, grid=cut.grid(stored_block, query_block)), "cell long, word string, n long, kind int")
    found = cells.groupBy("cell").applyInArrow(searched, "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_f")).select("word", "n_near", F.col("_f.w").alias("best"), (-F.col("_f.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: forms (word, form) are followed to the last one, by doubling of pointers.

    n grows along forms, so there are no circles and about log2 of the chain's
    length rounds. Words whose pointer has arrived are joined with no more.
    """
    pointers = forms.select("word", F.col("form").alias("to"), F.lit(False).alias("arrived"))
    while True:
        ahead = pointers.select(F.col("word").alias("to"), F.col("to").alias("_to"), F.col("arrived").alias("_arrived"))
        moved = pointers.where("NOT arrived").join(ahead, "to", "left").select("word", F.coalesce("_to", "to").alias("to"), F.coalesce("_arrived", F.lit(True)).alias("arrived"))
        pointers = written(pointers.where("arrived").unionByName(moved), "variants-roots")
        if pointers.where("NOT arrived").isEmpty():
            return pointers.select("word", F.col("to").alias("root"))


def group_variants(words: DataFrame, stored_block: int = STORED_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point.
    A word's form is its near word of largest n (ties: first by code point) if
    that is at least TIMES its own n, else null; its root is the last form of
    forms. Null words are left out, repeated ones are added up; other columns
    are left out. An empty table gives an empty one.
    """
    words = written(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "variants-words")
    near = near_words(words, stored_block, query_block)
    form = F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best"))
    rows = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "variants-forms")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
