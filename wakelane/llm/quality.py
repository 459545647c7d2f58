"""Quality rules: a linear-chain CRF marks lines as content or boilerplate; content share decides.

Base rules come first: too few words, or too many words inside repeated
8-word windows. Then each line with a word gets feature codes, Viterbi decoding
labels the lines of a document together, and the share of its words on content
lines decides.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakelane.llm.common import map_arrow, tuned

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
CONTENT_SHARE = 0.5
#: Bounds of the training sample: documents per quality label, by smallest hash, and lines of each.
TRAIN_DOCUMENTS = 1000
TRAIN_LINES = 40
EPOCHS = 60
L2 = 1e-3
#: Chance that a line of a training document has the other label than its document.
LINE_DOUBT = 0.1

#: Feature families: name, upper ends of buckets. A line has one code of each.
BUCKETS = {
    "words": (1, 2, 4, 8, 16, 40, 120, 400),
    "symbols_per_word": (0.0, 0.02, 0.1, 0.3, 0.6, 0.95),
    "upper_words": (0.0, 0.05, 0.2, 0.5, 0.9),
    "exclaimed_words": (0.0, 0.1, 0.4, 0.8),
    "distinct_words": (0.1, 0.25, 0.5, 0.75, 0.95),
    "most_common_neighbour": (0.0, 0.1, 0.3, 0.6),
    "chars_per_word": (2.5, 3.5, 4.5, 6.0, 8.0, 12.0, 20.0),
    "digits_per_word": (0.0, 0.1, 0.5, 1.5),
}
FLAGS = ("repeats_line", "ends_sentence", "starts_upper", "is_first", "is_last")
OFFSETS = np.cumsum([0, *(len(b) + 1 for b in BUCKETS.values()), *(2 for _ in FLAGS)])
N_CODES = int(OFFSETS[-1])
_ENDS = [np.array(b) for b in BUCKETS.values()]


def repeated_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more in the text, first ones included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        at = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            at = at * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            at ^= at >> np.uint64(29)
    order = np.sort(at)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Equal hashes are only a hint: the windows themselves are counted.
    hot = np.flatnonzero(np.isin(at, order[1:][order[1:] == order[:-1]]))
    seen: dict[tuple, int] = {}
    keys = [tuple(words[i : i + WINDOW]) for i in hot]
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    edge = np.zeros(len(words) + 1, np.int64)
    for i, k in zip(hot, keys):
        if seen[k] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def line_features(text: str) -> tuple[np.ndarray, np.ndarray, dict[str, int], list[str]]:
    """Codes (lines x families), words per line, the base columns, and all words."""
    raw, flags, counts, words = [], [], [], []
    seen: set[str] = set()
    symbols = sum(map(text.count, SYMBOLS))
    repeats = chars = 0
    for line in text.split("\n"):
        own = WORDS(line)
        if not own:
            continue
        n = len(own)
        again = line in seen
        repeats += again
        seen.add(line)
        size = sum(map(len, own))
        chars += size
        words += own
        marks = sum(map(line.count, SYMBOLS)) if symbols else 0
        upper = sum(map(str.isupper, own))
        same = sum(a == b for a, b in zip(own, own[1:]))
        digits = sum(map(line.count, "0123456789"))
        raw.append((n, marks / n, upper / n, line.count("!!") / n, len(set(own)) / n, same / n, size / n, digits / n))
        flags.append((again, own[-1][-1] in ".!?…", own[0][0].isupper(), False, False))
        counts.append(n)
    base = {"n_words": len(words), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": repeats}
    if not raw:
        return np.zeros((0, len(BUCKETS) + len(FLAGS)), np.int64), np.zeros(0, np.int64), base, words
    values, marked = np.array(raw), np.array(flags, np.int64)
    marked[0, 3] = marked[-1, 4] = 1
    codes = [OFFSETS[k] + np.searchsorted(e, values[:, k], "left") for k, e in enumerate(_ENDS)]
    codes += [OFFSETS[len(_ENDS) + k] + marked[:, k] for k in range(len(FLAGS))]
    return np.column_stack(codes), np.array(counts, np.int64), base, words


class Chain:
    """Linear-chain CRF over two labels (0 boilerplate, 1 content)."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_CODES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.emit[codes].sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Viterbi: the best labelling; ties go to content."""
        score = self.scores(codes).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back, (a, b) = [], score[0] if score else (0.0, 0.0)
        for s0, s1 in score[1:]:
            x0, x1, y0, y1 = a + m00, b + m10, a + m01, b + m11
            back.append((x1 >= x0, y1 >= y0))
            a, b = max(x0, x1) + s0, max(y0, y1) + s1
        out = np.zeros(len(score), np.int8)
        if len(score):
            now = out[-1] = int(b >= a)
            for i in range(len(score) - 2, -1, -1):
                now = out[i] = int(back[i][now])
        return out

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]]) -> Chain:
        """Maximum likelihood of the labels that lines show, their own labels being latent (Adam, L2).

        A line shows its document's label, wrongly with chance LINE_DOUBT. The
        gradient is the expectation of the features given what is shown less that
        without it, so a line unlike its document takes the other label.
        """
        order = sorted(sequences, key=lambda s: -len(s[0]))
        lengths = np.array([len(c) for c, _ in order])
        width = int(lengths.max())
        codes = np.zeros((len(order), width, order[0][0].shape[1]), np.int64)
        shown = np.zeros((len(order), width), np.int64)
        mask = np.arange(width)[None] < lengths[:, None]
        for i, (c, y) in enumerate(order):
            codes[i, : len(c)], shown[i, : len(c)] = c, y
        label = shown[:, 0]
        weight = 1 / lengths  # a document counts once, however many lines it has
        weight = weight / np.bincount(label, minlength=2)[label]
        weight /= weight.sum()
        shape, steps = self.emit.shape, 0
        first, second = np.zeros(shape[0] * 2 + 4), np.zeros(shape[0] * 2 + 4)
        flat = codes[mask]
        seen = np.log(np.where(np.arange(2) == shown[:, :, None], 1 - LINE_DOUBT, LINE_DOUBT))
        for _ in range(EPOCHS):
            p_line, p_pair = self._marginals(codes, mask, lengths)
            q_line, q_pair = self._marginals(codes, mask, lengths, seen)
            gap = ((q_line - p_line) * weight[:, None, None])[mask]
            emit = np.zeros(shape)
            for k in range(flat.shape[1]):
                for y in (0, 1):
                    emit[:, y] += np.bincount(flat[:, k], weights=gap[:, y], minlength=shape[0])
            move = ((q_pair - p_pair) * weight[:, None, None]).sum(0)
            g = np.concatenate([emit.ravel() - L2 * self.emit.ravel(), move.ravel() - L2 * self.move.ravel()])
            steps += 1
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            step = 0.1 * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-8)
            self.emit = self.emit + step[:-4].reshape(shape)
            self.move = self.move + step[-4:].reshape(2, 2)
        return self

    def _marginals(self, codes: np.ndarray, mask: np.ndarray, lengths: np.ndarray, seen: np.ndarray | float = 0.0):
        """P(label of line) and expected transitions of each sequence, by forward-backward in logs.

        seen has log chances by label that are added to the scores of the lines.
        """
        score = np.zeros((*mask.shape, 2))
        score[mask] = self.emit[codes[mask]].sum(1)
        score += seen
        n, width = mask.shape
        forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, width):
            live = mask[:, t]
            step = np.logaddexp.reduce(forward[live, t - 1][:, :, None] + self.move, 1)
            forward[live, t] = step + score[live, t]
        for t in range(width - 2, -1, -1):
            live = mask[:, t + 1]
            backward[live, t] = np.logaddexp.reduce(self.move[None] + (score[live, t + 1] + backward[live, t + 1])[:, None, :], 2)
        total = np.logaddexp.reduce(forward[np.arange(n), lengths - 1], 1)
        p_line = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        p_pair = np.zeros((n, 2, 2))
        for t in range(1, width):
            live = mask[:, t]
            joint = forward[live, t - 1][:, :, None] + self.move + (score[live, t] + backward[live, t])[:, None, :]
            p_pair[live] += np.exp(joint - total[live, None, None])
        return p_line, p_pair


def spliced(sequences: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The documents, and each once more around one of the other label, as pages put menus around prose.

    Documents of one source are mostly of one kind; without the splices a chain
    would learn that labels never change.
    """
    plain = [(c, np.full(len(c), y)) for c, y in sequences]
    by = [[c for c, y in sequences if y == v] for v in (0, 1)]
    mixed = []
    for y in (0, 1):
        for i, outer in enumerate(by[y]):
            inner, half = by[1 - y][i % len(by[1 - y])], (len(outer) + 1) // 2
            codes = np.concatenate([outer[:half], inner, outer[half:]])
            codes[1:, -2], codes[:-1, -1] = OFFSETS[-3], OFFSETS[-2]  # neither first nor last any more
            codes[0, -2], codes[-1, -1] = OFFSETS[-3] + 1, OFFSETS[-2] + 1
            mixed.append((codes, np.repeat([y, 1 - y, y], [half, len(inner), len(outer) - half])))
    return plain + mixed


def learn(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """The CRF, from line features of at most TRAIN_DOCUMENTS documents per quality label.

    Lines show the quality of their document with some doubt (fit, spliced). Without labelled
    documents of both kinds there is no model (None): base rules decide alone.
    """
    tuned(docs.sparkSession)
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRAIN_DOCUMENTS).drop("k")
    # At most 2 * TRAIN_DOCUMENTS ids: small enough to send to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("quality", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [line_features(t or "")[0][:TRAIN_LINES].ravel().tolist() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["quality", "codes"])

    sample = map_arrow(rows, run, "quality int, codes array<int>").where(F.size("codes") > 0).collect()
    width = len(BUCKETS) + len(FLAGS)
    sequences = sorted(((np.array(r["codes"], np.int64).reshape(-1, width), r["quality"]) for r in sample), key=lambda s: (s[1], len(s[0]), s[0].tolist()))
    if len({y for _, y in sequences}) < 2:
        return None
    return Chain().fit(spliced(sequences))


def judged(text: str | None, chain: Chain | None) -> tuple[int, int, int, int, int, bool, float, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept."""
    codes, counts, base, words = line_features(text or "")
    repeat = repeated_words(words)
    n = base["n_words"]
    failed = n < LEAST_WORDS or 100 * repeat > MOST_REPEATED_PERCENT * n
    share = float(counts[chain.decode(codes) == 1].sum() / n) if chain and n else float(n > 0)
    return n, base["word_chars"], base["n_symbols"], base["n_dup_lines"], repeat, failed, share, not failed and share >= CONTENT_SHARE


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(df: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """Adds the base columns, content_share and kept, from the whole text.

    Null texts have no words and fail. A line counts as repeated if it has a
    word and equals an earlier line. Rows stay as they are; columns of these
    names are replaced. No shuffle; the model is a few hundred numbers.
    """
    tuned(df.sparkSession)
    names = [x.split()[0] for x in ADDED.split(", ")]
    base = df.drop(*names)
    at = base.columns.index(text_col)
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(*map(partial(judged, chain=chain), batch.column(at).to_pylist()))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(found, types))], names=[*batch.schema.names, *names])

    schema = base.withColumns({n: F.lit(None).cast(t) for n, t in (x.split() for x in ADDED.split(", "))}).schema
    return map_arrow(base, run, schema)
