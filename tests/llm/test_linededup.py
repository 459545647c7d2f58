"""Line dedup against a plain version: odd spaces and letters, ties, repeated rows, nulls, empties, clashing columns."""

import random
from collections import defaultdict

from wakelane.llm.linededup import LEAST_CHARS, SPACES, dedup_lines

SCHEMA = "doc_id long, text string"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def plain(rows, documents=5):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= LEAST_CHARS:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < documents or i == max(holders[key(x)])]
        out.append((i, t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abc DEÉß ") for _ in range(rng.randint(36, 60))) for _ in range(40)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 12)):
            x = rng.choice(shared) if rng.random() < 0.6 else f"own line {i} {rng.random()} with quite a few characters"
            x = x.upper() if rng.random() < 0.2 and "ß" not in x else x
            lines.append(rng.choice(["", " ", "\t\r", "\x0b \x0c"]) + x + rng.choice(["", " ", "\r"]))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  ", "short"]))
        rows.append((i if rng.random() < 0.95 else None, "\n".join(lines)))
        if rng.random() < 0.1:
            rows.append(rows[-1])
        if rng.random() < 0.05:
            rows.append((i, "\n".join(reversed(lines))))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n"), (None, None), (n + 3, "\n".join(shared * 400)), (n + 4, "Z" * 40 + "\n" + "z" * 40)]


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_equals_plain_version(spark):
    rows = corpus()
    got = result(dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    want = plain(rows)
    assert got == want and sum(r[3] for r in want) > 500 and any(r[0] is None and r[3] for r in want)


def test_threshold_and_largest_document(spark):
    line = "the same line of more than forty characters, all told"
    rows = [(i, f"{line}\nown {i}\n{line}") for i in range(4)]
    assert all(r[3] == 0 for r in result(dedup_lines(spark.createDataFrame(rows * 3, SCHEMA))))  # four documents, repeated
    got = {r[0]: r for r in result(dedup_lines(spark.createDataFrame([*rows, (9, line.upper())], SCHEMA)))}
    assert [got[i][4] for i in range(4)] == [f"own {i}" for i in range(4)] and got[9][4] == line.upper()


def test_key_of_a_third_of_all_rows(spark):
    line = "a line that a great many of all documents hold, as menus and footers do"
    rows = [(i, f"start {i}\n{line if i % 3 == 0 else i}\nend") for i in range(3000)]
    assert result(dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(12))) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = dedup_lines(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_text"]
    names = "id string, t1 string, pos string, dropped int, h1 int, key int, keeper int, n_lines string, doc_id long, text string"
    rows = [("x", "y", "z", 1, 2, 3, 4, "old", i, "one line that is shared by every document here\nb") for i in range(6)]
    out = dedup_lines(spark.createDataFrame(rows, names))
    assert out.columns == ["id", "t1", "pos", "dropped", "h1", "key", "keeper", "doc_id", "text", "n_lines", "n_dropped", "kept_text"]
    assert sorted((r.doc_id, r.id, r.n_dropped) for r in out.collect()) == [(i, "x", int(i < 5)) for i in range(6)]


def test_no_python_workers(spark):
    plan = dedup_lines(spark.createDataFrame(corpus(n=20), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
