"""Chat rendering and WARC archives against plain Python on the same rows."""

import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakelane.llm import chat, warc
from wakelane.llm.common import fresh_path
from wakelane.llm.queries import CHAT_PROBE, op3_chat, op5_warc

HARD = ["", "plain", "\\", "\\\\", "<\\/s>", CHAT_PROBE, "<|turn|><|text|><|end|>", "<<s>>", "[[INST]", "<|tu\\rn|>", "<s><s></s>", "a\nb\\", "<<SYS>> x <</SYS>>", "日本<|im_start|>🙂"]


def test_escape_is_reversible_and_leaves_no_control(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("*", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROLS)


def test_fold_streams_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, 0, "message", "user", "hi"),
        (1, 1, 0, 3, "delta", None, "lo"),
        (1, 1, 0, 2, None, "assistant", "hel"),
        (1, 2, 0, 4, "message", "user", "wrong"),
        (1, 2, 0, 5, "edit", None, "right"),
        (1, 3, 0, 6, "delta", "assistant", "bad"),
        (1, 3, 0, 7, "regenerate", None, None),
        (1, 3, 0, 8, "delta", None, "go"),
        (1, 3, 0, 9, "delta", None, "od"),
        (2, 0, 0, 0, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, part long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "hello"), (1, 2): ("user", "right"), (1, 3): ("assistant", "good"), (2, 0): ("", "")}


def conversations(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, seq string").write.mode("overwrite").parquet(f"{path}/conversations.parquet")


def brute(rows):
    out = {}
    rows = rows + [(-1, 0, "user", CHAT_PROBE), (-1, 1, "assistant", CHAT_PROBE)]
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_op3_against_brute_force(spark, tmp_path):
    rows = [(i, t, ["user", "assistant", None, "<|text|>", "system"][(i + t) % 5], HARD[(3 * i + t) % len(HARD)] if (i + t) % 7 else None, "p", "q") for i in range(25) for t in range(1 + i % 5)]
    conversations(spark, tmp_path, rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op3_chat(spark, str(tmp_path)).collect()}
    assert got == brute([r[:4] for r in rows])


def test_op3_on_the_given_table_and_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op3_chat(spark, sf).collect()}
    assert got == brute(rows)
    conversations(spark, tmp_path, [])
    assert [r.conv_id for r in op3_chat(spark, str(tmp_path)).collect()] == [-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 40))
def test_reader_frames_records_at_any_chunk_size(blocks, chunk):
    data = b"".join(warc.member([("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Block-Digest", warc.base32_sha1(hashlib.sha1(b).hexdigest()))], b) for i, b in enumerate(blocks))
    assert [b for _, b in warc.records(io.BytesIO(data), chunk)] == blocks


def test_reader_rejects_damage():
    good = warc.member([("WARC-Record-ID", "<urn:1>")], b"abc")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-3])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.member([("WARC-Record-ID", "<urn:1>"), ("WARC-Block-Digest", warc.base32_sha1(hashlib.sha1(b"x").hexdigest()))], b"abc"))))


def pages(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_to int").write.mode("overwrite").parquet(f"{path}/pages.parquet")


def brute_pages(rows):
    best, out = {}, {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        other = best.get(b, i)
        out[i] = (len(b), hashlib.sha1(b).hexdigest(), "response" if other == i else "revisit", None if other == i else other)
    return out


def test_op5_against_brute_force(spark, tmp_path):
    big, edge = "é" * 700, "x" * 1000
    rows = [(i, [None, "http://a/\r\nX: y", "http://b"][i % 3], [big, None, "", edge, "x" * 999, big + str(i)][i % 6], "p", 1) for i in range(60)]
    pages(spark, tmp_path, rows)
    got = {r.page_id: tuple(r)[1:] for r in op5_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert got == brute_pages([r[:3] for r in rows])


def test_op5_given_table_and_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: tuple(r)[1:] for r in op5_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    assert got == brute_pages(rows)
    pages(spark, tmp_path, [])
    assert op5_warc(spark, str(tmp_path)).count() == 0


def test_warc_payloads_read_back(spark):
    df = spark.createDataFrame([(1, "u", "a" * 1500), (2, "u", "a" * 1500), (3, None, None)], "page_id long, url string, html string")
    directory = fresh_path(spark, "warc-test")
    rows = {r.record_id: r for r in warc.read_warc(warc.write_warc(df, directory), directory).collect()}
    name = lambda i, b: f"<urn:page:{i}:{hashlib.sha1(b).hexdigest()}>"
    long = b"a" * 1500
    assert bytes(rows[name(2, long)].payload) == long
    assert rows[name(1, long)].payload is None and rows[name(1, long)].refers_to == name(2, long)
    assert bytes(rows[name(3, b"")].payload) == b""


def test_repeated_ids_lose_no_payload(spark, tmp_path):
    a, b = "A" * 1500, "B" * 1500
    given_rows = [(5, "u", a), (9, "u", a), (5, "u", b), (9, "u", a), (None, "u", a), (7, "u", "x"), (7, "u", "x")]
    pages(spark, tmp_path, [(*r, "p", 1) for r in given_rows])
    got = sorted(((r.page_id or -1, r.payload_digest, r.record_type, r.refers_to) for r in op5_warc(spark, str(tmp_path)).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(5, sha(a), "revisit", 9), (9, sha(a), "response", None), (5, sha(b), "response", None), (9, sha(a), "response", None), (-1, sha(a), "response", None), (7, sha("x"), "response", None), (7, sha("x"), "response", None)]
    assert got == sorted(want, key=str)
    df = spark.read.parquet(f"{tmp_path}/pages.parquet")
    directory = fresh_path(spark, "warc-test")
    kept = {bytes(r.payload) for r in warc.read_warc(warc.write_warc(df, directory), directory).collect() if r.payload is not None}
    assert kept == {a.encode(), b.encode(), b"x"}


def test_streamed_log_folds_back_whatever_the_partitioning(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], HARD[(c * 7 + t) % len(HARD)]) for c in range(6) for t in range(9)]
    rows += [(1, 2, "assistant", "same")] * 3 + [(1, 2, "user", "same"), (1, 2, "assistant", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    kept = sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(log).collect()), key=str)
    assert kept == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)
    shown = [sorted(map(tuple, chat.render(chat.fold(chat.streamed(df.repartition(n, "text")).repartition(n + 1))).select("conv_id", "formatted").collect()), key=str) for n in (1, 3, 5)]
    assert shown[0] == shown[1] == shown[2]
