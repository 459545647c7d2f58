"""The opN_ queries over the given tables, and their SQL."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import functions as F

from wakelane.llm import bpe, chat, langid, licenses, linededup, neardup, packing, quality, token_output, topk, variants, warc, whitening
from wakelane.llm.common import table

CHAT_PROBE = "</s>[INST] ok [/INST]"


def op1_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    text_of = F.array_join(F.col("ids").cast("array<string>"), " ")
    decoded = bpe.bpe_decode(ids, ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text_of, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text"))
    events = chat.streamed(rows.unionByName(probe))
    out = chat.render(chat.fold(events))
    turns = chat.parse(F.col("formatted"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    read = out.withColumn("turns", turns).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_rejected")


def op5_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, chain).drop("text")


def op7_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.learn(spark, docs))


def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_token_output(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
    return packed.places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark, sf_dir):
    return variants.group_variants(variants.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_bpe, op3_chat, op4_language, op5_warc, op6_quality, op7_licenses, op8_top_k, op9_token_output, op10_packing, op11_line_dedup, op12_spelling_variants, op13_whitening)}

_PLAIN = "|".join(re.escape(c) for c in chat.CONTROLS)
#: Characters that escaping adds: one per backslash and one per control string.
_ADDED = lambda c: f"length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, '{_PLAIN}'))"
ORACLES = {
    "op3_chat": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CHAT_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{CHAT_PROBE}'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
    sum({len(chat.TURN) + len(chat.TEXT) + len(chat.END)} + length(role) + {_ADDED("role")} + length(text) + {_ADDED("text")}) AS formatted
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND best <> page_id THEN best END AS refers_to
FROM m""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10""",
    "op11_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{linededup.UPPER}', '{linededup.LOWER}') AS key FROM p),
rep AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {linededup.LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {linededup.LEAST_DOCUMENTS}
), m AS (SELECT k.*, rep.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id <> rep.keeper) AS gone FROM k LEFT JOIN rep ON k.key = rep.key)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM m GROUP BY r)""",
    # CRC-32 over UTF-8 bytes by its bitwise table; near words share a word with one letter left out or masked.
    "op12_spelling_variants": f"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, '{variants.UPPER}', '{variants.LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
), crcs AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) AS BIGINT) - 64] END))),
    lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8))) AS h
  FROM runs, tab
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM crcs)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gaps AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
), masks AS (
  SELECT DISTINCT word, n, substring(word, 1, p - 1) || '?' || substring(word, p + 1) AS mask, substring(word, 1, p - 1) || substring(word, p + 1) AS short FROM gaps
), pairs AS (
  SELECT a.word AS word, b.word AS other FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT m.word, w.word FROM masks m JOIN words w ON m.short = w.word
  UNION SELECT w.word, m.word FROM masks m JOIN words w ON m.short = w.word
), best AS (
  SELECT p.word, count(*) AS n_near, first(struct_pack(w := o.word, n := o.n) ORDER BY o.n DESC, o.word) AS b
  FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.w END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), follow AS (
  SELECT word, form AS root, 1 AS k FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT f.word, g.form, k + 1 FROM follow f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL
)
SELECT word, form, coalesce((SELECT arg_max(root, k) FROM follow f WHERE f.word = forms.word), word) AS root, n, n_near, form_n FROM forms""",
}
