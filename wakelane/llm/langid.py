"""Language identification by compression against per-language zstandard dictionaries."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.llm.common import map_arrow, tuned

#: Bound of the training sample: excerpts per language, their length in characters, and the dictionary they fill.
EXCERPTS = 160
EXCERPT_CHARS = 600
DICTIONARY_BYTES = 32 << 10
#: Whole texts are compressed in blocks of this size, so that a text's own repeats do not outweigh the dictionary.
BLOCK = 1024
#: A lead of the best language over the next, as a share of size, below which a prediction is rejected.
LEAST_MARGIN = 0.001
#: Lead at which the score has come half way from 0.5 to 1.
HALF_MARGIN = 0.02
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII characters other than letters become spaces; bytes of other characters stay.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-case letters and single spaces, in UTF-8."""
    return b" ".join(text.lower().encode().translate(_SPACED).split())


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5 == 0


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """One raw-content dictionary per non-null language of df.

    Per language, the EXCERPTS distinct texts with the smallest hashes give an
    excerpt from their middle. Hashes are grouped and cut per language first, so
    texts are never shuffled; what reaches the driver is at most EXCERPTS
    excerpts a language.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    keys = rows.groupBy("lang", "h").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("h")
    some = keys.withColumn("k", F.row_number().over(order)).where(F.col("k") <= EXCERPTS).select("lang", "h")
    middle = F.substr("text", F.greatest(F.lit(1), F.floor((F.length("text") - EXCERPT_CHARS) / 2).cast("int")), F.lit(EXCERPT_CHARS))
    # EXCERPTS keys a language: small enough to send to every task.
    excerpts = rows.join(F.broadcast(some), ["lang", "h"]).groupBy("lang", "h").agg(F.min(middle).alias("x")).orderBy("lang", "h").collect()
    found: dict[str, bytes] = {}
    for r in excerpts:
        found[r["lang"]] = found.get(r["lang"], b"") + plain(r["x"]) + b" "
    return {lang: x[:DICTIONARY_BYTES] for lang, x in found.items() if x.strip()}


@lru_cache(maxsize=2)
def compressors(model: tuple[tuple[str, bytes], ...]):
    import zstandard as z

    settings = z.ZstdCompressionParameters.from_level(5, min_match=4)
    out = []
    for lang, content in model:
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=settings)
        out.append((lang, z.ZstdCompressor(dict_data=d, compression_params=settings).compress))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """Language, score, margin. Ties go to the language that sorts first."""
    if not text or not model or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    data = plain(text)
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(map(len, map(compress, blocks))), lang) for lang, compress in compressors(model))
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    margin = (sizes[1][0] - sizes[0][0]) / max(sizes[1][0], 1)
    return sizes[0][1], 1 - 0.5 * math.exp(-margin * math.log(2) / HALF_MARGIN), margin


def identify(df: DataFrame, model: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and lang_rejected, from the whole text alone.

    lang_pred is the language whose dictionary compresses the text best; null
    texts and texts without a letter, or all texts if no language was learnt,
    are `und` with score 0. lang_rejected is true for those and where the lead
    is under LEAST_MARGIN. Rows stay as they are, repeats included; columns of
    these three names are replaced. No shuffle.
    """
    tuned(df.sparkSession)
    added = ["lang_pred", "score", "lang_rejected"]
    base = df.drop(*added)
    at = base.columns.index(text_col)
    fixed = tuple(sorted(model.items()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [classify(t, fixed) for t in batch.column(at).to_pylist()]
        columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == UNKNOWN or x[2] < LEAST_MARGIN for x in found], pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "lang_rejected": F.lit(True)}).schema
    return map_arrow(base, run, schema)
