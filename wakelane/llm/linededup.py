"""Line dedup in DataFrame functions: lines that many documents share stay in one of them.

Normalised lines are exploded and hashed; documents are counted per hash; the
lines over the threshold are dropped and texts put together again by position.
No Python, no text in a shuffle but the one that brings a document's dropped
positions back to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakelane.llm.common import written

#: Keys of at least so many code points, found in at least so many documents, are repeated ones.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: What is stripped at both ends of a line: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key's two hashes, and what tells a row: its id, and two hashes of its text (the second one for rows without id).
HASHES, ROW = ["h1", "h2"], ["id", "t1", "t2"]


def key_of(line: Column) -> Column:
    """The line without surrounding spaces, A-Z in lower case; other letters keep their case."""
    bare = F.btrim(line, F.lit(SPACES))
    # lower() is fast and changes A-Z only where there are no other letters.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashes(c: Column) -> list[Column]:
    """128 bits of a text: two 64-bit hashes with different seeds."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ROW, pos (from 0) and HASHES of every line whose key is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = hashes(text)
    rows = df.where(F.length(text) >= LEAST_CHARS).select(F.col(id_col).alias("id"), t1.alias("t1"), F.when(F.col(id_col).isNull(), t2).alias("t2"), text.alias("text"))
    lines = rows.select(*ROW, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= LEAST_CHARS)
    keys = lines.select(*ROW, "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= LEAST_CHARS)
    h1, h2 = hashes(F.col("key"))
    return keys.select(*ROW, "pos", h1.alias("h1"), h2.alias("h2"))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """ROW and dropped: the positions that a row loses; rows that lose none are left out.

    Lines are counted first, which finds all keys that can be repeated ones and
    few others; only their lines are then counted by distinct document. A key
    that a third of the lines have is one row of each task before the shuffle.
    Written tables are joined by broadcast only where Spark finds them small.
    """
    lines = lines_of(df, id_col, text_col)
    often = written(lines.groupBy(*HASHES).agg(F.count("*").alias("n")).where(F.col("n") >= documents).select(*HASHES), "linededup-often")
    hits = written(lines.join(often, HASHES), "linededup-hits")
    holders = hits.select(*HASHES, "id").distinct().groupBy(*HASHES).agg(F.count("id").alias("n"), F.max("id").alias("keeper"))
    repeated = written(holders.where(F.col("n") >= documents).select(*HASHES, "keeper"), "linededup-repeated")
    gone = hits.join(repeated, HASHES).where(F.col("id").isNull() | (F.col("id") < F.col("keeper")))
    return gone.groupBy(*ROW).agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to every row; columns of these names are replaced, others stay.

    A null or empty text is one empty line, kept as ''. Documents are told by
    their id: repeated rows of one id count once, and all of them keep or lose
    a line alike; a key twice in a document counts once, and all its lines go or
    stay. Rows without an id count for no key and keep no repeated line. Ids need
    an order; the largest one that holds a key keeps its lines.
    """
    base = df.drop("n_lines", "n_dropped", "kept_text")
    lost = written(dropped_lines(df, id_col, text_col, documents), "linededup-lost").withColumnsRenamed({c: f"_{c}" for c in [*ROW, "dropped"]})
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = hashes(text)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (t1 == F.col("_t1")) & F.when(F.col(id_col).isNull(), t2).eqNullSafe(F.col("_t2"))
    # Positions are few beside the texts, which so need no sort: a partition's positions are hashed.
    rows = base.join(lost.hint("shuffle_hash"), same, "left").withColumn("_lines", F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return rows.select(
        *(F.col(c) for c in base.columns),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_dropped").isNull(), text).otherwise(kept).alias("kept_text"),
    )
