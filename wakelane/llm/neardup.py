"""Near-duplicate classes: BagMinHash signatures, banding, exact multiset overlap.

Texts with one word sequence form one class by their key, so copies are never
compared. The smallest id of each key goes on: bands of its signature give
buckets, buckets with the same members are taken once, and each bucket has two rounds.
The first pairs each member with a leader, the member
nearest to the bucket's common signature, which ties large groups together
without all their pairs. The second proposes every pair of a bucket that is not
in one component yet, so that no link is lost. Proposals whose signatures or
sizes rule the similarity out are dropped; the rest are verified on whole texts.
Large buckets are dealt into cells of bounded size, and into pairs of cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakelane.llm.bagminhash import signatures
from wakelane.llm.common import map_arrow, tuned, written
from wakelane.llm.shingles import batch_shingles

THRESHOLD = 0.8
#: Registers; bands of ROWS registers each are taken from the first ones. At similarity 0.8 a pair
#: shares no band with probability (1 - 0.8**4)**20 = 3e-5, at 0.9 with 1e-9.
REGISTERS, BANDS, ROWS = 128, 20, 4
#: Agreeing registers below which a pair is ruled out: five standard deviations under 0.8.
LEAST_AGREEING = int(REGISTERS * THRESHOLD - 5 * (REGISTERS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
#: Members of a cell; a larger bucket has several.
CELL = 4096
#: Shingles of a cell, and list entries added up at once, in the exact round.
CELL_SHINGLES = 2_000_000
POSTINGS = 4_000_000
#: Texts verified against one copy of a leader's text.
CHUNK = 64


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (key of the words), n (shingles), bands, sig (one byte a register)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, shingle, count, keys = batch_shingles(batch.column(1))
        registers = signatures(batch.num_rows, doc, shingle, count, REGISTERS)
        total = np.bincount(doc, weights=count, minlength=batch.num_rows).astype(np.int64)
        bands = np.zeros((batch.num_rows, BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                bands = bands * np.uint64(0x9E3779B97F4A7C15) + registers[:, r : BANDS * ROWS : ROWS]
        low = np.ascontiguousarray((registers & np.uint64(255)).astype(np.uint8))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
        columns = [batch.column(0), pa.array(keys[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)), pa.array(total), lists, pa.array([x.tobytes() for x in low], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n", "bands", "sig"])

    return map_arrow(docs, run, "doc_id long, k1 long, k2 long, n long, bands array<long>, sig binary")


def _alike(sig: np.ndarray, n: np.ndarray, one_sig: np.ndarray, one_n: int) -> np.ndarray:
    fits = np.minimum(n, one_n) >= THRESHOLD * np.maximum(n, one_n)
    return fits & ((sig == one_sig).sum(1) >= LEAST_AGREEING)


def leader_pairs(ids: np.ndarray, sig: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """(leader, member) pairs that cover every member that is like another one."""
    score = np.zeros(len(ids), np.int64)
    for column in sig.T:
        score += np.bincount(column, minlength=256)[column]
    open_ = np.ones(len(ids), bool)
    out = []
    for i in np.lexsort((ids, -score)):
        if open_[i]:
            open_[i] = False
            like = _alike(sig, n, sig[i], n[i])
            like[i] = False
            # One earlier member may tie this leader's group to another one.
            earlier = np.flatnonzero(like & ~open_)[:1]
            now = np.flatnonzero(like & open_)
            open_[now] = False
            out += [(int(ids[i]), int(ids[j])) for j in (*earlier, *now)]
    return out


def _minor(component: np.ndarray) -> np.ndarray:
    """Members outside the most frequent component."""
    names, of, size = np.unique(component, return_inverse=True, return_counts=True)
    return of != size.argmax()


def candidates(ids, sig, n, component) -> np.ndarray:
    """Which members of a cell may be like a member of another component; linear in members."""
    out = np.zeros(len(ids), bool)
    for k in np.flatnonzero(_minor(component)):
        like = _alike(sig, n, sig[k], n[k]) & (component != component[k])
        if like.any():
            out |= like
            out[k] = True
    return out


def exact_links(ids, component, doc, shingle, count) -> list[tuple[int, int]]:
    """Pairs of different components in a cell whose multisets overlap by THRESHOLD or more.

    Members' shingles are inverted once; each member outside the largest
    component adds up its overlap with all others over the lists of its own.
    """
    k = len(ids)
    total = np.bincount(doc, weights=count, minlength=k)
    _, name = np.unique(shingle, return_inverse=True)
    order = np.argsort(name, kind="stable")
    owner, weight = doc[order], count[order]
    begin = np.searchsorted(name[order], np.arange(name.max() + 2 if len(name) else 1))
    edge = np.searchsorted(doc, np.arange(k + 1))
    out = []
    for x in np.flatnonzero(_minor(component)):
        mine, times = name[edge[x] : edge[x + 1]], count[edge[x] : edge[x + 1]]
        common = np.zeros(k)
        lengths = begin[mine + 1] - begin[mine]
        step = np.cumsum(lengths) // POSTINGS
        for part in np.unique(step):
            some = np.flatnonzero(step == part)
            size = lengths[some]
            at = np.repeat(begin[mine[some]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            common += np.bincount(owner[at], weights=np.minimum(weight[at], np.repeat(times[some], size)), minlength=k)
        hit = (common >= THRESHOLD * (total + total[x] - common)) & (component != component[x]) & (common > 0)
        out += [(int(ids[x]), int(ids[y])) for y in np.flatnonzero(hit)]
    return out


def _cells(batches, columns: int):
    """Groups rows of sorted batches by their first `columns` columns."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        head = np.column_stack(table[:columns])
        cuts = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1).tolist(), len(head)]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(head[a].tolist())
            if now != key:
                if held:
                    yield key, [np.concatenate(x) for x in zip(*held)]
                key, held = now, []
            held.append([c[a:b] for c in table[columns:]])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held)]


def _propose(cells: DataFrame, columns: int, pairs_of) -> DataFrame:
    names = cells.columns[:columns]

    def run(batches):
        a, b = [], []
        for key, values in _cells(batches, columns):
            for x, y in pairs_of(key, values):
                a.append(x)
                b.append(y)
            if len(a) > 1 << 16:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long").distinct()


def _matrix(sig: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint8).reshape(-1, REGISTERS)


def _first_round(key, values):
    ids, n, sig = values
    return leader_pairs(ids, _matrix(sig), n)


def linked(cells: DataFrame) -> DataFrame:
    """a, b: exact links across components in cells of (bucket, i, j, id, component, text)."""

    def run(batches):
        key, ids, component, parts = None, [], [], []

        def done():
            doc = np.concatenate([np.full(len(h), k) for k, (h, _) in enumerate(parts)] or [np.zeros(0, np.int64)])
            shingle = np.concatenate([h for h, _ in parts])
            count = np.concatenate([c for _, c in parts])
            return exact_links(np.array(ids), np.array(component), doc, shingle, count)

        def out(pairs):
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

        for batch in batches:
            doc, shingle, count, _ = batch_shingles(batch.column(5))
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            head = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            for r, (bucket, i, j, name, comp) in enumerate(head):
                if (bucket, i, j) != key:
                    if parts:
                        yield out(done())
                    key, ids, component, parts = (bucket, i, j), [], [], []
                ids.append(name)
                component.append(comp)
                parts.append((shingle[edge[r] : edge[r + 1]], count[edge[r] : edge[r + 1]]))
        if parts:
            yield out(done())

    by = ["bucket", "i", "j"]
    rows = cells.select(*by, "id", "component", "text").repartition(*by).sortWithinPartitions(*by, "id")
    return rows.mapInArrow(run, "a long, b long").distinct()


def flagged(cells: DataFrame) -> DataFrame:
    """bucket, i, j, id, component of the members of each cell that candidates() keeps."""
    by = ["bucket", "i", "j"]

    def run(batches):
        for key, (component, ids, n, sig) in _cells(batches, 3):
            keep = candidates(ids, _matrix(sig), n, component)
            if keep.any():
                size = int(keep.sum())
                yield pa.RecordBatch.from_pydict({**{c: pa.array(np.full(size, v)) for c, v in zip(by, key)}, "id": pa.array(ids[keep]), "component": pa.array(component[keep])})

    rows = cells.select(*by, "component", "id", "n", "sig").repartition(*by).sortWithinPartitions(*by, "id")
    return rows.mapInArrow(run, "bucket long, i long, j long, id long, component long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs whose word-shingle multisets overlap by THRESHOLD or more.

    Members of one leader meet one copy of its text, CHUNK at a time; a task
    holds one leader's shingles and a batch of texts.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), "b")
    members = dealt.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    leaders = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    rows = leaders.unionByName(members).join(texts, "doc_id").select("a", "chunk", "role", "doc_id", "text")

    def run(batches):
        key, mine, weight, total = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            a, chunk, role, ids = (batch.column(i).to_numpy() for i in range(4))
            doc, shingle, count, _ = batch_shingles(batch.column(4))
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            left, right = [], []
            for i in range(batch.num_rows):
                h, c = shingle[edge[i] : edge[i + 1]], count[edge[i] : edge[i + 1]]
                if role[i] == 0:
                    key, mine, weight, total = (a[i], chunk[i]), h, c, int(c.sum())
                elif (a[i], chunk[i]) == key and len(mine):
                    at = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
                    common = int(np.minimum(weight[at], c)[mine[at] == h].sum())
                    if common >= THRESHOLD * (total + int(c.sum()) - common):
                        left.append(a[i])
                        right.append(ids[i])
            if left:
                yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label: smallest id of each connected component, by neighbours' minima and pointer jumping."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("label").alias("above"))
        moved = written(step.join(up, "next").select("id", F.least("next", "above").alias("label"), (F.least("next", "above") != F.col("label")).alias("moved")), "labels")
        labels = moved.select("id", "label")
        if not moved.where("moved").limit(1).count():
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: each row's class, named by its smallest doc_id.

    Classes are the connected components of texts whose multisets of five-word
    shingles (lower-cased words) have Jaccard similarity 0.8 or more. Texts with
    equal words are one class; a text of one to four words is one shingle. Texts
    without a word, null ones too, are their own class. Rows that share an id
    are one document; a row with a null id keeps a null class if no other copy
    has an id. An empty table gives no rows; other columns are not read.
    """
    tuned(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(signed(docs), "signatures")
    worded = table.where("n > 0")
    classes = written(worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")), "classes")
    firsts = classes.where("first IS NOT NULL").select(F.col("first").alias("doc_id"))
    reps = written(worded.join(firsts, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "bands", "sig").dropDuplicates(["id"]), "representatives")

    places = reps.select("id", "n", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("bucket"), "id", "n")
    filled = places.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("members"), F.sum("n").alias("shingles")).where("size > 1")
    once = filled.groupBy("size", "members").agg(F.min_by(F.struct("bucket", "shingles"), "bucket").alias("b")).select("b.bucket", F.greatest(F.ceil(F.col("size") / CELL), F.ceil(F.col("b.shingles") / CELL_SHINGLES)).alias("parts"))
    members = written(places.drop("n").join(once, "bucket").join(reps.select("id", "n", "sig"), "id").select("bucket", F.pmod(F.xxhash64("id"), "parts").cast("long").alias("part"), "parts", "id", "n", "sig"), "members")
    # The ids grow with the corpus, so they are never sent to every task.
    texts = written(docs.join(members.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")

    first = written(_propose(members.select("bucket", "part", "id", "n", "sig"), 2, _first_round), "pairs")
    edges = written(verified(first, texts), "links")
    labels = components(edges)

    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("label", "id"))
    # Members of a bucket's largest component need no pairs among themselves: they meet the others only.
    by_component = named.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = F.max(F.struct("c", (-F.col("component")).alias("m"), "s"))
    split = by_component.groupBy("bucket").agg(most.alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s")).where(F.col("c") > F.col("top.c"))
    fewer = F.greatest(F.ceil((F.col("c") - F.col("top.c")) / CELL), F.ceil((F.col("s") - F.col("top.s")) / CELL_SHINGLES))
    own = named.join(split.select("bucket", (-F.col("top.m")).alias("main"), fewer.alias("fewer")), "bucket")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    cell = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    place = F.pmod(F.xxhash64("id", F.lit(1)), "fewer")
    main = F.transform(every(F.col("fewer")), lambda j: cell(F.col("part"), j))
    other = F.concat(F.transform(every(F.col("parts")), lambda i: cell(i, place)), F.transform(every(F.col("fewer")), lambda o: cell(-1 - F.least(place, o), F.greatest(place, o))))
    crossed = own.select("bucket", "component", "id", "n", "sig", F.inline(F.when(F.col("component") == F.col("main"), main).otherwise(other)))
    crossed = crossed.select("bucket", "i", "j", "component", "id", "n", "sig")
    open_ = flagged(crossed).join(texts.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"]), "id")
    more = written(linked(open_), "links")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))

    named_classes = classes.join(labels.withColumnRenamed("id", "first"), "first", "left").select("k1", "k2", F.coalesce("label", "first").alias("class_id"))
    # No class has more than one row here; the keyed side may hold one very common key.
    found = table.select("doc_id", "k1", "k2", "n").join(named_classes, ["k1", "k2"], "left")
    return found.select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
