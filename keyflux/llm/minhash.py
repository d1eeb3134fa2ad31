"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingles' 64-bit hashes gives two signature values, its
minimum and its maximum, so BANDS bands of two permutations hold four values
each at half the hash evaluations.  At a similarity of 0.8 a pair shares no
band with a probability below 1e-6.

Documents with equal sets are one class, found by a map-side combined
aggregation.  Within a bucket, classes are first compared with the bucket's
least class (a star, not all pairs); only buckets whose members are then still
in different components are compared in full, in blocks, between components.
Links come from exact set sizes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, materialize, runs

BANDS, PER_BAND = 28, 2
#: Classes of a bucket that one task compares with as many others.
BLOCK = 512
#: A table of ids is broadcast up to so many rows (of 8 bytes), joined by exchange beyond.
BROADCAST_ROWS = 400_000
REMEMBERED = 200_000
_U = np.uint64
_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(0, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * _U(2) + _U(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, 2 * PER_BAND), dtype=np.uint64) * _U(2) + _U(1)
GOLDEN = _U(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class WordHashes(dict):
    """64-bit hashes of words; forgets all beyond REMEMBERED."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text.

    A-Z are lower-cased; words are what white space (ASCII) separates.  With
    fewer than k words the whole sequence is one shingle, without words there
    is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(h) - width + 1
    out = h[:n] + _U(width)
    for i in range(1, width):
        out = spread(out * GOLDEN) + h[i : i + n]
    return np.unique(spread(out))


def bands(s: np.ndarray) -> np.ndarray:
    """A 64-bit key per band: of the minima and maxima of its permutations."""
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(MULTIPLIERS), np.uint64)
    for a in range(0, len(s), 512):
        block = s[None, a : a + 512] * MULTIPLIERS[:, None]
        np.minimum(low, block.min(axis=1), out=low)
        np.maximum(high, block.max(axis=1), out=high)
    values = np.concatenate([low.reshape(BANDS, PER_BAND), high.reshape(BANDS, PER_BAND)], axis=1)
    return spread((spread(values) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, set_id, keys) per row: set size, 128-bit hash of the set (null if empty), band keys."""

    def work(batches):
        known = WordHashes()
        for batch in batches:
            n, fp, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k, known)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bands(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "set_id", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n long, set_id binary, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, set) for the (id, set_id) in wanted: packed sorted hashes, once each."""
    few = wanted.count() <= BROADCAST_ROWS
    w = wanted.select(F.col("id").alias("doc_id"), "set_id")
    # a repeated doc_id may have other texts; those have another set_id
    some = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(w) if few else w, "doc_id")

    def work(batches):
        known = WordHashes()
        for batch in batches:
            ids, out = [], []
            for doc, text, fp in zip(*(c.to_pylist() for c in batch.columns)):
                data = shingles(text, k, known).tobytes()
                if xxhash.xxh3_128_digest(data) == fp:
                    ids.append(doc), out.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "set"])

    return some.mapInArrow(work, "id long, set binary").dropDuplicates(["id", "set"])


def _similar(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def work(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two runs are merged
                keep.append(bool(_similar(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(work, "a long, b long")


def block_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, from exact counts of common shingles; a spanning forest of them.

    Members outside the largest component are compared with all: shingles in
    many sets by one matrix product, those in few by their pairs.
    """
    n = np.array([len(s) for s in sets], np.int64)
    names, tags, sizes = np.unique(comps, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(tags != sizes.argmax())
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    df = np.diff(np.concatenate([first, [len(flat)]]))
    common = np.zeros((len(rows), len(sets)), np.float32)
    where = np.full(len(sets), -1)
    where[rows] = np.arange(len(rows))
    rare = 8 if len(sets) > 64 else 1
    for d in range(2, rare + 1):
        at = first[df == d]
        for i in range(d):
            for j in range(d):
                if i != j and len(at):
                    a, b = where[who[at + i]], who[at + j]
                    np.add.at(common, (a[a >= 0], b[a >= 0]), 1)
    often = np.flatnonzero(df > rare)
    for c in range(0, len(often), 4096):
        part = often[c : c + 4096]
        have = np.zeros((len(sets), len(part)), np.float32)
        reach = df[part]
        at = np.repeat(first[part] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
        have[who[at], np.repeat(np.arange(len(part)), reach)] = 1
        common += have[rows] @ have.T
    ok = _similar(common, n[rows][:, None], n[None, :], percent) & (tags[rows][:, None] != tags[None, :])
    out, root = [], list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r, j in zip(*np.nonzero(ok)):
        a, b = find(tags[rows[r]]), find(tags[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[rows[r]]), int(ids[j])))
    return out


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components, in blocks."""
    m = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    m = materialize(m, "minhash-members")
    open_ = m.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("size > 2 and c0 <> c1")
    open_ = open_.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    m = m.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "comp").distinct().join(sets, "id")
    m = m.select("bucket", "bi", "bj", "id", "comp", "set").repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")

    def work(batches):
        a, b = [], []
        for _, rows in runs(batches, 3):
            ids, comps, data = zip(*rows)
            if len(set(comps)) > 1:
                for x, y in block_links(np.array(ids), np.array(comps), [np.frombuffer(s, np.uint64) for s in data], percent):
                    a.append(x), b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return m.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs.

    Documents are linked if 100 * common >= percent * united distinct k-word
    shingles; component_id is the smallest doc_id reachable.  Null, empty and
    blank texts have no shingles and are linked with nothing.  Rows that repeat
    a doc_id count as one document where links are followed.  A null doc_id is
    linked with nothing: component_id null, kept false.  An empty table gives
    no rows; other columns are ignored.
    """
    s = materialize(signatures(docs, k), "minhash-sets")
    live = s.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(live.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")), "minhash-classes")
    # the same id with several sets: its classes are one node, linked through the id
    buckets = classes.select(F.explode("keys").alias("bucket"), "id", "n")
    many = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("centre")).filter("size > 1")
    members = materialize(buckets.join(many.select("bucket", "centre"), "bucket"), "minhash-buckets")
    star = members.filter(F.col("id") != F.col("centre.id")).filter(100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
    star = star.select(F.col("centre.id").alias("a"), F.col("id").alias("b")).distinct()
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "set_id")
    sets = materialize(sets_of(docs, wanted, k), "minhash-full")
    links = materialize(confirm(star, sets, percent), "minhash-links")
    more = _rest(members.select("bucket", "id").distinct(), connected(links), sets, percent)
    roots = connected(links.union(more))
    first = classes.filter("copies > 1").select("set_id", "id")
    out = s.select("doc_id", "n", "set_id").join(first, "set_id", "left").withColumn("id", F.coalesce("id", "doc_id"))
    out = out.join(roots.withColumnRenamed("node", "id"), "id", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose component keeps them, with all their columns; of rows that repeat a kept doc_id, all stay.

    Rows with a null doc_id stay: they are linked with nothing.
    """
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = near_duplicates(docs, k, percent).filter(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = materialize(gone.select(F.col("doc_id").alias(name)).distinct(), "minhash-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


#: At this size of the tables SQL can intersect all sets. Two words are joined by a space, which no word holds.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS p FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(p) < 2 THEN p ELSE list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""
