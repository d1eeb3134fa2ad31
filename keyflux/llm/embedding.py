"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe.

A hash rotates a vector by three rounds of random signs and a Walsh-Hadamard
transform and names the axis, with sign, that is largest in size.  A vector
lies in its home bucket and is also looked up in the buckets of its next
largest axes.  With PROBES axes a hash and TABLES tables, a pair of cosine 0.9
in 64 dimensions meets with a probability above 1 - 1e-6.  Vectors that meet
are compared in double precision, in blocks; a pair counts only in the first
bucket where it meets, so links are counted and not written.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, materialize

PROBES, TABLES = 4, 6
#: Rows of a bucket that one task compares with as many others.
BLOCK = 2048
#: Distinct vectors a hash can tell apart before another is concatenated: fixes the hashes a table by the table's size alone.
PER_HASH = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


@lru_cache(maxsize=64)
def _signs(dim: int, tables: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(dim * 1009 + hashes).choice([-1.0, 1.0], size=(tables, hashes, 3, dim))


def codes(x: np.ndarray, tables: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, probes ** hashes) buckets of the rows; the first is home. Rows with few dimensions have fewer probes (-1)."""
    dim = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    signs = _signs(dim, tables, hashes)
    out = np.empty((len(x), tables, probes**hashes), np.int64)
    for t in range(tables):
        code = np.zeros((len(x), 1), np.int64)
        for h in range(hashes):
            y = x
            for s in signs[t, h]:
                y = hadamard(y * s)
            # candidates: both signs of each axis, so two dimensions have four
            size = np.concatenate([y, -y], axis=1)
            best = np.argsort(-size, axis=1, kind="stable")[:, :probes]
            code = np.where((code[:, :, None] < 0) | (best[:, None, :] < 0), -1, code[:, :, None] * (2 * dim) + best[:, None, :]).reshape(len(x), -1)
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = -1
    return out


def _unit(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length, in double precision, at length 1."""
    x = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kind(df: DataFrame, column: str) -> str:
    """Floats travel as they are, at half the size; all else as doubles."""
    return "array<float>" if df.schema[column].dataType.simpleString() == "array<float>" else "array<double>"


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, key): key is a 128-bit hash of the vector, null where it can't be compared."""

    def work(batches):
        for batch in batches:
            keys = []
            for v in batch.column(1).to_pylist():
                key = None
                if v and None not in v:
                    x = np.asarray(v, np.float64) + 0.0  # no negative zero
                    if np.isfinite(x).all() and x.any():
                        key = xxhash.xxh3_128_digest(x.tobytes())
                keys.append(key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["vec_id", "v", "key"])

    kind = _kind(vectors, "embedding")
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v")).mapInArrow(work, f"vec_id long, v {kind}, key binary")


def _visits(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    """(dim, t, bucket, home, key, id, copies, v): every bucket a class visits."""

    def work(batches):
        for batch in batches:
            for piece in (batch.slice(a, 2000) for a in range(0, len(batch), 2000)):
                dims = pc.list_value_length(piece.column(3)).to_numpy()
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    c = codes(_unit(piece.column(3).take(pa.array(at))), tables, hashes)
                    row, t, p = np.nonzero(c >= 0)
                    rows = piece.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(t.astype(np.int32)), pa.array(c[row, t, p]), pa.array(p == 0), *rows.columns], names=["dim", "t", "bucket", "home", "key", "id", "copies", "v"])

    return classes.select("key", "id", "copies", "v").mapInArrow(work, "dim int, t int, bucket long, home boolean, key binary, id long, copies long, v " + _kind(classes, "v"))


def _block(dim, t, bucket, bi, bj, home, block, copies, x, threshold, tables, hashes):
    """Of one block pair: links a row (weighted by copies), and a label that joins linked rows."""
    g = len(x)
    links, label = np.zeros(g, np.int64), np.arange(g)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    c = None
    for a in range(0, g, 256):
        part = slice(a, min(g, a + 256))
        near = x[part] @ x.T >= threshold
        near &= np.arange(g)[None, :] > np.arange(g)[part, None]
        near &= home[part, None] | home[None, :]
        if bi != bj:
            near &= block[part, None] != block[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i += a
        c = codes(x, tables, hashes) if c is None else c
        first = np.ones(len(i), bool)
        for u in range(t + 1):
            ca, cb = c[i, u], c[j, u]
            in_a, in_b = (cb == ca[:, :1]).any(axis=1), (ca == cb[:, :1]).any(axis=1)
            if u < t:
                first &= ~(in_a | in_b)
            else:  # of two buckets of this table, the smaller
                big = np.iinfo(np.int64).max
                first &= np.minimum(np.where(in_a, ca[:, 0], big), np.where(in_b, cb[:, 0], big)) == bucket
        i, j = i[first], j[first]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        pairs.append((i, j))
    if pairs:
        i, j = (np.concatenate(p) for p in zip(*pairs))
        while True:
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return links, label


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors.

    n_links counts the other rows linked directly, copies included; component_id
    is the smallest vec_id reachable.  A vector that is null, empty, zero, or
    holds null or non-finite components links with nothing, nor do vectors of
    different lengths link.  Equal vectors are one class with a count of
    copies.  Rows that repeat a vec_id are rows of their own in n_links and one
    node in components; a null vec_id counts as a link but has no component and
    isn't kept.  An empty table gives no rows; other columns are ignored.
    """
    p = materialize(_prepared(vectors), "vectors")
    classes = materialize(p.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "vector-classes")
    many = classes.count()
    hashes = 1 + int(math.log(max(1, many / PER_HASH), 128)) if many > PER_HASH else 1
    tables = TABLES * 2 ** (hashes - 1)
    visits = _visits(classes, tables, hashes)
    where = ["dim", "t", "bucket"]
    size = materialize(visits.groupBy(*where).agg(F.count("*").alias("n"), F.max("home").alias("any")).filter("n > 1 and any").select(*where, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    m = visits.join(size, where).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select(*where, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "home", "block", "key", "id", "copies", "v")
    keys = [*where, "bi", "bj"]
    m = m.repartition(*keys).sortWithinPartitions(*keys)

    def work(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def finish():
            cols = pa.Table.from_batches(held).combine_chunks()
            x = _unit(cols["v"].combine_chunks())
            copies = cols["copies"].to_numpy()
            links, label = _block(*now, cols["home"].to_numpy(zero_copy_only=False), cols["block"].to_numpy(), copies, x, threshold, tables, hashes)
            at = np.flatnonzero(links)
            ids = cols["id"].to_pylist()
            root: dict[int, int] = {}
            for i in at:
                if ids[i] is not None:
                    root[label[i]] = min(root.get(label[i], ids[i]), ids[i])
            key = cols["key"].to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([key[i] for i in at], pa.binary()), pa.array([ids[i] for i in at], pa.int64()), pa.array([root.get(label[i]) for i in at], pa.int64()), pa.array(links[at])], names=["key", "id", "root", "links"])

        for batch in batches:
            k = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(k)] if len(k) else [0]
            for a, b in zip(cuts, cuts[1:]):
                group = tuple(int(v) for v in k[a])
                if group != now:
                    if held:
                        yield finish()
                    held, now = [], group
                held.append(batch.slice(a, b - a))
        if held:
            yield finish()

    found = materialize(m.mapInArrow(work, "key binary, id long, root long, links long"), "vector-links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected(found.filter("id is not null and root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    result = classes.select("key", "id", "copies").join(counts, "key", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    result = result.select(F.col("key").alias("key_"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "id").alias("comp")).filter("links > 0")
    out = p.select("vec_id", "key").join(result, F.col("key") == F.col("key_"), "left")
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("comp", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


#: At this size of the tables SQL can compare all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS size FROM v),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id WHERE list_inner_product(p.x, q.x) / p.size / q.size >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON m.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
