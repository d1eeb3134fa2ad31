"""Exact BM25 top-k by block-max WAND, per shard, merged under global statistics.

Terms are the words of a text, A-Z lower-cased; a query is a text's distinct
terms.  score = sum of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) /
(tf + K1 * (1 - B + B * length / average)), rounded to DIGITS decimals; ties go
to the smaller id.

A shard holds about SHARD_TOKENS tokens: its documents become an inverted index
in one task, with the largest contribution of each rare term in each window of
WINDOW blocks, and of each frequent term in each block of BLOCK documents too.
Frequent terms have their contributions in a grid, which a matrix product reads
for many queries at once.  Documents of a shard are numbered by their most
frequent terms, so that a block's are alike and its maxima tight.  Queries,
packed many to a row, are held by the task and meet its shards one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .packed import pack, steps, unpack

K1, B, DIGITS = 1.2, 0.75, 6
SHARD_TOKENS = 3_000_000
#: Documents of a block.
BLOCK = 128
#: Blocks of a window.
WINDOW = 8
#: Terms of at least this share of a shard's documents are frequent; a shard's grid has so many cells, of 12 bytes, at most.
FREQUENT, GRID = 0.05, 8_000_000
#: Queries are looked up side by side as far as they have so many scores.
CELLS = 2_000_000
#: Shards are dealt to at most so many tasks a core, each of which is sent the queries once.
TASKS = 8
#: Bounds are compared with so much slack, for rounding.
SLACK = 1e-5


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit term hashes of a whole text, and how often each occurs."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = hash_array(np.array(words, object), categorize=False)
    found.sort()
    at = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    return found[at], np.diff(np.append(at, len(found)))


def _frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, docs, tokens): partial counts; the row with a null term has the numbers of documents and tokens."""

    def work(batches):
        held, n = [], 0

        def flush():
            terms, df = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64)), pa.array(np.zeros(len(terms), np.int64)), pa.array(np.zeros(len(terms), np.int64))], names=["term", "df", "docs", "tokens"])

        docs_, tokens = 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms, tf = term_counts(text)
                held.append(terms)
                n += len(terms)
                docs_ += 1
                tokens += int(tf.sum())
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([x], pa.int64()) for x in (0, docs_, tokens))], names=["term", "df", "docs", "tokens"])

    return docs.select("text").mapInArrow(work, "term long, df long, docs long, tokens long")


class Shard:
    """Inverted index of some documents; add() takes them by rising id.

    touched and held count the postings that queries read, and those of their
    terms altogether.
    """

    def __init__(self, average: float):
        self.average, self.ids, self.parts, self.tokens = average, [], [], 0
        self.touched = self.held = 0

    def add(self, doc_id, terms: np.ndarray, tf: np.ndarray) -> None:
        if len(terms):  # others match nothing
            self.parts.append((terms, tf.astype(np.int32)))
            self.ids.append(doc_id)
            self.tokens += int(tf.sum())

    def seal(self) -> None:
        count = len(self.parts)
        # like documents beside each other: by their two most frequent terms
        likeness = np.zeros((2, count), np.uint64)
        for i, (t, f) in enumerate(self.parts):
            if len(t) > 1:
                top = np.argpartition(-f, 1)[:2]
                likeness[:, i] = t[top[np.argsort(-f[top], kind="stable")]]
        self.order = np.lexsort((likeness[1], likeness[0]))  # arrival, that is id, of each number
        self.parts = [self.parts[i] for i in self.order.tolist()]
        n = np.array([len(t) for t, _ in self.parts], np.int64)
        length = np.array([tf.sum() for _, tf in self.parts], np.float64)
        terms = np.concatenate([t for t, _ in self.parts]) if self.parts else np.empty(0, np.uint64)
        tf = np.concatenate([f for _, f in self.parts]) if self.parts else np.empty(0, np.int32)
        self.parts = []
        order = np.argsort(terms, kind="stable")
        terms, tf = terms[order], tf[order].astype(np.float64)
        doc = np.repeat(np.arange(count), n)[order]
        del order
        norm = K1 * (1 - B + B * length / max(self.average, 1e-300))
        value = tf * (K1 + 1)
        tf += norm[doc]
        value /= tf
        del tf
        cut = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
        self.terms, self.df = terms[cut], np.diff(np.append(cut, len(terms)))
        self.blocks = -(-count // BLOCK)
        self.width = self.blocks * BLOCK
        # frequent terms have a row of the grid (in single precision) and of its exact values, the most frequent first where it has no room for all
        wide = np.flatnonzero(self.df >= max(FREQUENT * count, 16))
        wide = wide[np.argsort(-self.df[wide], kind="stable")[: GRID // max(1, self.width)]]
        self.column = np.full(len(self.terms), -1)
        self.column[wide] = np.arange(len(wide))
        column = np.repeat(self.column, self.df)
        self.exact = np.zeros((self.width, len(wide)))
        self.exact[doc[column >= 0], column[column >= 0]] = value[column >= 0]
        self.grid = np.ascontiguousarray(self.exact.T, np.float32)
        # what a sum of so many numbers of single precision can be off by, as a share of it
        self.off = 2.0**-23 * (len(wide) + 16)
        first = np.arange(0, self.blocks, WINDOW)
        self.windows = [(x, min(x + WINDOW, self.blocks)) for x in first.tolist()]
        self.block_max = self.grid.reshape(len(wide), self.blocks, BLOCK).max(axis=2) if self.blocks else np.empty((0, 0))
        self.window_max = np.maximum.reduceat(self.block_max, first, axis=1) if self.blocks else self.block_max
        self.filled = np.count_nonzero(self.grid.reshape(len(wide), self.blocks, BLOCK), axis=2) if self.blocks else self.block_max
        # the others have postings; a run is those of one term in one window
        self.doc, self.value = doc[column < 0].astype(np.int32), value[column < 0]
        term = np.repeat(np.arange(len(self.terms)), self.df)[column < 0]
        window = self.doc // (BLOCK * WINDOW)
        at = np.ones(len(term), bool)
        at[1:] = (term[1:] != term[:-1]) | (window[1:] != window[:-1])
        start = np.flatnonzero(at)
        self.run, self.run_len, self.run_window = start, np.diff(np.append(start, len(term))), window[start]
        self.run_max = np.maximum.reduceat(self.value, start) if len(start) else np.empty(0)
        self.start = np.searchsorted(term, np.arange(len(self.terms)))
        self.run_start = np.searchsorted(term[start], np.arange(len(self.terms) + 1))
        self.count = np.arange(len(self.doc))
        self.rows = int(np.clip(CELLS // max(1, self.width), 1, PACKED))
        self.read, self.total = np.zeros((self.rows, self.width)), np.zeros((self.rows, self.width), np.float32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The shard's numbers of terms, -1 for those that it hasn't."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k best (arrival, score) of one query, exactly: by falling score, then arrival."""
        _, arrival, score = self.best(np.array([len(terms)]), self.find(terms), weights, k, np.zeros(1))
        return list(zip(arrival.tolist(), score.tolist()))

    def best(self, sizes: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (query, arrival, score) of each query, exactly: by query, falling score, then arrival.

        Queries are sizes of terms (numbers by find()) with weights; documents
        below a query's floor, its k-th score elsewhere, may be left out.
        """
        query = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
        at, weight = at[at >= 0], weight[at >= 0]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for lo in range(0, len(sizes) if len(at) else 0, self.rows):
            a, b = np.searchsorted(query, [lo, lo + self.rows])
            if b > a:
                q, arrival, score = self._some(query[a:b] - lo, at[a:b], weight[a:b], k, floor[lo : lo + self.rows])
                out.append((q + lo, arrival, score))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _some(self, query: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """best() of so many queries as are looked up side by side.

        Windows whose maxima add up to less than the k-th score so far are
        passed over without reading a posting (the shallow move).  In the
        others the terms up to the pivot, the rare ones, are read.  The
        frequent ones are read, window by window and for all queries at once,
        where the best score so far of some block and their maxima there can
        still reach the k-th score; their sums are in single precision, which
        the bounds allow for, and the documents found are scored again.  At
        least k documents have the k-th largest of the blocks' best scores.
        """
        m = len(floor)
        self.held += int(self.df[at].sum())
        frequent = self.column[at] >= 0
        w = np.zeros((m, len(self.grid)))
        w[query[frequent], self.column[at[frequent]]] = weight[frequent]
        query, at, weight = query[~frequent], at[~frequent], weight[~frequent]
        bound = w @ self.window_max
        if floor.any():
            n_runs = self.run_start[at + 1] - self.run_start[at]
            runs = np.repeat(self.run_start[at] - (np.cumsum(n_runs) - n_runs), n_runs)
            runs += np.arange(len(runs))
            of = np.repeat(query, n_runs)
            place = of * len(self.windows) + self.run_window[runs]
            bound += np.bincount(place, self.run_max[runs] * np.repeat(weight, n_runs), bound.size).reshape(m, -1)
            open_ = (bound > 0) & (bound >= floor[:, None] - SLACK)
            run_ends = np.searchsorted(of, np.arange(m + 1)).tolist()
        else:
            open_ = np.ones(bound.shape, bool)
        everywhere = open_.all(axis=1).tolist()

        # in double precision, a query at a time: its arrays stay in the cache
        read, total = self.read[:m], self.total[:m]
        ends = np.searchsorted(query, np.arange(m + 1)).tolist()
        for r in range(m):
            terms, x = at[ends[r] : ends[r + 1]], weight[ends[r] : ends[r + 1]]
            first, size = self.start[terms], self.df[terms]
            if not everywhere[r]:
                own = runs[run_ends[r] : run_ends[r + 1]]
                go = open_[r, self.run_window[own]]
                x, own = np.repeat(x, n_runs[ends[r] : ends[r + 1]])[go], own[go]
                first, size = self.run[own], self.run_len[own]
            i = np.repeat(first - (np.cumsum(size) - size), size)
            i += self.count[: len(i)]
            value = np.repeat(x, size)
            value *= self.value.take(i)
            read[r] = np.bincount(self.doc.take(i), value, self.width)
            self.touched += len(i)
        total[:] = read

        def raised() -> np.ndarray:
            least = tops if self.blocks >= k else total
            return np.maximum(floor, np.partition(least, -k, axis=1)[:, -k] * (1 - self.off)) if least.shape[1] >= k else floor

        tops = total.reshape(m, self.blocks, BLOCK).max(axis=2)
        floor, single, asked = raised(), w.astype(np.float32), w > 0
        more = single @ self.block_max
        likely = np.maximum.reduceat(tops + more, [a for a, _ in self.windows], axis=1).sum(axis=0)
        for j in np.argsort(-likely, kind="stable").tolist():
            first, last = self.windows[j]
            live = np.flatnonzero(open_[:, j])

            def can(a, b):
                return (more[live, a:b] > 0) & ((tops[live, a:b] + more[live, a:b]) * (1 + self.off) >= floor[live, None] - SLACK)

            # block by block where most blocks are passed over
            each = can(first, last)
            spans = [(first, last)] if 2 * np.count_nonzero(each) > each.size else [(x, x + 1) for x in (first + np.flatnonzero(each.any(axis=0))).tolist()]
            for a, b in spans:
                rows, docs = live[(each if b - a > 1 else can(a, b)).any(axis=1)], slice(a * BLOCK, b * BLOCK)
                if not len(rows):
                    continue
                if len(rows) == m:
                    rows = slice(None)
                part = single[rows] @ self.grid[:, docs]
                part += total[rows, docs]
                total[rows, docs] = part
                tops[rows, a:b] = part.reshape(len(part), b - a, BLOCK).max(axis=2)
                floor = raised()
                self.touched += int(asked[rows].sum(axis=0) @ self.filled[:, a:b].sum(axis=1))
        q, d = np.nonzero(total >= np.maximum((floor - SLACK) * (1 - self.off), 1e-30)[:, None].astype(np.float32))
        # at least k have the k-th of the sums found; what reaches it is scored again, in double precision
        by = np.lexsort((-total[q, d], q))
        q, d = q[by], d[by]
        sums, start = total[q, d].astype(float), np.searchsorted(q, q)
        kth = np.minimum(start + k, np.searchsorted(q, q, "right")) - 1
        near = (sums >= sums[kth] * (1 - 2 * self.off) - SLACK) | (kth - start < k - 1)
        q, d = q[near], d[near]
        score, step = read[q, d], 1 + CELLS // max(1, len(self.grid))
        for lo in range(0, len(q), step):
            score[lo : lo + step] += np.einsum("ij,ij->i", w[q[lo : lo + step]], self.exact[d[lo : lo + step]])
        return _cut(k, q, self.order[d], np.round(score, DIGITS))


def _cut(k: int, query: np.ndarray, place: np.ndarray, score: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k rows of each query that come first by falling score, then place; scores of 0 are none."""
    order = np.lexsort((place, -score, query))
    order = order[score[order] > 0]
    q = query[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return tuple(x[order] for x in (query, place, score, *more))


#: Queries are packed about so many to a row.
PACKED = 256


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) for queries (doc_id, text) against all rows of docs.

    Null and empty texts match nothing and count as documents of length 0; a
    query without terms has no rows, one whose terms few documents hold has
    fewer than k.  A document finds itself.  Rows that repeat a doc_id are
    documents of their own; each distinct text of a query's id is a query of
    its own, with k rows under that id; null ids come last among ties as
    documents, and aren't asked as queries.  Empty tables give no rows; other
    columns are ignored.

    Every query meets every shard: a block of queries, with its distinct terms
    once, is sent to each task, which looks it up in one of its shards after
    the other; the k-th score of those before is its floor in the next.
    """
    freq = materialize(_frequencies(docs).groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "bm25-terms")
    whole = freq.filter("term is null").select("docs", "tokens").first()
    n, tokens = (whole["docs"], whole["tokens"]) if whole else (0, 0)
    average, shards = tokens / max(1, n), max(1, -(-tokens // SHARD_TOKENS))
    tasks = min(shards, TASKS * docs.sparkSession.sparkContext.defaultParallelism)

    def terms_of(batches):
        for batch in batches:
            found = [term_counts(t)[0] for t in batch.column(2).to_pylist()]
            n_ = [len(t) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n_)), pa.array(np.repeat(batch.column(1).to_numpy(), n_)), pa.array((np.concatenate(found) if found else np.empty(0, np.uint64)).view(np.int64))], names=["query_id", "part", "term"])

    asked = queries.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("query_id"), "text").distinct()
    asked = asked.select("query_id", F.xxhash64("text").alias("part"), "text")  # part tells apart the texts of one id
    asked = asked.mapInArrow(terms_of, "query_id long, part long, term long").join(freq.filter("term is not null").select("term", "df"), "term")
    asked = materialize(asked.groupBy("query_id", "part").agg(F.collect_list(F.struct("term", "df")).alias("terms")), "bm25-queries")  # as many as one text has
    rows = asked.count()

    def packed(batches):
        held: list[tuple] = []

        def blob():
            sizes = np.array([len(t) for _, _, t, _ in held])
            terms, df = np.concatenate([t for _, _, t, _ in held]).view(np.uint64), np.concatenate([d for *_, d in held])
            names, first, back = np.unique(terms, return_index=True, return_inverse=True)
            ids, parts = (np.array(x, np.int64).view(np.uint64) for x in ([q for q, *_ in held], [p for _, p, *_ in held]))
            out = pack(ids, parts, sizes, steps(names), df[first], back)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["blob"])

        for batch in batches:
            for i, (query, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                terms = batch.column(2)[i].values
                held.append((query, part, terms.field(0).to_numpy(), terms.field(1).to_numpy()))
                if len(held) == PACKED:
                    yield blob()
        if held:
            yield blob()

    blobs = asked.repartition(max(1, rows // PACKED)).mapInArrow(packed, "blob binary")
    left = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(tasks)).cast("int").alias("task"), F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("id"), "text", F.lit(None).cast("binary").alias("blob"))
    right = blobs.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "blob")
    both = left.unionByName(right).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "kind", F.col("id").asc_nulls_last())

    def work(batches):
        """A task's queries come first and are held; its documents are a shard as soon as they have SHARD_TOKENS."""
        now, shard, held, before = None, Shard(average), [], 0

        def looked_up():
            nonlocal shard, before
            shard.seal()
            ids, null = np.array([x or 0 for x in shard.ids], np.int64), np.array([x is None for x in shard.ids], bool)
            for blob in held:
                _, _, sizes, names, df, back = unpack(blob[0])
                at, weight = shard.find(np.cumsum(names.astype(np.uint64))), np.log1p((n - df + 0.5) / (df + 0.5))
                query, place, score, *_ = best = blob[1]
                full = np.flatnonzero(np.searchsorted(query, query, "right") - np.searchsorted(query, query) == k)
                floor = np.zeros(len(sizes))
                floor[query[full]] = score[full]  # the last of a query is its k-th
                q, arrival, s = shard.best(sizes, at[back], weight[back], k, floor)
                found = (q, arrival + before, s, ids[arrival], null[arrival])
                blob[1] = _cut(k, *(np.concatenate(x) for x in zip(best, found)))
            before += len(shard.ids)
            shard = Shard(average)

        def results():
            for blob, (query, _, score, id_, null) in held:
                ids, parts = (x.astype(np.uint64).view(np.int64) for x in unpack(blob)[:2])
                asked, first = np.unique(query, return_index=True)
                if len(asked):
                    ends = pa.array(np.append(first, len(query)), pa.int32())
                    lists = (pa.ListArray.from_arrays(ends, x) for x in (pa.array(id_, pa.int64(), mask=null), pa.array(score)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array(parts[asked]), *lists], names=["query_id", "part", "ids", "scores"])

        for batch in batches:
            text = batch.column(3)
            for r, (number, kind, id_) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if number != now:
                    if shard.ids:
                        looked_up()
                    yield from results()
                    now, held, before = number, [], 0
                if kind == 0:
                    none = np.empty(0, np.int64)
                    held.append([batch.column(4)[r].as_py(), (none, none, np.empty(0), none, np.empty(0, bool))])
                elif held:
                    shard.add(id_, *term_counts(text[r].as_py()))
                    if shard.tokens >= SHARD_TOKENS:
                        looked_up()
        if shard.ids:
            looked_up()
        yield from results()

    def merge(batches):
        """The k best of each query's tasks, which come one after the other; only k are held."""
        now, best, done = None, [], []
        for batch in batches:
            for query, part, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
                if (query, part) != now:
                    done += [(now[0], i + 1, d, -s) for i, (s, _, d) in enumerate(best)]
                    now, best = (query, part), []
                # null ids last; two of them are alike
                best = sorted([*best, *((-s, d is None, d) for s, d in zip(scores, ids))], key=lambda x: (x[0], x[1], x[2] or 0))[:k]
            if done:
                yield _ranked(done)
                done = []
        if best:
            yield _ranked([(now[0], i + 1, d, -s) for i, (s, _, d) in enumerate(best)])

    # a row per query and task
    found = both.mapInArrow(work, "query_id long, part long, ids array<long>, scores array<double>")
    return found.repartition("query_id", "part").sortWithinPartitions("query_id", "part").mapInArrow(merge, "query_id long, rank int, doc_id long, score double")


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["query_id", "rank", "doc_id", "score"])


#: At this size of the tables SQL can score all pairs.
ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM len) / (SELECT count(*) FROM documents) AS avg),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.doc_id AS query_id, tf.doc_id, round(sum(ln(1 + (g.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.len / g.avg))), 6) AS score
  FROM tf q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id CROSS JOIN g WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS "rank" FROM s)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", doc_id, score FROM r WHERE "rank" <= 10
"""
