"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Only lengths decide a packing, and a length is at most the sequence's size, so
the plan is made on the histogram of lengths: a bounded table however many
documents there are.  It consists of runs: so many sequences from one number
on, each taking one piece of some length at one offset.  Pieces then find their
run by their rank among those of equal length.  A task that cuts documents
numbers its pieces of each length; the counts by task and length give the rank
its first has, and no piece is sent to another task.  Where those counts are
too many to be sent to every worker, ranks come from counts of salted groups,
so a length that a third of all pieces share is ranked in many tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

TOKENIZER = "word_bpe_49k.json"
SIZE = 4096
#: Words, and runs of letters, whose ids a Python worker remembers in each of two generations.
REMEMBERED = 120_000
#: Salted groups of one length hold about so many pieces.
GROUP = 1_000
#: Counts by task and length that are sent to every worker; where there are more, pieces are ranked by salted groups.
COUNTS = 1_000_000
#: Rows of texts that Spark's Parquet reader decodes at a time where the session has its default of 4,096, whose vectors take much of an executor's heap.
READ_ROWS = 256
#: Letters of Latin-1 that Unicode composes and lower-cases one by one, then marks other than apostrophes.
LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:%&*$#|()-]*)")
MARKS = b".,!?;:%&*$#|()-"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encode(path: str, text: str) -> bytes:
    return np.asarray(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _alphabet() -> dict[int, str]:
    """Bytes as the byte-level vocabulary writes them: printable ones of Latin-1 as themselves, the others numbered on from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


ALPHABET = _alphabet()


class Remembered(dict):
    """What found(key) gives, of the keys asked for lately: a generation that is full becomes the old one, and what is asked for again moves on."""

    def __init__(self, size: int):
        self.size, self.old = size, {}

    def __missing__(self, key: bytes) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.found(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class RunIds(Remembered):
    """Ids of a run of lower-cased letters or of marks: one word to the model, with nothing left to normalize or to split."""

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        self.tokenize = _tokenizer(path).model.tokenize

    def found(self, run: bytes) -> bytes:
        plain = run.decode() if run.isascii() else run.decode("latin-1").translate(ALPHABET)
        return array("I", [t.id for t in self.tokenize(plain)]).tobytes()


class WordIds(Remembered):
    """Ids of a word between white space, as little-endian 32-bit bytes.

    The tokenizer drops white space and splits at it before anything else, so a
    text's ids are its words' ids in order.  It also splits between a run of
    letters and marks, and lower-cases: a Latin word with marks behind it is
    looked up by its lower-cased letters.
    """

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        self.path, self.runs = path, RunIds(path)

    def found(self, word: bytes) -> bytes:
        letters = word.rstrip(MARKS)
        if letters.isalpha():  # ASCII
            marks = word[len(letters) :]
            return self.runs[letters.lower()] + self.runs[marks] if marks else self.runs[letters.lower()]
        text = word.decode()
        m = LATIN.fullmatch(text) if len(text) <= 64 else None
        if not m:
            return _encode(self.path, text)
        out = self.runs[m[1].lower().encode()]
        return out + self.runs[m[2].encode()] if m[2] else out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory a Python worker, for all of its tasks."""
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): each document's ids and end_id, cut only where longer than size.

    Null text is empty: its one piece is end_id alone.  part is the task that
    cut the piece, nth the number of pieces of its length before it there: they
    hold once they are written, as a task that runs again may number anew.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    end = np.asarray([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        ids, part_, seen = word_ids(path), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, len(b), 1000)):
            docs_, piece, start, length, crc, nth = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = b"".join(map(ids.__getitem__, (text or "").encode().split())) + end
                for k, a in enumerate(range(0, len(data), 4 * size)):
                    part = data[a : a + 4 * size]
                    n = len(part) // 4
                    docs_.append(doc), piece.append(k), start.append(a // 4), length.append(n), crc.append(zlib.crc32(part)), nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(docs_, batch.column(0).type), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc, [part_] * len(nth), nth))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long")


def dominating(left: np.ndarray, a: int, size: int) -> tuple[int, ...]:
    """A set of at most three pieces, one of them of length a, that dominates every other set with a; () if none is found.

    A set dominates another if the other's pieces can be dealt to its own so
    that none gets more than its length (Martello and Toth): some best packing
    then has the first.  left counts the pieces of each length.  Beside a
    piece of length a the criterion holds for

    * the piece alone, where no other fits;
    * it and the largest that fits, b, where b fills the sequence, or no two
      others fit, or no three fit and no two are longer together than b;
    * it, b and c, the two that fill it best, where no three fit and every
      fitting pair's shorter piece is at most c.
    """
    others = left[: size - a + 1].copy()
    if a <= size - a:
        others[a] -= 1
    lengths = np.flatnonzero(others > 0)
    if not len(lengths):
        return (a,)
    free, b = size - a, int(lengths[-1])
    if b == free:
        return a, b
    shortest = np.repeat(lengths[:3], np.minimum(others[lengths[:3]], 3))[:3]
    if len(shortest) < 2 or shortest[:2].sum() > free:
        return a, b
    if len(shortest) == 3 and shortest.sum() <= free:
        return ()
    # the longest partner of each length
    at = np.searchsorted(lengths, np.minimum(free - lengths, lengths), "right") - 1
    own = (at >= 0) & (lengths[at] == lengths) & (others[lengths] < 2)
    at -= own
    sums = np.where(at >= 0, lengths + lengths[at], 0)
    best = int(sums.max())
    if best <= b:
        return a, b
    c = best - b
    if not (0 < c <= b and others[c] > (b == c)):
        return ()
    longer = lengths[lengths > c]
    longer = np.repeat(longer[:2], np.minimum(others[longer[:2]], 2))[:2]
    return (a, b, c) if len(longer) < 2 or longer.sum() > free else ()


def least_sequences(counts: dict[int, int], size: int = SIZE) -> int:
    """A lower bound on the sequences of any packing: for each k, pieces over size - k are alone, and what pieces of at least k leave no room for among those over half."""
    n = np.zeros(size + 1, np.int64)
    for length, m in counts.items():
        n[length] = m
    mass, upto, total = np.cumsum(n * np.arange(size + 1)), np.cumsum(n), int(n.sum())
    best = -(-int(mass[-1]) // size)
    for k in range(1, size // 2 + 1):
        alone, big = total - int(upto[size - k]), int(upto[size - k] - upto[size // 2])
        spare = big * size - int(mass[size - k] - mass[size // 2])
        best = max(best, alone + big + max(0, -(-(int(mass[size // 2] - mass[k - 1]) - spare) // size)))
    return best


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, how many, offset) that place every piece of the histogram counts.

    Reduction: sets that dominate all others with their largest piece are fixed,
    as many times as the counts allow, until no length has one.  The rest is
    packed by best fit, longest first: each length goes to the sequences with
    the least sufficient room, a whole class of equal room at a time, then to
    new ones.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    fresh = 0

    def place(length: int, first: int, n: int, offset: int) -> None:
        runs.append((length, int(used[length]), first, n, offset))
        used[length] += n
        left[length] -= n

    fixed = True
    while fixed:
        fixed = False
        for a in np.flatnonzero(left)[::-1].tolist():
            while left[a] and (chosen := dominating(left, a, size)):
                m = min(int(left[x]) // k for x, k in Counter(chosen).items())
                offset = 0
                for x in chosen:
                    place(x, fresh, m, offset)
                    offset += x
                fresh += m
                fixed = True
    for a in range(size, 0, -1):
        need = int(left[a])
        while need:
            fits = [r for r in room if r >= a]
            if not fits:
                break
            r = min(fits)
            first, n = room[r].pop()
            if not room[r]:
                del room[r]
            m = min(n, need)
            if n > m:
                room.setdefault(r, []).append((first + m, n - m))
            place(a, first, m, size - r)
            if r > a:
                room.setdefault(r - a, []).append((first, m))
            need -= m
        if need:  # new sequences take as many of this length as fit
            each = size // a
            whole, rest = divmod(need, each)
            for k in range(each):
                if whole:
                    place(a, fresh, whole, k * a)
            if whole and size - each * a:
                room.setdefault(size - each * a, []).append((fresh, whole))
            fresh += whole
            for k in range(rest):
                place(a, fresh, 1, k * a)
            if rest:
                if size - rest * a:
                    room.setdefault(size - rest * a, []).append((fresh, 1))
                fresh += 1
    return runs


@contextmanager
def short_reads(spark: SparkSession) -> Iterator[None]:
    """READ_ROWS holds for what is run meanwhile, unless the session has a number of its own."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, READ_ROWS)
    try:
        yield
    finally:
        spark.conf.unset(key)


def first_ranks(p: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each task and length of p: part * (size + 1) + length, ascending, and how many pieces of that length earlier tasks have."""
    t = p.groupBy("part", "length").agg(F.count("*").alias("n")).toArrow()
    part, length, n = (t.column(c).to_numpy() for c in ("part", "length", "n"))
    order = np.lexsort((part, length))
    part, length, n = part[order], length[order], n[order]
    before = np.cumsum(n) - n
    before -= before[np.searchsorted(length, length)]
    keys = part * (size + 1) + length
    order = np.argsort(keys)
    return keys[order], before[order]


def salted_ranks(p: DataFrame, counts: dict[int, int]) -> DataFrame:
    """p with each piece's rank among those of its length, by an exchange of all pieces and counts of salted groups."""
    many = F.broadcast(p.sparkSession.createDataFrame([(k, -(-n // GROUP)) for k, n in counts.items()], "length long, salts long"))  # size rows at most
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    p = p.join(many, "length").withColumn("salt", F.pmod(F.xxhash64(*order, "part", "nth"), F.col("salts")))
    groups = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = groups.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order, "part", "nth")) - 1).join(base, ["length", "salt"])
    return ranked.withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id; repeated rows and null ids are
    packed each; an empty table gives no rows; other columns are ignored.  The
    histogram of lengths (size rows at most) and COUNTS counts at most are all
    that reaches the driver.
    """
    spark = docs.sparkSession
    with short_reads(spark):
        p = materialize(token_pieces(docs, path, size), "pieces")
    kind = p.schema["doc_id"].dataType.simpleString()
    found = p.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("nth") == 0).alias("parts")).collect()
    counts = {r["length"]: r["n"] for r in found}
    runs = plan(counts, size)
    by: dict[int, tuple[list, list, list]] = {}
    for length, rank, first, _, offset in sorted(runs):
        for c, v in zip(by.setdefault(length, ([], [], [])), (rank, first, offset)):
            c.append(v)
    few = sum(r["parts"] for r in found) <= COUNTS
    packed = spark.sparkContext.broadcast(({k: tuple(np.asarray(c, np.int64) for c in v) for k, v in by.items()}, first_ranks(p, size) if few else None))
    ranked = p.withColumnRenamed("nth", "rank") if few else salted_ranks(p, counts)

    def work(batches):
        plan_, firsts_ = packed.value
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy() for c in (3, 5, 6))
            if firsts_:
                rank = rank + firsts_[1][np.searchsorted(firsts_[0], part * (size + 1) + length)]
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                ranks, firsts, offsets = plan_[int(k)]
                i = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at], offset[at] = firsts[i] + rank[at] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    cols = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")
    return cols.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
