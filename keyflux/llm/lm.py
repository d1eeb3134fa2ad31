"""Hierarchical Pitman-Yor language model, fitted by Gibbs sweeps over the whole corpus.

Words (what ASCII white space separates, A-Z lower-cased) are customers of the
restaurant of the word before them (a text's first word, of the restaurant of
the empty word).  Every table of a context restaurant sends its word as a
customer to the word restaurant, the parent that all contexts share.  Its base
is a spelling model: a tree of context restaurants over the bytes of a word, a
context being the two bytes before, its parent the byte before, its parent the
empty context, whose base is uniform over 256 bytes and the end of a word.
Every table of the word restaurant sends its spelling to the tree as customers,
every table of a spelling context one to its parent.  Whether a text ends after
a token does not depend on the token: ends have one probability.

A sweep unseats all customers of each dish and seats them again, one by one, by
the Chinese-restaurant rule, given the tables of all other dishes and the
parent's predictive probabilities.  Dishes are resampled in parallel given the
last sweep's totals.  A pair of words that occurs once has one table whatever
the sweep, so only pairs that occur again are reseated.  Tables and predictive
probabilities are averaged over the sweeps after burn-in.

The corpus is encoded once, in chunks with a vocabulary each.  Pairs of words
are dealt to shards by hash of the pair, words by hash of the word, so that
neither a frequent word nor a frequent context is one task's.  Shards and chunks
exchange packed arrays, not rows: a chunk sends each shard its pairs with their
counts and in the end gets an answer aligned to them; a shard of pairs sends a
shard of words the tables of the words it holds, and gets back probabilities and
totals in the same order.  Words are told apart by 64 bits of hash.  Only the
spelling tree (65,536 contexts of 257 symbols at most) reaches the driver and is
broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize
from .minhash import GOLDEN, spread
from .packed import pack, steps, unpack

SYMBOLS = 257  # bytes, and the end of a word
#: Training and other tokens of a chunk, and of a shard.
CHUNK_TOKENS, SHARD_TOKENS = 2_500_000, 3_000_000
BURN_IN, KEPT = 2, 3
STRENGTH = 1.0
_U = np.uint64


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --- words -------------------------------------------------------------------


def _strings(words: list[bytes] | pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and joined bytes."""
    a = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    offsets = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    return np.diff(offsets), a.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(a) and offsets[-1] > offsets[0] else b""


def _binaries(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data or b"\0")])


def _bytes(a: np.ndarray | bytes) -> np.ndarray:
    return np.frombuffer(a, np.uint8)


# --- seating -----------------------------------------------------------------


def uniform(seed: np.ndarray, draw: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1), the same for the same seed and draw."""
    with np.errstate(over="ignore"):
        x = spread(seed + GOLDEN * (np.asarray(draw).astype(np.uint64) + _U(1)))
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


#: Dishes with more customers than this are seated one dish after the other, the others side by side.
FEW = 1024
#: From this customer on the way to a dish's next new table is drawn at once.
LATE = 1 << 16


def _seat_many(n: int, p: float, others: float, discount: float, seed: np.uint64, i: int, t: int) -> int:
    """Tables after n customers of one dish, of whom i sit at t.

    A block of customers is drawn against bounds that hold while it opens at
    most `most` tables; only those under their bound are then looked at one by
    one.  Late customers are rarely at a new table: the number that pass before
    the next one is drawn from its exact law, a ratio of gamma functions.
    """
    draw = n
    lgamma = math.lgamma
    while i < n and i < LATE:
        size = min(n - i, max(64, i // 2))
        a = (STRENGTH + discount * (others + t)) * p
        most = 16 + int(2 * size * a / (a + i - discount * t))
        u = uniform(seed, np.arange(draw, draw + size))
        draw += size
        at = np.arange(i, i + size)
        bound = (STRENGTH + discount * (others + t + most)) * p
        hits = np.flatnonzero(u < bound / (bound + np.maximum(at - discount * (t + most), 1e-300)))
        first, end = t, i + size
        for k, x in zip(hits.tolist(), u[hits].tolist()):
            a = (STRENGTH + discount * (others + t)) * p
            if x < a / (a + i + k - discount * t):
                t += 1
                if t - first == most:
                    end = i + k + 1
                    break
        i = end
    while i < n:
        a, x = (STRENGTH + discount * (others + t)) * p, i - discount * t
        goal = lgamma(x + a) - lgamma(x) - math.log(float(uniform(np.asarray(seed), draw)))
        draw += 1
        low, high = 0, n - i  # tables open with customer i + m for the least m that reaches the goal
        if lgamma(x + high + a) - lgamma(x + high) < goal:
            break
        while high - low > 1:
            mid = (low + high) // 2
            if lgamma(x + mid + a) - lgamma(x + mid) < goal:
                low = mid
            else:
                high = mid
        i, t = i + high, t + 1
    return t


def seat(n: np.ndarray, p: np.ndarray, others: np.ndarray | float, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables that n customers of each dish take, seated one by one.

    With i customers at t tables the next opens a table with odds
    (STRENGTH + discount * (others + t)) * p to i - discount * t.
    """
    t = np.ones(len(n), np.float64)
    others = np.broadcast_to(np.asarray(others, np.float64), n.shape)
    at = np.flatnonzero((n > 1) & (n <= FEW))
    i = 1
    while len(at):
        a = (STRENGTH + discount * (others[at] + t[at])) * p[at]
        t[at] += uniform(seed[at], i) < a / (a + i - discount * t[at])
        i += 1
        at = at[n[at] > i]
    for k in np.flatnonzero(n > FEW).tolist():
        t[k] = _seat_many(int(n[k]), float(p[k]), float(others[k]), discount, seed[k], 1, 1)
    return t.astype(np.int64)


# --- spelling tree -----------------------------------------------------------


@dataclass(frozen=True)
class Spelling:
    """row[context] is the row of `p` (log probabilities of symbols) of the context, or of its nearest seated ancestor."""

    row: np.ndarray
    p: np.ndarray

    @staticmethod
    def uniform() -> Spelling:
        return Spelling(np.zeros(1 << 16, np.int32), np.full((1, SYMBOLS), -math.log(SYMBOLS)))

    def log_p(self, contexts: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.p[self.row[contexts], symbols], starts, dtype=np.float64) if len(starts) else np.empty(0)


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and symbol of every byte of the words (binary) and of their ends; where each word starts."""
    lengths, data = _strings(words)
    n = lengths + 1
    stop = np.cumsum(n)
    symbols = np.zeros(int(stop[-1]) if len(n) else 0, np.int32)
    body = np.ones(len(symbols), bool)
    body[stop - 1] = False
    symbols[body] = _bytes(data)
    symbols[~body] = 256
    starts = stop - n
    place = np.arange(len(symbols)) - np.repeat(starts, n)

    def back(k: int) -> np.ndarray:
        out = np.zeros(len(symbols), np.int32)
        out[k:] = symbols[:-k] if k <= len(symbols) else 0
        out[place < k] = 0
        return out

    return (back(1) << 8) | back(2), symbols, starts


def discount_of(one: float, two: float) -> float:
    return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5


class Tree:
    """Seats of the context restaurants, leaf to root: (shift, cells, customers) a level; a cell is context * SYMBOLS + symbol."""

    SHIFTS = (0, 8, 16)

    def __init__(self, seed: int):
        self.seed, self.last = seed, None

    def sweep(self, cells: np.ndarray, n: np.ndarray) -> Spelling:
        """Resample all tables for the leaves' customers, then give the predictive probabilities."""
        self.seed += 1
        levels = []
        for depth, shift in enumerate(self.SHIFTS):
            context, symbol = cells // SYMBOLS, cells % SYMBOLS
            parent = context >> (self.SHIFTS[depth + 1] - shift) if depth + 1 < len(self.SHIFTS) else None
            names, at = np.unique(context, return_inverse=True)
            if parent is None:
                p = np.full(len(cells), 1 / SYMBOLS)
            elif self.last is None:  # before the first sweep: the parent's shares
                _, up = np.unique(parent, return_inverse=True)
                pc, back = np.unique(parent * SYMBOLS + symbol, return_inverse=True)
                p = np.bincount(back, n)[back] / np.bincount(up, n)[up]
            else:
                p = np.exp(self.last[depth + 1](parent, symbol))
            d = discount_of(int((n == 1).sum()), int((n == 2).sum()))
            kinds = np.bincount(at)[at] - 1  # a table at least for each other dish
            before = kinds if self.last is None else np.maximum(kinds, self._tables(depth, context) - 1)
            t = seat(n, p, before.astype(np.float64), d, spread(cells.astype(np.uint64) + _U(self.seed * 7919 + depth)))
            levels.append((context, symbol, n, t, d, names, at))
            if parent is not None:
                cells, back = np.unique(parent * SYMBOLS + symbol, return_inverse=True)
                n = np.bincount(back, t).astype(np.int64)
        self.totals = [(l[5], np.bincount(l[6], l[3])) for l in levels]
        # predictive probabilities, root to leaf
        rows_of: list[np.ndarray] = []
        p_up = np.full((1, SYMBOLS), 1 / SYMBOLS)
        row_up = np.zeros(1, np.int64)
        width = 1
        for depth in range(len(self.SHIFTS) - 1, -1, -1):
            context, symbol, n, t, d, names, at = levels[depth]
            bits = 16 - self.SHIFTS[depth]
            wide = 1 << bits
            up = row_up[np.arange(wide) >> (bits - int(math.log2(width)))] if depth < len(self.SHIFTS) - 1 else np.zeros(1, np.int64)
            c, tt = np.bincount(at, n), np.bincount(at, t)
            own = p_up[up[names]] * ((STRENGTH + d * tt) / (STRENGTH + c))[:, None]
            own[at, symbol] += (n - d * t) / (STRENGTH + c[at])
            row = up.copy()
            row[names] = len(p_up) + np.arange(len(names))
            p_up, row_up, width = np.concatenate([p_up, own]), row, wide
            rows_of.append(row)
        log_p = np.log(p_up).astype(np.float32)
        by_depth = rows_of[::-1]
        self.last = [None] + [(lambda context, symbol, row=row: log_p[row[context], symbol].astype(np.float64)) for row in by_depth[1:]]
        return Spelling(by_depth[0].astype(np.int32), log_p)

    def _tables(self, depth: int, context: np.ndarray) -> np.ndarray:
        names, tables = self.totals[depth]
        at = np.minimum(np.searchsorted(names, context), len(names) - 1)
        return np.where(names[at] == context, tables[at], 1)


# --- chunks ------------------------------------------------------------------


def encode(docs: DataFrame) -> DataFrame:
    """Rows (chunk, tokens, ends, texts, words), one per chunk.

    texts packs doc_id, whether it is null, whether it is held out, words and
    word numbers of each text; words packs counts in training texts, counts
    there before another word, and the words themselves by falling count.
    Word 0 is the empty word, which is before each text.
    """

    def work(batches):
        class Numbers(dict):
            def __missing__(self, word):
                self[word] = len(self)
                return len(self) - 1

        def chunk():
            size = len(numbers)
            many = np.array([len(t) for t in tokens], np.int64)
            now = np.concatenate([np.empty(0, np.int32), *tokens])
            order = np.argsort(-np.bincount(now, minlength=size), kind="stable")
            order = np.concatenate([[0], order[order != 0]])
            place = np.empty(size, np.int32)
            place[order] = np.arange(size)
            now = place[now]
            learned = np.repeat(~np.array(held, bool), many)
            n = np.bincount(now[learned], minlength=size)
            last = np.zeros(len(now), np.int32)
            last[1:] = now[:-1]
            last[(np.cumsum(many) - many)[many > 0]] = 0
            m = np.bincount(last[learned], minlength=size)
            words = list(numbers)
            lengths, data = _strings([words[i] for i in order.tolist()])
            id_ = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
            texts = pack(id_, np.array([i is None for i in ids]), np.array(held, bool), many, now)
            number = TaskContext.get().partitionId() << 32 | made
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((number, pa.int64()), (len(now), pa.int64()), (len(ids) - sum(held), pa.int64()), (texts, pa.binary()), (pack(n, m, lengths, _bytes(data)), pa.binary()))], names=["chunk", "tokens", "ends", "texts", "words"])

        made, numbers, ids, held, tokens, total = 0, Numbers({b"": 0}), [], [], [], 0
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                tokens += [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in ((t or "").encode().lower().split() for t in part.column(1).to_pylist())]
                ids += part.column(0).to_pylist()
                held += part.column(2).to_pylist()
                total += sum(map(len, tokens[-len(part) :])) + len(part)
                if total >= CHUNK_TOKENS:
                    yield from chunk()
                    made, numbers, ids, held, tokens, total = made + 1, Numbers({b"": 0}), [], [], [], 0
        if ids:
            yield from chunk()

    return docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held")).mapInArrow(work, "chunk long, tokens long, ends long, texts binary, words binary")


def share(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; rises with the hash."""
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


class Chunk:
    """A chunk's words in order of their hashes, and its texts in those numbers."""

    def __init__(self, texts: bytes, words: bytes):
        n, m, lengths, data = unpack(words)
        all_ = _binaries(lengths, data.astype(np.uint8).tobytes())
        h = np.fromiter(map(xxhash.xxh64_intdigest, all_.to_pylist()), np.uint64, len(all_))
        order = np.argsort(h)
        self.h, self.n, self.m, self.words = h[order], n[order], m[order], all_.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, null, held, self.many, tokens = unpack(texts)
        self.ids, self.null, self.held = ids.astype(np.uint64).view(np.int64), null.astype(bool), held.astype(bool)
        self.start = int(place[0])  # the empty word
        place = place.astype(np.int32)
        self.tokens = place[tokens]
        del tokens, ids, null, held
        both = self.before(0, len(self.tokens)).astype(np.int64)
        both *= len(order)
        both += self.tokens
        both *= 2
        both += np.repeat(~self.held, self.many)
        both.sort()
        # distinct pairs by rising number, with their counts in training texts
        new = np.ones(len(both), bool)
        new[1:] = both[1:] >> 1 != both[:-1] >> 1
        cut = np.flatnonzero(new)
        self.pairs = both[cut] >> 1
        both &= 1
        self.count = np.add.reduceat(both, cut) if len(cut) else cut

    def before(self, a: int, b: int) -> np.ndarray:
        """The words before tokens a to b, which begin and end with texts."""
        out = np.empty(b - a, np.int32)
        out[1:] = self.tokens[a : b - 1] if b > a else 0
        starts = np.cumsum(self.many) - self.many
        starts = starts[(self.many > 0) & (starts >= a) & (starts < b)]
        out[starts - a] = self.start
        return out

    def dealt(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """The places of each shard's pairs in `pairs`."""
        size = len(self.h)
        with np.errstate(over="ignore"):
            u, w = np.divmod(self.pairs, size)
            to = share(spread(self.h[u] * GOLDEN + self.h[w]), shards)
            del u, w
        if shards <= 1 << 16:
            to = to.astype(np.uint16)  # sorted by radix
        order = np.argsort(to, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=shards))])
        for k in range(shards):
            if cuts[k] < cuts[k + 1]:
                yield k, order[cuts[k] : cuts[k + 1]]


# --- messages ----------------------------------------------------------------

MESSAGE = "dest int, kind int, other long, blob binary, x double, y double, z double, v double"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.float64()] * 4)
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
# Kinds of rows: what a shard keeps, what it answers to, and what is sent.
WORDS, WORD_ANSWER, PAIRS, PAIR_ANSWER, ASK, ANSWER, TABLES, SEATED, REPLY, SEATS, LEAVES, TOTAL = range(12)


def _message(dest: int, kind: int, other: int, blob: bytes | None, *numbers: float) -> tuple:
    return dest, kind, other, blob, *numbers, *[0.0] * (4 - len(numbers))


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3] or b"") + 50
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)


def _by_dest(work):
    """work(dest, {kind: [(other, blob)]}) for each destination's rows, which come one after the other."""

    def run(batches):
        now, held = None, {}
        for batch in batches:
            for dest, kind, other, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if dest != now:
                    if held:
                        yield from _batches(work(now, held))
                    now, held = dest, {}
                held.setdefault(kind, []).append((other, blob))
        if held:
            yield from _batches(work(now, held))

    return run


def _dealt(rows: DataFrame, parts: int, work, schema: str = MESSAGE) -> DataFrame:
    """Destinations are numbers below parts: each is a task of its own."""
    return rows.repartitionById(parts, F.col("dest")).sortWithinPartitions("dest", "kind", "other").mapInArrow(_by_dest(work) if schema == MESSAGE else work, schema)


def _sent(code: DataFrame, shards: int) -> DataFrame:
    """What chunks send: their words to the shards of words, their pairs to the shards of pairs."""

    def rows(number: int, c: Chunk) -> Iterator[tuple]:
        cuts = np.searchsorted(share(c.h, shards), np.arange(shards + 1))
        for j in range(shards):
            a, b = cuts[j], cuts[j + 1]
            if a < b:
                lengths, data = _strings(c.words.slice(a, b - a))
                yield _message(j, WORDS, number, pack(steps(c.h[a:b]), c.n[a:b], c.m[a:b], lengths, _bytes(data)))
        place = np.empty(len(c.h), np.int64)
        for k, at in c.dealt(shards):
            u, w = np.divmod(c.pairs[at], len(c.h))
            used = np.zeros(len(c.h), bool)
            used[u] = used[w] = True
            names = np.flatnonzero(used)
            place[names] = np.arange(len(names))
            yield _message(k, PAIRS, number, pack(steps(c.h[names]), steps(place[u]), place[w], c.count[at]))

    def work(batches):
        for batch in batches:
            for number, texts, words in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(rows(number, Chunk(texts, words)))

    return code.select("chunk", "texts", "words").mapInArrow(work, MESSAGE)


def _built(shards: int):
    """Shards from what the chunks sent: their words, their pairs that occur again, the answers due to each chunk, and what they ask of the words' shards."""

    def work(dest: int, held: dict) -> Iterator[tuple]:
        sent = held.get(WORDS, [])
        if sent:
            parts = [unpack(b) for _, b in sent]
            hashes = [np.cumsum(p[0].astype(np.uint64)) for p in parts]
            h, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            n, m = (np.bincount(back, np.concatenate([p[i] for p in parts])).astype(np.int64) for i in (1, 2))
            lengths, data = _strings(_binaries(np.concatenate([p[3] for p in parts]), b"".join(p[4].astype(np.uint8).tobytes() for p in parts)).take(pa.array(first)))
            yield _message(dest, WORDS, 0, pack(steps(h), n, m, lengths, _bytes(data)))
            at = 0
            for (chunk, _), x in zip(sent, hashes):
                yield _message(dest, WORD_ANSWER, chunk, pack(steps(back[at : at + len(x)])))
                at += len(x)
        sent = held.get(PAIRS, [])
        if not sent:
            return
        hashes, keys, counts = [], [], []
        for _, b in sent:
            hashes.append(np.cumsum(unpack(b)[0].astype(np.uint64)))
        names = np.unique(np.concatenate(hashes))
        for (_, b), x in zip(sent, hashes):
            _, u, w, c = unpack(b)
            of = np.searchsorted(names, x)
            keys.append(of[np.cumsum(u)] * len(names) + of[w])
            counts.append(c)
        del hashes
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        g = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        state = np.minimum(g, 2)
        place = np.cumsum(state == 2) - 1
        at = 0
        for (chunk, _), x in zip(sent, keys):
            mine = back[at : at + len(x)]
            at += len(x)
            yield _message(dest, PAIR_ANSWER, chunk, pack(state[mine], steps(place[mine][state[mine] == 2])))
        del keys, counts, back
        u, w = key // len(names), key % len(names)
        ones, again = state == 1, state == 2
        dish, context = (np.bincount(x[ones], minlength=len(names)) for x in (w, u))
        more_dish, more_context = (np.bincount(x[again], minlength=len(names)) for x in (w, u))
        need = more_dish + more_context > 0
        cuts = np.searchsorted(share(names, shards), np.arange(shards + 1))
        segments = np.array([int(need[a:b].sum()) for a, b in zip(cuts, cuts[1:])])
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            some = np.flatnonzero(need[a:b] | (dish[a:b] + context[a:b] > 0)) + a
            if len(some):
                yield _message(j, ASK, dest, pack(steps(names[some]), dish[some], context[some], more_dish[some], more_context[some], need[some]))
        order = np.cumsum(need) - 1
        yield _message(dest, PAIRS, 0, pack(segments, steps(order[u[again]]), order[w[again]], g[again]))
        yield _message(dest, TOTAL, 0, None, float(ones.sum()), float((g == 2).sum()), float(again.sum()))

    return work


def _settled(dest: int, held: dict) -> Iterator[tuple]:
    """Words with their customers from pairs that occur once, and the places of the words each shard of pairs needs."""
    steps_, n, m, lengths, data = unpack(held[WORDS][0][1])
    h = np.cumsum(steps_.astype(np.uint64))
    dish, context = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    first = np.zeros(len(h), np.int64)
    for k, blob in held.get(ASK, []):
        x, a, b, more_dish, more_context, need = unpack(blob)
        at = np.searchsorted(h, np.cumsum(x.astype(np.uint64)))
        dish[at] += a
        context[at] += b
        first[at] += more_dish
        need = need.astype(bool)
        if need.any():
            yield _message(dest, ANSWER, k, pack(steps(at[need])))
            yield _message(dest, TABLES, k, pack(more_dish[need], more_context[need]))
    yield _message(dest, WORDS, 0, pack(steps(h), n, m, dish, context, lengths, data))
    c = dish + first
    yield _message(dest, TOTAL, 0, None, float(n.sum()), float((n > 0).sum()), float((c == 1).sum()), float((c == 2).sum()))


# --- sweeps ------------------------------------------------------------------


@dataclass(frozen=True)
class Totals:
    """Of the word restaurant after a sweep."""

    customers: float
    tables: float
    discount: float

    def log_p(self, c: np.ndarray, t: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of words with c customers at t tables, and of the logarithm of their spelling's."""
        new = math.log((STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers))
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log((c - self.discount * t) / (STRENGTH + self.customers)), new + spelled)


def _words_swept(spark: SparkSession, spelling: Spelling, before: float, discount: float, seed: int):
    """A shard's words seated anew; `before` tables were in the word restaurant."""
    packed = spark.sparkContext.broadcast(spelling)

    def work(dest: int, held: dict) -> Iterator[tuple]:
        model = packed.value
        h, _, _, c, context, lengths, data = unpack(held[WORDS][0][1])
        h = np.cumsum(h.astype(np.uint64))
        places = {k: np.cumsum(unpack(b)[0]) for k, b in held.get(ANSWER, [])}
        for k, blob in held.get(TABLES, []):
            dish, more = unpack(blob)
            c[places[k]] += dish
            context[places[k]] += more
        empty = math.log1p(-math.exp(model.p[model.row[0], SYMBOLS - 1]))
        spelled, t = np.empty(len(h)), np.zeros(len(h), np.int64)
        words, some = _binaries(lengths, data.astype(np.uint8).tobytes()), c > 0
        cells: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for a in range(0, len(h), 100_000):
            part = slice(a, min(len(h), a + 100_000))
            contexts, symbols, starts = spell(words.slice(a, 100_000))
            spelled[part] = model.log_p(contexts, symbols, starts) - empty
            now = np.flatnonzero(some[part]) + a
            with np.errstate(over="ignore"):
                t[now] = seat(c[now], np.exp(spelled[now]), max(before - 1, 0.0), discount, spread(h[now] + _U(seed)))
            back, cell = pd.factorize(contexts.astype(np.int64) * SYMBOLS + symbols)
            cells.append(cell)
            counts.append(np.bincount(back, np.repeat(t[part], np.diff(np.append(starts, len(symbols))))))
        spelled = spelled.astype(np.float32)
        yield _message(dest, SEATED, seed, pack(c, t, spelled, context))
        for k, at in places.items():
            yield _message(k, REPLY, dest, pack(c[at], t[at], spelled[at], context[at]))
        yield _message(0, LEAVES, 0, _merged(cells, counts))
        yield _message(dest, TOTAL, 0, None, float(c.sum()), float(t.sum()))

    return work


def _merged(cells: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    cell, back = np.unique(np.concatenate([np.empty(0, np.int64), *cells]), return_inverse=True)
    n = np.bincount(back, np.concatenate([np.empty(0), *counts]), len(cell)).astype(np.int64)
    return pack(steps(cell[n > 0]), n[n > 0])


def _leaves(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and customers of the spelling tree's leaves, of all shards: added up in few tasks, then here."""

    def work(batches):
        cells, counts = [], []
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                cell, n = unpack(blob)
                cells.append(np.cumsum(cell)), counts.append(n)
                if len(cells) > 8:
                    cell, n = unpack(_merged(cells, counts))
                    cells, counts = [np.cumsum(cell)], [n]
        yield pa.RecordBatch.from_arrays([pa.array([_merged(cells, counts)], pa.binary())], names=["blob"])

    cells, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for row in rows.filter(F.col("kind") == LEAVES).select("blob").repartition(8).mapInArrow(work, "blob binary").toLocalIterator():
        cell, n = unpack(row["blob"])
        cells.append(np.cumsum(cell)), counts.append(n)
    cell, n = unpack(_merged(cells, counts))
    return np.cumsum(cell), n


def _pairs_swept(totals: Totals, discount: float, seed: int, kept: bool):
    """A shard's pairs seated anew, given the words' probabilities and the tables of their contexts."""

    def work(dest: int, held: dict) -> Iterator[tuple]:
        segments, u, w, g = unpack(held[PAIRS][0][1])
        u = np.cumsum(u)
        t, sums = unpack(held[SEATS][0][1]) if SEATS in held else (np.ones(len(g), np.int64), np.zeros(len(g), np.int64))
        replies = [unpack(b) for _, b in sorted(held.get(REPLY, []))]
        if replies:
            c, tables, spelled, context = (np.concatenate(x) for x in zip(*replies))
            p = np.exp(totals.log_p(c, tables, spelled.astype(np.float64)))
            with np.errstate(over="ignore"):
                seeds = spread((_U(dest) << _U(36)) + np.arange(len(g)).astype(np.uint64) + spread(np.full(1, seed, np.uint64)))
            t = seat(g, p[w], np.maximum(context[u] - t, 0).astype(np.float64), discount, seeds)
        yield _message(dest, SEATS, 0, pack(t, sums + t if kept else sums))
        names = int(segments.sum())
        dish, more = np.bincount(w, t, names).astype(np.int64), np.bincount(u, t, names).astype(np.int64)
        stop = np.cumsum(segments)
        for j in np.flatnonzero(segments).tolist():
            part = slice(stop[j] - segments[j], stop[j])
            yield _message(j, TABLES, dest, pack(dish[part], more[part]))

    return work


def _kinds(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds))


def _total(rows: DataFrame) -> list[float]:
    return [float(x or 0) for x in _kinds(rows, TOTAL).agg(*[F.sum(c) for c in "xyzv"]).first()]


# --- scores ------------------------------------------------------------------


def _home(chunk: int, chunks: int) -> int:
    """The task that scores a chunk: numbered by partition and place within, chunks are dealt evenly where partitions have equally many."""
    return ((chunk >> 32) + 7919 * (chunk & 0xFFFFFFFF)) % chunks


def _words_answered(after: dict[int, Totals], chunks: int, discount: float):
    """To each chunk, for its words: count, count before others, logarithm of the mean probability, mean share of new tables."""

    def work(dest: int, held: dict) -> Iterator[tuple]:
        if WORDS not in held:
            return
        _, n, m, *_ = unpack(held[WORDS][0][1])
        p, tables = np.full(len(n), -np.inf), np.zeros(len(n))
        for sweep, blob in held[SEATED]:
            c, t, spelled, context = unpack(blob)
            p = np.logaddexp(p, after[sweep].log_p(c, t, spelled.astype(np.float64)))
            tables += context
        p -= math.log(len(after))
        room = (STRENGTH + discount * tables / len(after)) / (STRENGTH + m)
        for chunk, blob in held.get(WORD_ANSWER, []):
            at = np.cumsum(unpack(blob)[0])
            yield _message(_home(chunk, chunks), 0, chunk, pack(n[at], m[at], p[at].astype(np.float32), room[at].astype(np.float32)), float(dest))

    return work


def _pairs_answered(kept: int, chunks: int):
    """To each chunk, for its pairs: customers, and tables summed over the kept sweeps."""

    def work(dest: int, held: dict) -> Iterator[tuple]:
        if PAIRS not in held:
            return
        g = unpack(held[PAIRS][0][1])[3]
        sums = unpack(held[SEATS][0][1])[1]
        for chunk, blob in held.get(PAIR_ANSWER, []):
            state, places = unpack(blob)
            customers, tables = state.copy(), state * kept
            at = np.cumsum(places)
            customers[state == 2], tables[state == 2] = g[at], sums[at]
            yield _message(_home(chunk, chunks), 1, chunk, pack(customers, tables), float(dest))

    return work


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, burn_in: int = BURN_IN, kept: int = KEPT, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of docs.

    Learns from the rows that aren't held out; null and empty texts are their
    end alone; repeated rows count each time; a null doc_id is not held out.  A
    word that no training text holds has the probability of its own spelling,
    so that the probabilities of all strings add up to one; base_score counts
    such words as one.  Long texts are read whole, a chunk holding at least one.
    An empty table gives no rows; other columns are ignored.
    """
    if burn_in < 1 or kept < 1:
        raise ValueError("at least one sweep of burn-in, and one kept")
    spark = docs.sparkSession
    code = materialize(encode(docs), "lm-corpus")
    chunks, tokens, ends = (int(x or 0) for x in code.agg(F.count("*"), F.sum("tokens"), F.sum("ends")).first())
    if not chunks:
        return spark.createDataFrame([], SCORES)
    shards = max(1, -(-tokens // SHARD_TOKENS))
    built = materialize(_dealt(_sent(code, shards), shards, _built(shards)), "lm-shards")
    singles, twos, again, _ = _total(built)
    d_pair = discount_of(singles, twos)
    owners = materialize(_dealt(_kinds(built, WORDS, ASK), shards, _settled), "lm-words")
    n, v, one, two = _total(owners)
    d_word = discount_of(one, two)
    n, v = int(n) + ends, int(v) + int(ends > 0)  # the end of a text counts as a word

    tree, spelling, before = Tree(seed), Spelling.uniform(), float(v)
    after: dict[int, Totals] = {}
    told, seats, swept, old = owners, None, None, []
    for s in range(burn_in + kept):
        swept = materialize(_dealt(_kinds(owners, WORDS, ANSWER).unionByName(_kinds(told, TABLES)), shards, _words_swept(spark, spelling, before, d_word, seed + s)), f"lm-words-{s}")
        c, before, *_ = _total(swept)
        totals = Totals(c, before, d_word)
        if s >= burn_in:
            after[seed + s] = totals
            old.append(swept)
        if s + 1 == burn_in + kept:
            break
        spelling = tree.sweep(*_leaves(swept)) if before else spelling
        state = _kinds(built, PAIRS).unionByName(_kinds(swept, REPLY))
        told_before = told
        told = materialize(_dealt(state.unionByName(_kinds(seats, SEATS)) if seats is not None else state, shards, _pairs_swept(totals, d_pair, seed + s, s + 1 >= burn_in)), f"lm-pairs-{s}")
        seats = told
        # what this sweep has used up
        forget(spark, *([swept] if s < burn_in else []), *([told_before] if told_before is not owners else []))

    seated = old[0].filter(F.col("kind") == SEATED)
    for x in old[1:]:
        seated = seated.unionByName(_kinds(x, SEATED))
    for_words = _dealt(_kinds(owners, WORDS).unionByName(seated).unionByName(_kinds(built, WORD_ANSWER)), shards, _words_answered(after, chunks, d_pair))
    for_pairs = _dealt(_kinds(built, PAIRS, PAIR_ANSWER).unionByName(_kinds(seats, SEATS)), shards, _pairs_answered(kept, chunks))
    home = F.pmod(F.shiftright("chunk", 32) + 7919 * F.col("chunk").bitwiseAND((1 << 32) - 1), F.lit(chunks)).cast("int")
    zero = F.lit(0.0)
    texts = code.select(home.alias("dest"), F.explode(F.array(F.struct(F.lit(2).alias("kind"), F.col("words").alias("blob")), F.struct(F.lit(3).alias("kind"), F.col("texts").alias("blob")))).alias("e"), F.col("chunk").alias("other"))
    texts = texts.select("dest", "e.kind", "other", "e.blob", zero.alias("x"), zero.alias("y"), zero.alias("z"), zero.alias("v"))
    rows = for_words.unionByName(for_pairs).unionByName(texts).repartitionById(chunks, F.col("dest")).sortWithinPartitions("dest", "other", "kind", "x")

    space = n + 0.5 * (v + 1)
    end_base, end_known = math.log10((ends + 0.5) / space), int(ends > 0)
    end = (ends + STRENGTH / SYMBOLS) / (n + STRENGTH)
    end_score, go_on = math.log10(end), math.log10(1 - end)

    def scored(held: dict) -> Iterator[pa.RecordBatch]:
        c = Chunk(held[3][0], held[2][0])
        seen, m, p, room = (np.concatenate(x) for x in zip(*map(unpack, held[0])))
        old_ = np.zeros(len(c.pairs), np.float32)
        if len(c.pairs):
            for (_, at), blob in zip(c.dealt(shards), held[1], strict=True):
                customers, tables = unpack(blob)
                old_[at] = customers - d_pair * tables / kept
        held.clear()
        base = np.log10((seen + 0.5) / space)
        stop = np.cumsum(c.many)
        a = 0
        while a < len(c.many):  # some texts at a time: half a million tokens, or one text
            first = int(stop[a] - c.many[a])
            b = max(a + 1, int(np.searchsorted(stop, first + 500_000, "right")))
            many = c.many[a:b]
            now, last = c.tokens[first : stop[b - 1]], c.before(first, int(stop[b - 1]))
            key = last.astype(np.int64) * len(c.h) + now
            order = np.argsort(key)  # numbers in order are found faster, even so
            own = np.empty(len(key))
            own[order] = old_[np.searchsorted(c.pairs, key[order])]
            with np.errstate(divide="ignore"):
                words = np.logaddexp(np.log(own / (STRENGTH + m[last])), np.log(room[last].astype(np.float64)) + p[now]) / math.log(10) + go_on
            of = np.repeat(np.arange(len(many)), many)
            add = lambda x, of=of, many=many: np.bincount(of, x, len(many))
            cols = [(many + 1, pa.int64()), (add(seen[now] > 0).astype(np.int64) + end_known, pa.int64()), (np.full(len(many), n), pa.int64()), (add(base[now]) + end_base, pa.float64()), (add(words) + end_score, pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c.ids[a:b], pa.int64(), mask=c.null[a:b]), pa.array(c.held[a:b]), *(pa.array(x, k) for x, k in cols)], names=[x.split()[0] for x in SCORES.split(", ")])
            a = b

    def work(batches):
        now, held = None, {}
        for batch in batches:
            for kind, other, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if other != now:
                    if held:
                        yield from scored(held)
                    now, held = other, {}
                held.setdefault(kind, []).append(blob)
        if held:
            yield from scored(held)

    return rows.mapInArrow(work, SCORES)
