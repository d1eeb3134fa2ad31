"""Secret scanning: fixed patterns plus sliding-window Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Character class, window length, least bits a character in a window, what a window must hold. No pattern of this module
#: can take a text apart in more than one way: each is linear in the text.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 20, 3.0, "dl"),
    ("upper", re.compile(r"[A-Z0-9]+"), 18, 3.4, "du"),
    ("lower", re.compile(r"[a-z0-9]+"), 18, 3.4, "dw"),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.65, "duw"),
)
#: Strings that are never secrets: letters and marks, digits, words and short numbers joined by marks (dates, slugs, paths), one character.
ALLOW = (
    re.compile(r"[A-Za-z\-_/+=]+|[0-9]+"),
    re.compile(r"[-_/+=]*(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/+=]+(?:[A-Za-z]+|[0-9]{1,4}))*[-_/+=]*"),
    re.compile(r"(.)\1*"),
)
#: Placeholders: no window that touches one counts, those beside it do.
PLACEHOLDER = re.compile(r"EXAMPLE|example|x{4,}|X{4,}|0{8,}|1234567")
#: Least length of a run; one shorter than its class's window is one window.
SHORTEST = 16
#: Entropies are compared in whole multiples of 1 / SCALE bits, so that a window's result depends on the window alone.
SCALE = 1 << 32
NEEDS = {"d": frozenset(string.digits), "u": frozenset(string.ascii_uppercase), "w": frozenset(string.ascii_lowercase), "l": frozenset(string.ascii_letters + "+/_=-")}
LOADS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(64)]


@dataclass(frozen=True)
class Scanner:
    """classes: (name, characters, window, least entropy, needs); allow: patterns that suppress a run they match whole."""

    classes: tuple = CLASSES
    allow: tuple = field(default=ALLOW)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the pattern matches, unsorted."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return found

    def windows(self, run: str, width: int, least: float, needs: str = "dl") -> Iterator[tuple[int, int]]:
        """Merged (start, end) of the windows of run with at least `least` bits a character and a character of each kind needed.

        Kinds are d (digits), l (all others), u (upper case) and w (lower case).
        The sum of c*log2(c) over the window's character counts is kept up to
        date, in whole numbers, as one character enters and one leaves: a step
        costs the same whatever the window's length.
        """
        counts: dict[str, int] = {}
        most = math.floor((math.log2(width) - least) * width * SCALE)  # of the sum
        tests = [NEEDS[k] for k in needs]
        held = [0] * len(tests)
        load, start, end = 0, -1, -1
        for i, ch in enumerate(run):
            c = counts.get(ch, 0)
            counts[ch] = c + 1
            load += LOADS[c + 1] - LOADS[c]
            for k, test in enumerate(tests):
                held[k] += ch in test
            if i >= width:
                old = run[i - width]
                c = counts[old]
                counts[old] = c - 1
                load += LOADS[c - 1] - LOADS[c]
                for k, test in enumerate(tests):
                    held[k] -= old in test
            if i >= width - 1 and load <= most and all(held):
                if start < 0 or i - width + 1 > end:
                    if start >= 0:
                        yield start, end
                    start = i - width + 1
                end = i + 1
        if start >= 0:
            yield start, end

    def between(self, run: str) -> Iterator[tuple[int, str]]:
        """(start, characters) of the stretches of run around placeholders."""
        at = 0
        for m in PLACEHOLDER.finditer(run):
            yield at, run[at : m.start()]
            at = m.end()
        yield at, run[at:]

    def entropy(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of high entropy outside those already found; overlapping ones of several classes are merged."""
        found: list[tuple[int, int]] = []
        for m in CANDIDATE.finditer(text):
            s = m.group()
            if any(a.fullmatch(s) for a in self.allow):  # whatever lies within matches too
                continue
            for _, chars, width, least, needs in self.classes:
                for r in chars.finditer(s):
                    for at, run in self.between(r.group()):
                        size = min(width, len(run))
                        if size < SHORTEST or any(a.fullmatch(run) for a in self.allow):
                            continue
                        at += m.start() + r.start()
                        # as far below the most that a window of its length can have
                        found += [(at + a, at + b) for a, b in self.windows(run, size, least - math.log2(width / size), needs)]
        out: list[tuple[int, int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][2]:
                out[-1] = (out[-1][0], 3, max(b, out[-1][2]))
            else:
                out.append((a, 3, b))
        return [x for x in out if not any(t[0] <= x[0] and x[2] <= t[2] for t in taken)]

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans, each by start and then kind."""
        text = text or ""
        base = sorted(self.base(text))
        return base, sorted(base + self.entropy(text, base))

    def redact(self, text: str | None, mark: str = "[REDACTED]") -> str | None:
        """text with each stretch that spans cover replaced by mark."""
        spans = self.scan(text)[1]
        if not spans:
            return text
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, scanner: Scanner = Scanner(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts are scanned where they lie, without any exchange; memory holds
    one Arrow batch.  Null and empty texts have no spans (base_sha256 is that
    of the empty string); repeated rows and null ids pass through; other
    columns are ignored.
    """

    def work(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(1).to_pylist():
                base, spans = scanner.scan(text)
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, scanner: Scanner = Scanner(), text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """docs with every span of its texts replaced by a mark, and n_col (if present) set to the new length where a text changed.

    Rows without a span keep their values; all other columns pass through.
    """
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(n_col) if n_col in docs.columns else None

    def work(batches):
        for batch in batches:
            before = batch.column(at).to_pylist()
            after = [scanner.redact(x) for x in before]
            cols = list(batch.columns)
            cols[at] = pa.array(after, batch.schema.field(at).type)
            if n_at is not None:
                cols[n_at] = pa.array([len(b) if a != b else n for a, b, n in zip(before, after, cols[n_at].to_pylist())], batch.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)
