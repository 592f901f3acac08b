"""Secret scans.

Base patterns (assignments, access keys, hex runs) and, beside them, the method: over every candidate string, the
Shannon entropy of a sliding window by incremental counts, against a threshold for the candidate's character class,
with an allow-list that suppresses known harmless forms.

A candidate is a whole run of letters, digits and ``+/_-``. Its class: ``hex`` where it has digits and letters and all are hex digits
(lower-case runs that are long enough are the base's), ``letters`` where it has no digit, ``mixed`` else. A window (all of a shorter
candidate) that reaches its class's threshold makes the whole candidate a span of kind ``entropy``. As n characters
have log2(n) bits at most, no candidate shorter than two to the threshold can reach it; any other is looked at. Runs
without letters are numbers, not candidates. Spans that a base span covers wholly aren't repeated.

Defined results: a null text is empty and has no spans; spans count code points and their ends are exclusive; whole
texts are scanned at any length; repeated rows scan alike; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerline.llm.common import arrow_map, text_bytes

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character in some window, by class; at most log2(WINDOW) = 4.32 can be reached.
THRESHOLDS = {"hex": 3.0, "mixed": 3.7, "letters": 4.0}
_WORD = r"(?:[A-Z]?[a-z]{1,15}(?:[A-Z][a-z]{1,15})*|[A-Z]{1,15})"
#: Forms that look random and are harmless: UUIDs, dates and times, words (of 16 letters at most, also joined by signs or capitals, with a short number).
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"\d{4}-\d{2}-\d{2}[T_-]?[\d:.Z+-]*",
    rf"[+/_=-]*{_WORD}\d{{0,4}}(?:[+/_=-]+(?:{_WORD}\d{{0,4}}|\d{{1,4}}))*[+/_=-]*",
)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = re.compile(rb"passw(?:or)?d|secret|token|api_?key")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_HEXDIGIT = frozenset("0123456789abcdefABCDEF")
_DIGIT, _LETTER, _NOT_HEX = np.zeros(256, np.int32), np.zeros(256, np.int32), np.ones(256, np.int32)
_DIGIT[48:58] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_NOT_HEX[[*b"0123456789abcdefABCDEF"]] = 0

Span = tuple[str, int, int]


def window_entropy(s: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits a character, of the windows of ``s`` (all of it where it is shorter)."""
    n = min(window, len(s))
    if not n:
        return 0.0
    term = [0.0, *(c * math.log2(c) for c in range(1, n + 2))]  # one more is there for a moment
    counts: dict[str, int] = {}
    total = 0.0  # of count * log2(count) over the window's characters
    best = math.inf
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += term[k + 1] - term[k]
        if i >= n:
            old = s[i - n]
            k = counts[old]
            counts[old] = k - 1
            total += term[k - 1] - term[k]
        if i >= n - 1 and total < best:
            best = total
    return math.log2(n) - best / n


def character_class(s: str) -> str | None:
    """``hex``, ``mixed`` or ``letters``; None where there is no letter."""
    if not any(c.isalpha() for c in s):
        return None
    if not any(c.isdigit() for c in s):
        return "letters"
    return "hex" if _HEXDIGIT.issuperset(s) else "mixed"


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans."""
    out: list[Span] = []
    if _has_word(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _has_word(text: str) -> bool:
    return _WORDS.search(text.encode("utf-8", "surrogatepass").translate(_LOWER)) is not None


def entropy_spans(text: str, runs: Iterable[tuple[int, int]], allow: re.Pattern, thresholds: dict[str, float], window: int) -> list[Span]:
    """The candidates (start, end) that a window gives away."""
    out = []
    for a, b in runs:
        s = text[a:b]
        kind = character_class(s)
        if kind and not allow.fullmatch(s) and window_entropy(s, window) >= thresholds[kind] - 1e-9:
            out.append(("entropy", a, b))
    return out


def joined(spans: Iterable[Span]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


class Scanner:
    """Finds all spans in columns of texts."""

    def __init__(self, thresholds: dict[str, float] | None = None, window: int = WINDOW, allow: Iterable[str] = ALLOW):
        self.thresholds, self.window = thresholds or THRESHOLDS, window
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow))

    def candidates(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        """Runs of candidate characters that are long enough for their class's threshold, by text, in code points."""
        flat, bounds = text_bytes(texts)
        inside = _CANDIDATE[flat]
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        if not len(flat):
            return out
        step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        cuts = np.unique(np.concatenate([[0], step, bounds]))
        starts, ends = cuts[:-1], cuts[1:]
        least = {c: math.ceil(2 ** min(t, math.log2(self.window)) - 1e-9) for c, t in self.thresholds.items()}
        keep = inside[starts] & (ends - starts >= min(least.values()))
        starts, ends = starts[keep], ends[keep]
        held = lambda kind: np.add.reduceat(kind[flat], np.stack([starts, ends], 1).ravel()[: 2 * len(starts) - (1 if len(ends) and ends[-1] == len(flat) else 0)])[::2] if len(starts) else np.zeros(0, int)
        digits, letters, others = held(_DIGIT), held(_LETTER), held(_NOT_HEX)
        needed = np.where(digits == 0, least["letters"], np.where(others == 0, least["hex"], least["mixed"]))
        some = (letters > 0) & (ends - starts >= needed)
        starts, ends = starts[some], ends[some]
        rows = np.searchsorted(bounds, starts, side="right") - 1
        for a, b, r in zip(starts.tolist(), ends.tolist(), rows.tolist()):
            head = int(bounds[r])
            at = a - head - int(np.count_nonzero((flat[head:a] & 0xC0) == 0x80))
            out[r].append((at, at + b - a))
        return out

    def scan(self, texts: pa.Array) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, added spans) of each text."""
        out = []
        for text, runs in zip(pc.fill_null(texts, "").to_pylist(), self.candidates(texts)):
            base = base_spans(text)
            more = entropy_spans(text, runs, self.allow, self.thresholds, self.window) if runs else []
            out.append((base, [s for s in more if not any(a <= s[1] and s[2] <= b for _, a, b in base)]))
        return out


def scan(df: DataFrame, id_column: str = "doc_id", column: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    scanner = scanner or Scanner()
    kind = df.schema[id_column].dataType.simpleString()

    def run(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = scanner.scan(part.column(1))
        count = lambda k: pa.array([sum(s[0] == k for s in b + m) for b, m in found], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), *map(count, KINDS), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(b + m) for b, m in found], pa.string())], ["id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return arrow_map(df.select(f"`{id_column}`", f"`{column}`"), run, f"id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string", column).withColumnRenamed("id", id_column)


def redact(df: DataFrame, column: str = "text", mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """The same rows and columns, with every span of ``column`` replaced by ``mark``; overlapping spans are one. A null text stays null."""
    scanner = scanner or Scanner()
    at = df.columns.index(column)

    def run(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        out = [_redacted(t, b + m, mark) for t, (b, m) in zip(part.column(at).to_pylist(), scanner.scan(part.column(at)))]
        columns = [part.column(i) if i != at else pa.array(out, part.column(at).type) for i in range(part.num_columns)]
        yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return arrow_map(df, run, df.schema, column)


def _redacted(text: str | None, spans: list[Span], mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
