"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Entropy is computed per character class by incremental counts: moving a window
by one character changes two counts, and sum(c log c) is kept up to date with
them.  Candidates on the allow list (placeholders, identifiers that are no
secrets, dictionary-like words) are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: kind: (characters, window, least bits a character in some window)
CLASSES = {"hexadecimal": (re.compile(r"[0-9a-fA-F]+"), 16, 2.9), "alphanumeric": (re.compile(r"[A-Za-z0-9]+"), 20, 3.6), "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.8)}
ALLOW = [
    re.compile(r"(?i)example|sample|placeholder|changeme|your[-_]?(key|token|secret)|x{6,}|lorem"),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I),
    re.compile(r"(?:[A-Za-z]*[0-9]{0,4}[/_=-])*[A-Za-z]*[0-9]{0,4}(?<!=)"),  # words, paths and identifiers: each segment letters, a short number or both, no padding at the end
]
#: The order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy")
_XLOGX = [0.0] + [n * math.log2(n) for n in range(1, 257)]


def max_window_entropy(s: str, window: int) -> float:
    """The largest Shannon entropy, in bits a character, of a window of s (of all of s where it is shorter)."""
    window = min(window, len(s))
    counts: dict[str, int] = {}
    for c in s[:window]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(_XLOGX[n] for n in counts.values())
    least = total
    for i in range(window, len(s)):
        new, old = s[i], s[i - window]
        if new == old:
            continue
        n = counts.get(new, 0)
        total += _XLOGX[n + 1] - _XLOGX[n]
        counts[new] = n + 1
        n = counts[old]
        total += _XLOGX[n - 1] - _XLOGX[n]
        counts[old] = n - 1
        least = min(least, total)
    return math.log2(window) - least / window if window else 0.0


def _digits_and_letters(s: str) -> bool:
    n = sum(c.isdigit() for c in s)
    return 2 <= n < len(s)


def is_secret_like(s: str) -> bool:
    """Whether a candidate's own class finds a window of high entropy in it, and the allow list doesn't hold it."""
    if not _digits_and_letters(s):
        return False
    if ALLOW[0].search(s) or any(p.fullmatch(s) for p in ALLOW[1:]):
        return False
    for pattern, window, least in CLASSES.values():
        if pattern.fullmatch(s):
            return max_window_entropy(s, window) >= least
    return False


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then as KINDS lists them."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def entropy_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of high entropy that overlap no base span."""
    starts, ends = [x for x, _, _ in taken], list(accumulate((y for _, y, _ in taken), max))  # by start; the furthest end so far
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_left(starts, b)  # spans that start before b
        if (not k or ends[k - 1] <= a) and is_secret_like(m[0]):
            out.append((a, b, "entropy"))
    return out


def all_spans(text: str) -> tuple[list, list]:
    """(base spans, all spans in order)."""
    base = base_spans(text)
    found = entropy_spans(text, base)
    return base, sorted(base + found, key=lambda x: (x[0], KINDS.index(x[2]))) if found else base


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by mask."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_DDL = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base, every = all_spans(text)
            if not every:
                rows.append((0, 0, 0, 0, none, ""))
                continue
            kinds = [k for _, _, k in every]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(cols, list(_OUT)[1:]))], schema=_OUT)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every whole text: doc_id, counts by kind, base_sha256, spans (kind:start:end, code points).

    A null text counts as empty; empty texts have no spans and the hash of the
    empty string; time is linear in a text's length.  Null doc_ids and repeated rows give a row each.  Nothing is
    shuffled; other columns of docs are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty()).mapInArrow(_scan, _DDL)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span of a secret in `text` masked; null texts stay null, other columns stay as they are."""
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [t if not t or not (s := all_spans(t)[1]) else redact(t, s) for t in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, batch.schema.field(k).type), *batch.columns[k + 1 :]], schema=batch.schema)

    return docs.mapInArrow(run, schema)
