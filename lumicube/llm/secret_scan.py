"""Secret scan: fixed base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of key characters.  Each character class has a window length and a threshold of its own,
and its window slides over every maximal run of the class inside the candidate, so that a key name or a path joined to
a secret doesn't put it into a wider class.  The window moves one character at a time; the counts of its characters,
and with them its entropy, are updated for the character that enters and the one that leaves.  Overlapping windows
above the threshold give one span.  Allow-listed shapes (placeholders, repeated or ordered alphabets) cut a candidate
in pieces; spans without digits or without letters are no secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Letters of the keyword stand in either case; no other character may stand for them.
_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(
    f"({'|'.join(map(_ANY, ('password', 'passwd', 'secret', 'token')))}|{_ANY('api')}_?{_ANY('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
_KEYWORDS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class CharClass:
    name: str
    alphabet: frozenset[str]
    window: int
    bits: float  # least entropy of a window, in bits a character
    changes: int = 0  # least changes between upper case, lower case and digits in a window

    def runs(self, s: str) -> Iterator[tuple[int, int]]:
        """Maximal runs of the class that hold a window."""
        start = 0
        for k in range(len(s) + 1):
            if k == len(s) or s[k] not in self.alphabet:
                if k - start >= self.window:
                    yield start, k
                start = k + 1


_BASE64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: Classes from narrow to wide.  A window of 20 random base64 characters often has less than 3.9 bits, like a path or a
#: name; what tells it from them is how often upper case, lower case and digits alternate.
CLASSES = (
    CharClass("hex", frozenset("0123456789abcdefABCDEF"), 20, 2.9),
    CharClass("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 3.5),
    CharClass("base64", _BASE64, 20, 3.9),
    CharClass("mixed", _BASE64, 20, 3.6, 8),
)


def _ordered(s: str, least: int) -> str:
    """Pattern of the beginnings of ``s`` of at least ``least`` characters."""
    return s[:least] + "".join(f"(?:{c}" for c in s[least:]) + ")?" * (len(s) - least)


_ALLOWED = re.compile(
    r"(?i:x{4,}|example|placeholder|your[_-]|dummy|changeme|(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])|0123456789|"
    + _ordered("abcdefghijklmnopqrstuvwxyz", 10)
    + ")"
)


def allowed(s: str) -> bool:
    """Spans that are no secrets however even their characters are."""
    if not any("0" <= c <= "9" for c in s) or not any(c.isalpha() for c in s):
        return True
    return len(set(s)) <= 4


def pieces(s: str) -> Iterator[tuple[int, int]]:
    """What allow-listed shapes leave of a candidate."""
    at = 0
    for m in _ALLOWED.finditer(s):
        yield at, m.start()
        at = m.end()
    yield at, len(s)


def _changes(s: str) -> list[int]:
    """By position, the changes between upper case, lower case and digits up to there; other characters are skipped."""
    out, before, n = [], "", 0
    for c in s:
        kind = "d" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else before
        n += bool(before) and kind != before
        before = kind
        out.append(n)
    return out


def entropy_spans(s: str, window: int, bits: float, fits: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of ``s`` with at least ``bits`` of entropy a character that ``fits`` (if given) takes."""
    n = min(window, len(s))
    if not n:
        return
    term = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c) over the window's characters
    for c in s[:n]:
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += term[k + 1] - term[k]
    first = last = None
    for end in range(n, len(s) + 1):
        if end > n:
            k = counts[s[end - n - 1]]
            counts[s[end - n - 1]] = k - 1
            total += term[k - 1] - term[k]
            k = counts.get(s[end - 1], 0)
            counts[s[end - 1]] = k + 1
            total += term[k + 1] - term[k]
        if math.log2(n) - total / n >= bits - 1e-9 and (fits is None or fits(end - n, end)):
            if first is None:
                first = end - n
            elif end - n > last:
                yield first, last
                first = end - n
            last = end
    if first is not None:
        yield first, last


def candidate_spans(s: str) -> list[tuple[int, int]]:
    """Merged spans of the secrets of a candidate, of all classes."""
    found: list[tuple[int, int]] = []
    for lo, hi in pieces(s):
        for of in CLASSES if hi - lo >= min(c.window for c in CLASSES) else ():
            for a, b in of.runs(s[lo:hi]):
                run = s[lo + a : lo + b]
                n = _changes(run) if of.changes else []
                fits = (lambda i, j, n=n, of=of: n[j - 1] - n[i] >= of.changes) if of.changes else None
                found += [(lo + a + i, lo + a + j) for i, j in entropy_spans(run, of.window, of.bits, fits) if not allowed(run[i:j])]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], b)
        else:
            merged.append((a, b))
    return merged


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        spans += [("entropy", m.start() + a, m.start() + b) for a, b in candidate_spans(m[0])]
    spans.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return spans


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_secrets(x.as_py() or "") for x in batch.column(1)]
        kinds, starts, ends = ([[s[i] for s in spans] for spans in found] for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
            names=["doc_id", "kinds", "starts", "ends"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, kinds, starts, ends (arrays, by start, then kind as listed in KINDS).

    A null or empty text gives empty arrays; a null id stays null; repeated rows are repeated; spans that start at
    one place are ordered by kind; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as one string."""
    n = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    items = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(x["kinds"].alias("k"), F.concat_ws(":", x["kinds"], x["starts"], x["ends"]).alias("s")))
    base = F.filter(items, lambda x: x["k"] != "entropy")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, lambda x: x["s"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(items, lambda x: x["s"]), ",").alias("spans"),
    )


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every secret replaced; overlapping spans become one mark."""
    merged: list[list[int]] = []
    for _, a, b in find_secrets(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col`` and ``length_col`` set anew where a text changed.

    Rows, order of columns and all other columns stay as they are; null texts stay null.
    """
    names = docs.columns
    at, size = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None else redact(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                lengths = [n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new, strict=True)]
                columns[size] = pa.array(lengths, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_line(spans).encode()).hexdigest()
