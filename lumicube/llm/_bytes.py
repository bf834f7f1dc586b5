"""Byte-level text helpers shared by the operators of this package.

Texts arrive as Arrow string columns.  Instead of building one Python string
per word, the helpers view the column as one byte buffer with document offsets
and find words, hash them and form shingles with numpy over the whole block.
Blocks hold a bounded number of bytes, except that a document is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[data]


def byte_class(*spans: tuple[int, int], invert: bool = False) -> np.ndarray:
    """Boolean table of 256 bytes that holds for the inclusive ``spans``."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return ~out if invert else out


#: words `[^\x20\x09-\x0D]+`
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text with A-Z lower-cased
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), invert=True)


def column_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole documents with about ``size`` bytes each."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def find_words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of ``keep`` bytes; runs end with their document."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = keep[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, 2 * BLOCK_BYTES)
        for key, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def join_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes; the order matters."""
    out = np.full(len(parts[0]), 0x51_7C_C1_B7_27_22_0A_95, dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)


def shingles(word_hash: np.ndarray, word_doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every ``width``-word shingle; of the whole sequence where a document has fewer words."""
    counts = np.bincount(word_doc, minlength=n_docs) if len(word_doc) else np.zeros(n_docs, np.int64)
    n = len(word_hash)
    if n >= width:
        m = n - width + 1
        same = word_doc[:m] == word_doc[width - 1 :]
        at = np.flatnonzero(same)
        docs, hashes = word_doc[at], join_hashes([word_hash[at + k] for k in range(width)])
    else:
        docs, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        more = np.empty(len(short), np.uint64)
        for c in np.unique(counts[short]):
            k = counts[short] == c
            more[k] = join_hashes([word_hash[first[k] + j] for j in range(c)])
        docs, hashes = np.concatenate((docs, short)), np.concatenate((hashes, more))
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return docs, hashes
