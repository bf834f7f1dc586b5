"""BPE encoding and decoding over distinct-word tables.

Texts are split into words by the byte-level pre-tokenizer's pattern.  The words of a block of documents form a
table of distinct words; each distinct word that the task has not met is encoded once, by the public tokenizer
itself, and the ids are joined back to the words' positions.  Decoding joins every id to its piece's bytes.

The table is kept per task and bounded.  One table of the whole corpus was measured and rejected: the texts of
check_l have some five million distinct words in 160 million places, and a join of places with it shuffles about
ten times what the operator may write; see the README.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: White space of the pre-tokenizer's pattern (fixed values: Unicode White_Space).
_SPACE = r"\t-\r\x20\x85\xA0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: A task's table is emptied when it holds so many distinct words.
MAX_WORDS = 150_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(0x100 + k)] = b
    return out


class Codec:
    """Encoder and decoder of one byte-level vocabulary file, with a bounded table of distinct words."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        self.pieces: list[bytes] = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        for t in spec["added_tokens"]:
            self.pieces[t["id"]] = t["content"].encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.words_of = regex.compile(_PATTERN).findall
        self.max_words = max_words
        self.merge = self._ranked(spec["model"])
        self.table: dict[str, tuple[int, ...]] = {}
        self.joined: dict[str, str] = {}  # a word's ids as text

    def _ranked(self, model: dict):
        """A rank-based merger of one word's bytes, if the file's ids from 256 on are its merges in order, as they
        usually are; it gives the library's ids several times as fast, without a library object for each word."""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        ranks = {self.pieces[i]: i for i in range(256 + len(pairs))}
        if len(ranks) != 256 + len(pairs):
            return None
        return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids(self, words: list[str]) -> list[list[int]]:
        if self.merge is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [[self.added[w]] if w in self.added else self.merge(w) for w in words]

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own."""
        if self.at_added is None or not any(t in text for t in self.added):
            return self.words_of(text)
        out: list[str] = []
        for k, part in enumerate(self.at_added.split(text)):
            out += [part] if k % 2 else self.words_of(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the distinct words that the table lacks, each once."""
        new = [w for w in words if w not in self.table]
        if len(self.table) + len(new) > self.max_words:
            # The words met first are the frequent ones: they stay.
            for t in (self.table, self.joined):
                kept = dict(islice(t.items(), self.max_words // 2))
                t.clear()
                t.update(kept)
            new = [w for w in words if w not in self.table]
        for w, ids in zip(new, self._ids(new), strict=True):
            self.table[w] = tuple(ids)
            self.joined[w] = ",".join(map(str, ids))

    def encode(self, words: list[str]) -> list[int]:
        """Ids of a split text, joined to its words by position."""
        table = self.table
        return [i for w in words for i in table[w]]

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes; like the library, decoding replaces what is no UTF-8."""
        raw = b"".join(map(self.pieces.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def blocks(self, texts: list[str], places: int = 100_000) -> Iterator[list[list[str]]]:
        """Split texts in runs of about ``places`` words, whose distinct words are in the table; texts stay whole."""
        run: list[list[str]] = []
        n = 0
        for t in texts:
            run.append(self.split(t))
            n += len(run[-1])
            if n >= places:
                self.learn(set().union(*run))
                yield run
                run, n = [], 0
        if run:
            self.learn(set().union(*run))
            yield run


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int).

    A null or empty text gives no ids; a null id stays null; repeated rows are repeated; an empty table gives no
    rows; other columns are not read.  The vocabulary file must be installed on every executor.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for block in own.blocks([x.as_py() or "" for x in batch.column(1)]):
                ids = pa.array([own.encode(w) for w in block], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), ids], names=["doc_id", "ids"])
                at += len(block)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), through the id-to-piece table; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [own.decode(x.as_py() or []).decode() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, lossless.

    A document's ids are joined to its words by position, and every id of them to its piece's bytes; the decoded text
    comes from the ids alone.  Both are hashed in the same pass, so that neither has to be written between the two.
    Edge cases as in ``encode``.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        joined = own.joined
        for batch in batches:
            at = 0
            texts = [x.as_py() or "" for x in batch.column(1)]
            for block in own.blocks(texts):
                n, ids_sha, text_sha, same = [], [], [], []
                for k, words in enumerate(block):
                    ids = own.encode(words)
                    raw = own.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([joined[w] for w in words]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(raw).hexdigest())
                    same.append(raw == texts[at + k].encode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
                )
                at += len(block)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
