"""Byte-level BPE: a backtracking encoder with exact merges, and a decoder on an offset table.

An automaton (Aho-Corasick) gives the longest vocabulary entry at every place of a piece. Entries are
laid end to end; two neighbours may stand together only if merging would not have joined anything
across their border, which a table of pairs tells. Where they may not, the next shorter prefix entry is
tried, and where none is left the encoder steps back; no place is failed twice, so work is linear.

Pieces repeat, so their ids are kept in a dictionary of bounded size. A text is cut at its spaces
first, where that is known to be a border of the pre-tokenizer, and only the cuts that aren't known
yet meet the pre-tokenizer's pattern.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: How byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space with white space on both sides (the end counts as such) may stand inside a piece.
_UNSAFE = re.compile(r"\s \s|\s \Z")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in plain:
            letters[chr(spare)] = b
            spare += 1
    return letters


class Known(dict):
    """Ids (little-endian 32-bit) by text; what is missing is made, and all is dropped when it takes more than `limit` bytes."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        size = sys.getsizeof(text) + sys.getsizeof(ids) + 110  # and the entry's part of the table
        if self.size + size > self.limit:
            self.clear()
            self.size = 0
        if size <= self.limit // 16:  # a longer one isn't worth its place
            self[text] = ids
            self.size += size
        return ids


class Vocabulary:
    """One tokenizer file: exact encoding and decoding. `limit`: bytes of pieces kept in memory."""

    def __init__(self, path: str, limit: int = 160 << 20):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        usable = {b: i for i, b in enumerate(self.bytes_of) if b and i not in self.special.values()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a, b] = c
            if self.halves[c] == (c, c):
                self.halves[c] = (a, b)
        # Ids must follow the order of merging: the pair test compares them.
        self.length = [len(b) for b in self.bytes_of]
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for b, i in usable.items():
            self.automaton.add_word(b.decode("latin-1"), i)
            for n in range(len(b) - 1, 0, -1):
                if (j := usable.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()
        self.usable = usable
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.pattern = regex.compile(PATTERN)
        self.border = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: The pair-compatibility table, filled as pairs are met.
        self.table: dict[int, bool] = {}
        self.piece = Known(self._piece, limit // 4)
        self.spaced = Known(lambda chunk: self._pieces(" " + chunk), limit)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between these neighbours: undo merges, latest first, and see whether a pair across the border would have been merged earlier."""
        pairs, halves = self.pairs, self.halves
        bound = len(halves)
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < bound:
                return False
            if left > right:
                inner = halves[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                inner = halves[right][0]
                if inner == right:
                    return True
                bound, right = right + 1, inner
            else:
                inner = halves[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                inner = halves[left][1]
                if inner == left:
                    return True
                bound, left = left, inner

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.usable.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        return np.array(self.backtrack(raw), dtype="<u4").tobytes()

    def backtrack(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        n, length, shorter, table = len(raw), self.length, self.shorter, self.table
        longest = [-1] * n
        for end, token in self.automaton.iter(raw.decode("latin-1")):  # at each end the longest comes first, so later ends overwrite with longer ones
            longest[end + 1 - length[token]] = token
        open_at = bytearray(b"\1") * (n + 1)
        ids: list[int] = []
        at, last, token = 0, -1, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_at[end]:
                    if last < 0:
                        break
                    fits = table.get(last << 20 | token)
                    if fits is None:
                        fits = self._learn(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte of this text")
                open_at[at] = 0
                token = ids.pop()
                at -= length[token]
                last = ids[-1] if ids else -1
        return ids

    def _learn(self, left: int, right: int) -> bool:
        if len(self.table) >= 1 << 20:
            self.table.clear()
        self.table[left << 20 | right] = fits = self._compatible(left, right)
        return fits

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pattern.findall(text)))

    def _plain(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self._pieces(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if self.border is not None and any(s in text for s in self.special):
            return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.border.split(text) if part)
        return self._plain(text)

    def decode(self, ids: bytes) -> bytes:
        """Text in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        a = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(a):
            return b""
        begin, n = self.offset[a], self.offset[a + 1] - self.offset[a]
        stop = np.cumsum(n)
        raw = self.blob[np.repeat(begin - stop + n, n) + np.arange(stop[-1])].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each text.

    Every row stays, repeated ones too; a null or empty text has no ids; a null doc_id stays null;
    other columns are left out.
    """
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(v.encode(t), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids; null ids give an empty text."""
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(np.asarray(a or [], dtype="<u4").tobytes()).decode() for a in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(work, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again. Nulls as in encode_documents."""
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1).to_pylist():
                ids = v.encode(text)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
