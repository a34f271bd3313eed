"""Harmonic packing of token sequences: pieces of one size class share a bin, a fixed count to each.

A class is a count k of equal slots of floor(capacity / k) tokens; classes that would leave more than four tokens of a bin
empty aren't used. A document is cut greedily into pieces of the largest class that fits; a rest below the smallest class goes
to the class of its own reciprocal. A bin of class k is closed when it has k pieces. Every task fills its own bins, so nothing
is exchanged between workers, and a task holds at most one open bin a class. What is open when a task ends is joined to full
sequences; its last part is cut into sequences whose lengths are powers of two, which aren't padded.

Null texts count as empty; each document ends with id 0, so an empty one has a single token. Null and repeated doc_ids are
packed row by row like any other. An empty table gives an empty result. The token ids are those of the vocabulary file; the
merges are run from the same file by a faster library.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from txnlens.llm.common import clean_docs, read_documents

CAPACITY = 1024
#: Tokens of a bin that a class may leave empty.
SLACK = 4
#: Smallest equal slot; shorter rests form classes of their own length.
SMALLEST = 32
#: Rows of the output held back before they are sent on.
_ROWS = 20_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: The split pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The characters of ``\s`` in it, and the run of them from which the pattern isn't tried: its matcher's stack ends at a million.
WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 100_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable ones as they are, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_encoder(vocabulary: str):
    """Text to a numpy array of ids, from a byte-level vocabulary file whose ids are in the order of its merges."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    core = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    runs = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{LONG_RUN},}}")

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for m in runs.finditer(text) if len(text) >= LONG_RUN else ():
            # One piece: the whole run before the end or a special token, else all but the last character.
            end = m.end() if m.end() == len(text) or any(text.startswith(t, m.end()) for t in special) else m.end() - 1
            parts.append(core.encode_to_numpy(text[at:m.start()], allowed_special="all"))
            parts.append(np.array(core._encode_single_piece(text[m.start():end]), np.uint32))
            at = end
        rest = core.encode_to_numpy(text[at:], allowed_special="all")
        return np.concatenate((*parts, rest)) if parts else rest

    return encode


def slot_sizes(capacity: int = CAPACITY) -> list[int]:
    """Slot lengths of the classes, largest first."""
    sizes = []
    for k in range(1, capacity // SMALLEST + 1):
        size = capacity // k
        if capacity - k * size <= SLACK and size >= SMALLEST:
            sizes.append(size)
    return sorted(set(sizes), reverse=True)


def cut(length: int, sizes: list[int]) -> list[int]:
    """Piece lengths of a document of ``length`` tokens."""
    pieces = [sizes[0]] * (length // sizes[0])
    rest = length % sizes[0]
    for size in sizes[1:]:
        while rest >= size:
            pieces.append(size)
            rest -= size
    return pieces + [rest] * (rest > 0)


class Packer:
    """Open bins of one task. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity, self.sizes = capacity, slot_sizes(capacity)
        self.next_id = task << 36
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        for length in cut(total, self.sizes):
            # A copy, so that an open bin doesn't keep the whole document.
            piece = (doc_id, start, ids[start:start + length].copy(), total)
            start += length
            slots = self.capacity // length
            own = self.open.setdefault(length, [])
            own.append(piece)
            if len(own) == slots:
                self.close(self.open.pop(length))

    def finish(self) -> None:
        """Close what is open: full sequences first, then one for each power of two in the rest."""
        left = [p for length in sorted(self.open, reverse=True) for p in self.open[length]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        lengths = [self.capacity] * (total // self.capacity)
        lengths += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        i = at = 0
        for room in lengths:
            pieces = []
            while room:
                doc_id, start, ids, whole = left[i]
                part = ids[at:at + room]
                pieces.append((doc_id, start + at, part, whole))
                at, room = at + len(part), room - len(part)
                if at == len(ids):
                    i, at = i + 1, 0
            self.close(pieces)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece; sequence ids hold the task in their high bits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer, end = byte_encoder(vocabulary), Packer(TaskContext.get().partitionId(), capacity), np.zeros(1, "<u4")
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("object"), batch["text"]):
                ids = np.concatenate((encode(text).astype("<u4", copy=False), end))
                packer.add(None if pd.isna(doc_id) else int(doc_id), ids)
                if len(packer.rows) >= _ROWS:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return clean_docs(docs).mapInPandas(run, SCHEMA)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    import public_tokenizers

    return pack(read_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
