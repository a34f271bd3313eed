"""BPE encoding as a transducer with bounded lookahead, and incremental decoding.

A merge ``(a, b)`` across a place needs the ``len(b)`` symbols after it, and whether an earlier merge takes the end of ``b``
away: one whose left part ends where ``b`` ends. Ranks fall along such a chain, so its greatest length follows from one pass
over the merge list (``sufficient_lookahead``). Whatever comes later, a token boundary with that many symbols after it is final.
Long words are therefore merged in a window of constant size, and tokens are given out as soon as they are final; short words,
which end within the window, are merged whole and remembered in a table of bounded size.

A null text counts as empty and has no tokens. Rows are encoded one by one: null or repeated doc_ids change nothing, and an
empty table gives an empty result. The text is normalised in parts that end before white space, so memory grows only with the
longest run without white space. Unicode tables are those of the Python libraries.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from txnlens.llm.common import clean_docs, read_documents
from txnlens.llm.harmonic_pack import byte_alphabet

#: Words remembered by a task.
MEMORY = 400_000
#: Characters that are normalised at once, about.
PART = 1 << 16

#: White space, word ends and the split pattern of the public word-level vocabulary.
WHITE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
WORD_END = "</w>"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
_SPACE = regex.compile(f"[{WHITE}]")


class Merges:
    """A vocabulary file: symbols, merges by pair, and the lookahead that makes a boundary final."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        stand_in = {b: c for c, b in byte_alphabet().items()}
        self.inner = [vocab[stand_in[b]] for b in range(256)]
        self.last = [vocab[stand_in[b] + WORD_END] for b in range(256)]
        self.pieces = {i: t for t, i in (vocab | self.special).items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.parts: dict[int, tuple[int, int]] = {}
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[a], vocab[b])
            self.rank[pair] = len(self.made)
            self.made.append(vocab[a + b])
            self.parts.setdefault(vocab[a + b], pair)
        self.size = {i: 1 for i in (*self.inner, *self.last)}
        self.lookahead = self.sufficient_lookahead()
        self.window = 4 * (self.lookahead + max(self.size.values()))

    def sufficient_lookahead(self) -> int:
        """Symbols after a boundary that decide whether it is final."""
        reach: dict[int, int] = {}  # by left part: the most symbols that a merge seen so far needs
        most = 0
        for (a, b), rank in self.rank.items():  # in the order of ranks
            if a not in self.size or b not in self.size:
                raise ValueError("a merge comes before those that make its parts")
            self.size.setdefault(self.made[rank], self.size[a] + self.size[b])
            need, end = 0, b
            while True:  # every token that ends where b ends
                need = max(need, reach.get(end, 0))
                if end not in self.parts:
                    break
                end = self.parts[end][1]
            look = self.size[b] + need
            reach[a] = max(reach.get(a, 0), look)
            most = max(most, look)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of ``ids``: least rank first, then leftmost."""
        get, none = self.rank.get, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Token ids of one word given byte by byte; holds at most ``window`` symbols."""
        held: list[int] = []
        for byte in symbols:
            held.append(byte)
            if len(held) == self.window:
                # No symbol here is known to be the last one but the unseen one after it.
                known, at, cut = self.merge([self.inner[b] for b in held]), 0, 0
                final = len(held) - self.lookahead - 1
                for token in known:
                    if at + self.size[token] > final:
                        break
                    at += self.size[token]
                    cut += 1
                yield from known[:cut]
                del held[:at]
        if held:
            yield from self.merge([*(self.inner[b] for b in held[:-1]), self.last[held[-1]]])


class Words(dict):
    """Token ids by word; forgets all when it is full."""

    def __init__(self, merges: Merges, limit: int = MEMORY):
        super().__init__()
        self.merges, self.limit = merges, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        octets, m = word.encode("utf-8", "replace"), self.merges
        if len(octets) >= m.window:
            return tuple(m.stream(octets))  # not remembered
        ids = [m.inner[b] for b in octets]
        ids[-1] = m.last[octets[-1]]
        found = tuple(m.merge(ids))
        if len(self) >= self.limit:
            self.clear()
        self[word] = found
        return found


class Encoder:
    def __init__(self, vocabulary: str, memory: int = MEMORY):
        self.merges = Merges(vocabulary)
        self.words = Words(self.merges, memory)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        get = self.words.__getitem__
        for n, plain in enumerate(self.marks.split(text) if "<|" in text else (text,)):
            if n % 2:
                ids.append(self.merges.special[plain])
                continue
            for part in parts(plain):
                ids.extend(chain.from_iterable(map(get, SPLIT.findall(normal(part)))))
        return ids

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in chunks; the rest after the last white space waits for the next chunk."""
        held = ""
        for chunk in chunks:
            held += chunk
            cuts = [m.start() for m in _SPACE.finditer(held)]
            if cuts and cuts[-1]:
                yield from self.encode(held[:cuts[-1]])
                held = held[cuts[-1]:]
        yield from self.encode(held)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut before white space, which no normal form joins to what precedes."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def normal(text: str) -> str:
    """Composed and in lower case, character by character; white space stays, as the split drops it."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class PieceDecoder:
    """Ids to the text of a vocabulary file without a decoder: its pieces with a space between them, special ones too.

    State is whether a piece was given before; pieces are given out at once.
    """

    def __init__(self, merges: Merges):
        self.table = {i: t.encode() for i, t in merges.pieces.items()}
        self.started = False

    def feed(self, ids: Iterable[int]) -> bytes:
        text = b" ".join(map(self.table.__getitem__, ids))
        if self.started and text:
            text = b" " + text
        self.started = self.started or bool(text)
        return text


class TextDecoder:
    """Ids to readable text: bytes behind the pieces go through a UTF-8 state machine, which holds at most three bytes."""

    def __init__(self, merges: Merges):
        alphabet = byte_alphabet()
        self.table = {}
        for i, piece in merges.pieces.items():
            end = piece.endswith(WORD_END) and i not in merges.special.values()
            body = piece[:-len(WORD_END)] if end else piece
            self.table[i] = bytes(alphabet[c] for c in body) + b" " * end if i not in merges.special.values() else piece.encode()
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.machine.decode(self.table[i]) for i in ids)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """Of this Python worker; one a vocabulary file."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_docs(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, ids)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [own.encode(t) for t in batch["text"]]})

    return clean_docs(docs).mapInPandas(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the ids and of what they decode to."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary)
        numbers = {i: str(i).encode() for i in own.merges.pieces}
        decoder = PieceDecoder(own.merges)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = own.encode(text)
                decoder.started = False
                rows.append((len(ids), hashlib.sha256(b" ".join(map(numbers.__getitem__, ids))).hexdigest(),
                             hashlib.sha256(decoder.feed(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return clean_docs(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    import public_tokenizers

    return digests(read_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
