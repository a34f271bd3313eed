"""Secret scan: three kinds of pattern, and a guess-cost estimate of values that stand in a credential context.

The estimate is the least total cost over all ways to cut a value into known words, dates, repeats, keyboard walks, sequences
and brute-force spans; a cost is the decimal logarithm of the guesses needed. Values at or over ``MIN_COST`` are spans of kind
``guess``; they are added to the spans of the patterns, which all stay. Words and their ranks come from the order of a public
vocabulary file.

Null texts count as empty. Each row is scanned by itself, so null and repeated doc_ids change nothing; an empty table gives an
empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from math import log10

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.common import clean_docs, read_documents, unused

KINDS = ("assign", "access", "hex", "guess")
#: Guesses (as a power of ten) from which a value in a credential context counts as a secret.
MIN_COST = 10.0
MASK = "[SECRET]"

#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What every match of ASSIGN or CONTEXT has, in lower case.
NEEDED = (b"passw", b"passphrase", b"passcode", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"pwd", b"credential",
          b"bearer", b"private", b"access", b"signing", b"authorization", b"login")
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key"""
    r"""|signing[_-]?key|credentials?|authorization|bearer|login)["']?"""
    r"""(?:[ \t]{0,8}(?:[:=]|=>|:=)[ \t]{0,8}|[ \t]{1,8}(?:is|was)[ \t]{1,8})"""
    r"""(?:"((?:\\.|[^"\\\r\n]){8,})"|'((?:\\.|[^'\\\r\n]){8,})'|["']?([^\s"'<>,;]{8,}))""", re.I | re.A)
#: Keyboard rows and sequences that walks follow.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d", re.A)
LEET = str.maketrans("@4310$5!7", "aaeiossit")
#: Longest segment that is looked up as a word.
_LONGEST_WORD = 24
#: Each segment but the first costs the choice of its kind.
_SWITCH = log10(8)


def load_words(vocabulary: str) -> dict[str, float]:
    """Cost of each whole word of a vocabulary with word ends, by its place in the order of merges."""
    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = sorted((i, t[:-4]) for t, i in vocab.items() if t.endswith("</w>"))
    words = [t for _, t in whole if len(t) >= 3 and t.isascii() and t.isalpha()]
    return {w: log10(rank + 2) for rank, w in enumerate(words)}


def _walks() -> frozenset[str]:
    lines = ROWS + SEQUENCES
    return frozenset(line[i:i + 2] for x in lines for line in (x, x[::-1]) for i in range(len(line) - 1))


_PAIRS = _walks()


def _pool(value: str) -> float:
    size = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value))
    size += 33 * bool(re.search(r"[^A-Za-z0-9]", value))
    return log10(max(size, 2))


def guess_cost(value: str, words: dict[str, float], enough: float | None = None) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation of ``value``.

    Time and memory grow with the length of the value. With ``enough``, the search ends at the first place where every
    segmentation costs more, as costs only grow along the value.
    """
    n, lower = len(value), value.lower()
    if len(lower) != n:
        lower = value
    plain, pool = lower.translate(LEET), _pool(value)
    dates: dict[int, list[int]] = {}
    for at in range(n):
        if value[at].isdigit() and (m := DATE.match(value, at)):
            dates.setdefault(m.end(), []).append(at)
    best = [0.0] + [float("inf")] * n
    walk = same = unit_start = 0
    for end in range(1, n + 1):
        i = end - 1
        cost = best[i] + pool + (_SWITCH if i == 0 else 0)  # brute force goes on, one more character
        for at in range(max(0, end - _LONGEST_WORD), end - 2):
            known = words.get(lower[at:end])
            if known is None and (known := words.get(plain[at:end])) is not None:
                known += log10(4)
            if known is not None:
                known += 0.0 if value[at:end].islower() else log10(2) if value[at:end].istitle() else log10(6)
                cost = min(cost, best[at] + known + _SWITCH)
        for at in dates.get(end, ()):
            cost = min(cost, best[at] + log10(365 * 120) + _SWITCH)
        walk = walk if i and lower[i - 1:end] in _PAIRS else i
        if end - walk >= 3:
            cost = min(cost, best[walk] + log10(100 * (end - walk)) + _SWITCH)
        same = same if i and lower[i] == lower[i - 1] else i
        if end - same >= 2:
            cost = min(cost, best[same] + pool + log10(end - same) + _SWITCH)
        for unit in range(2, 9):  # a block that repeats the one before it
            if end >= 2 * unit and lower[end - unit:end] == lower[end - 2 * unit:end - unit]:
                cost = min(cost, best[end - unit] + log10(2) + _SWITCH)
        best[end] = cost
        if enough is not None and end >= 2 * _LONGEST_WORD and min(best[end - _LONGEST_WORD:end + 1]) >= enough + _SWITCH:
            return min(best[end - _LONGEST_WORD:end + 1])
    return best[n]


def find_spans(text: str, words: dict[str, float]) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all spans, sorted; ``kind`` is a place in ``KINDS``."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    octets = text.encode("utf-8", "replace").lower()
    if any(k in octets for k in NEEDED):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        for m in CONTEXT.finditer(text):
            # A quoted value runs to its closing quote.
            value = m[m.lastindex] if m.lastindex < 3 else m[3].rstrip(".)]}")
            if len(value) >= 8 and guess_cost(value, words, MIN_COST) >= MIN_COST:
                spans.append((m.start(m.lastindex), 3, m.start(m.lastindex) + len(value)))
    return sorted(spans)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def mask_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by ``MASK``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans)`` of every row."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _cached_words(vocabulary)
        for batch in batches:
            found = [find_spans(t, words) for t in batch["text"]]
            counts = [[sum(k == kind for _, k, _ in s) for kind in range(4)] for s in found]
            base = [hashlib.sha256(join_spans([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_assign": [c[0] for c in counts], "n_access": [c[1] for c in counts],
                "n_hex": [c[2] for c in counts], "base_sha256": base, "spans": [join_spans(s) for s in found],
                "n_guess": [c[3] for c in counts]})

    return clean_docs(docs).mapInPandas(run, schema)


def masked(docs: DataFrame, vocabulary: str, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with all rows and columns; secrets in ``text`` are masked and ``length`` follows where a text changed."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        words = _cached_words(vocabulary)
        return texts.map(lambda t: None if t is None else mask_spans(t, find_spans(t, words)))

    (clean,) = unused(docs, "_clean")
    out = docs.withColumn(clean, mask(F.col(text)))
    if length in docs.columns:
        kept = F.col(length)
        changed = F.char_length(clean).cast(docs.schema[length].dataType)
        out = out.withColumn(length, F.when(F.col(clean) == F.col(text), kept).otherwise(F.coalesce(changed, kept)))
    return out.withColumn(text, F.col(clean)).select(docs.columns)


_WORDS: dict[str, dict[str, float]] = {}


def _cached_words(vocabulary: str) -> dict[str, float]:
    """Of this Python worker; one entry a vocabulary file."""
    if vocabulary not in _WORDS:
        _WORDS[vocabulary] = load_words(vocabulary)
    return _WORDS[vocabulary]


def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    import public_tokenizers

    return scan(read_documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
