"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Trees are grown level by level to a fixed depth on binned columns and kept as flat arrays in heap order, so that scoring a batch
is ``depth`` numpy steps over all rows and trees at once. Only labelled rows whose crc32(doc_id as text) mod 5 is not 0 are
learned from; at most ``MAX_TRAIN`` of them, chosen by a hash of the id, so the driver holds a bounded table. Scores use the text
alone.

A null text counts as empty and has a score like any other. Rows with null labels aren't learned from; of labels that repeat a
doc_id the least counts. Repeated rows are scored each. Without labelled rows every score is 0.5; with one class only, the
share of that class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.common import clean_docs, read_documents

#: Labelled rows that are learned from, at most.
MAX_TRAIN = 30_000
#: Least score of a document that passes.
CUT = 0.3

FEATURES = (
    "log_chars", "log_words", "log_lines", "chars_per_word", "word_len_std", "longest_word", "words_per_line", "lower", "upper",
    "digit", "space", "not_ascii", "period", "comma", "bang", "pipe", "junk", "quote", "brackets", "other_mark", "control",
    "byte_entropy", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "end_marked", "stop_marked", "title_words",
    "upper_words", "no_letter_words", "short_words", "long_words", "last_line_share",
)
_BYTES = np.arange(256)


def _set(chars: str) -> np.ndarray:
    return np.isin(_BYTES, [ord(c) for c in chars])


_LOWER, _UPPER, _DIGIT = (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_SPACE, _HIGH = _set(" \t\r\n\v\f"), _BYTES >= 128
_OTHER = (_BYTES > 32) & (_BYTES < 127) & ~(_LOWER | _UPPER | _DIGIT | _set(".,!|#$%&*\"'()[]{}<>"))
_CONTROL = (_BYTES < 32) & ~_SPACE
_MASKS = np.array([_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _set("."), _set(","), _set("!"), _set("|"), _set("#$%&*"), _set("\"'"),
                   _set("()[]{}<>"), _OTHER, _CONTROL], dtype=np.float64)


def statistics(text: str) -> np.ndarray:
    """One number for each of ``FEATURES``, from the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256).astype(np.float64)
    size = max(len(raw), 1)
    shares = _MASKS @ counts / size
    p = counts[counts > 0] / size
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if not n:
        head = [np.log1p(len(text)), 0.0, np.log1p(len(lines)), 0.0, 0.0, 0.0, 0.0]
        return np.array([*head, *shares, -(p * np.log2(p)).sum(), *[0.0] * 12])
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    ends = Counter(w[-1] for w in words)
    letters_end = sum(c for ch, c in ends.items() if ch.isalnum())
    stops = sum(ends[ch] for ch in ".,;:?")
    upper = sum(c for w, c in seen.items() if w.isupper())
    title = sum(c for w, c in seen.items() if w[0].isupper())
    blank = sum(c for w, c in seen.items() if not any(map(str.isalpha, w)))
    pairs = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    return np.array([
        np.log1p(len(text)), np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(), lengths.max(), n / len(lines), *shares,
        -(p * np.log2(p)).sum(), len(seen) / n, pairs, len(set(lines)) / len(lines), max(seen.values()) / n, 1 - letters_end / n,
        stops / n, title / n, upper / n, blank / n, (lengths <= 2).mean(), (lengths >= 12).mean(), len(lines[-1]) / max(len(text), 1)])


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``cut`` of all inner nodes, ``value`` of all leaves, each a row a tree in heap order."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, (trees, inner) = np.arange(len(x))[:, None], self.feature.shape
        node, tree = np.zeros((len(x), trees), np.int64), np.arange(trees)[None, :]
        while inner:
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
            inner >>= 1
        return self.base + self.value[tree, node - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))) if len(x) else np.zeros(0)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Up to ``bins - 1`` cuts a column, between neighbouring quantiles."""
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for col in x.T]


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 5, rate: float = 0.1, bins: int = 64,
              reg: float = 1.0, least: float = 2.0) -> Trees:
    """Boosting on the logistic loss. One histogram pass a level serves all nodes and columns of it.

    ``least`` is the smallest sum of second derivatives a child may have. A node without a gain sends all rows left.
    """
    n, columns = x.shape if x.ndim == 2 else (0, len(FEATURES))
    inner, leaves = (1 << depth) - 1, 1 << depth
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n == 0:
        return none
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(base, none.feature, none.cut, none.value)
    edges = bin_edges(x, bins)
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]).astype(np.int64)
    limits = np.array([len(e) for e in edges])
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    raw = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cells = width * bins
            g, h = np.empty((columns, width, bins)), np.empty((columns, width, bins))
            for c in range(columns):
                key = (node - first) * bins + codes[c]
                g[c] = np.bincount(key, grad, cells).reshape(width, bins)
                h[c] = np.bincount(key, hess, cells).reshape(width, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl ** 2 / (hl + reg) + gr ** 2 / (hr + reg) - gt ** 2 / (ht + reg)
            allowed = (hl >= least) & (hr >= least) & (np.arange(bins)[None, None, :] < limits[:, None, None])
            gain = np.where(allowed, gain, 0.0).transpose(1, 0, 2).reshape(width, -1)
            pick = gain.argmax(axis=1)
            split = gain[np.arange(width), pick] > 1e-9
            col, at = pick // bins, pick % bins
            feature[t, first:first + width] = np.where(split, col, 0)
            cut[t, first:first + width] = [edges[c][a] if s else np.inf for c, a, s in zip(col, at, split)]
            here = node - first
            right = split[here] & (codes[col[here], np.arange(n)] > at[here])
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value[t] = rate * gs / (hs + reg)
        raw += value[t][leaf]
    return Trees(base, feature, cut, value)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Learn from at most ``max_train`` labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        "doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    total = known.count()
    if total > max_train:
        known = known.where(place < int((1 << 20) * max_train / total))
    columns = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]]).reshape(len(batch), len(columns))
            yield pd.concat([batch[["doc_id", "y"]].reset_index(drop=True), pd.DataFrame(x, columns=columns)], axis=1)

    # The sample has a bound, so it may be sent to every task. Of rows that repeat an id, the text with the least hash is learned from.
    texts = clean_docs(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = texts.mapInPandas(
        run, "doc_id long, y int, " + ", ".join(f"{c} double" for c in columns)).toPandas()
    # The order of arrival must not matter.
    rows = rows.sort_values("doc_id").head(max_train)
    return fit_trees(rows[columns].to_numpy(), rows["y"].to_numpy(dtype=np.float64))


def scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]]).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": trees.score(x)})

    return clean_docs(docs).mapInPandas(run, "doc_id long, score double")


def passing(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    trees = fit(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
        return pd.Series(trees.score(x))

    return docs.where(score(F.col("text")) >= cut)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    docs, labels = read_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    return scores(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
