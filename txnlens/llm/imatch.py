"""I-Match fingerprints: the distinct terms of a middle band of document frequency, hashed under several random lexicons.

Document frequencies are counted over all documents in ``2 ** CELL_BITS`` cells of hashed terms, so the lexicon is a bitmap of
fixed size whatever the corpus. A random lexicon keeps one in 8 to 256 terms of the band; a signature is the
hash of the sorted kept terms. Small lexicons survive changes to a long text, large ones tell short texts apart. Two fingerprints
are alike in the share of equal signatures among those that at least one of them has.

A term is a run of letters and digits in lower case. Null texts count as empty. A text without terms in the band is hashed by
all its terms; one without terms has the fixed value of no terms, so equal texts always have equal fingerprints. Rows of equal
doc_id follow each other by the hash of their text, rows without one come last. A single row follows itself; an empty table gives
an empty result. Only DataFrame functions run.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlens.llm.common import clean_docs, read_documents

CELL_BITS = 20
#: Least and greatest share of documents of a term in the band.
BAND = (0.0005, 0.1)
#: A level keeps one term in two to this power in each of its lexicons; lexicons of a level.
THINNING, PER_LEVEL = (3, 4, 5, 6, 7, 8), 7
#: What Spark's hash gives for an empty list.
HASH_SEED = 42
#: Rows of a range of the order, about; ranges that are told apart by a constant array, at most, the finer ones come from a table.
RANGE_ROWS, COARSE = 1_000, 1_024
#: Rows that are sent to every task, at most; more are joined by a shuffle.
SMALL_TABLE = 1_000_000


def terms(text: Column) -> Column:
    """Sorted hashes of the distinct terms."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def cell(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << CELL_BITS) - 1))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> Column:
    """Bitmap of the cells in the band, as a constant array of longs."""
    cells = clean_docs(docs).select(F.explode(F.array_distinct(F.transform(terms(F.col("text")), cell))).alias("c"))
    counts = cells.groupBy("c").count()
    total = docs.count()
    inside = counts.where(F.col("count").between(band[0] * total, band[1] * total))
    words = inside.groupBy((F.col("c") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("c") % 64).cast("int"))).alias("bits")).collect()
    found = [0] * (1 << (CELL_BITS - 6))
    for row in words:  # at most as many rows as the bitmap has longs
        found[row["w"]] = row["bits"]
    return F.from_json(F.lit(json.dumps(found, separators=(",", ":"))), "array<bigint>")


def signatures(text: Column, bitmap: Column, own: str, df: DataFrame) -> DataFrame:
    """``df`` with ``own``: the signatures of ``text``, null where a lexicon keeps none of its terms."""
    def inside(t: Column) -> Column:
        c = cell(t)
        return F.getbit(F.get(bitmap, F.shiftright(c, 6).cast("int")), (c % 64).cast("int")) == 1

    # Level i deals the terms out by its own bits of their hash, above those of the cell; its first lexicons are kept.
    shifts = [CELL_BITS + sum(THINNING[:i]) for i in range(len(THINNING))]

    def dealt(t: Column, i: int) -> Column:
        return F.shiftright(t, shifts[i]).bitwiseAND(F.lit((1 << THINNING[i]) - 1))

    def of_level(i: int) -> Column:
        return F.filter("_band", lambda t: dealt(t, i) < PER_LEVEL)

    def signature(i: int, j: int) -> Column:
        """The hash of no terms is the seed, hence null."""
        return F.nullif(F.xxhash64(F.filter(f"_level{i}", lambda t: dealt(t, i) == j)), F.lit(HASH_SEED).cast("long"))

    levels = range(len(THINNING))
    out = df.withColumn("_terms", terms(text)).withColumn("_band", F.filter("_terms", inside))
    out = out.withColumns({f"_level{i}": of_level(i) for i in levels})
    plain = F.array(*[F.when(F.lit(k == 0), F.xxhash64("_terms")) for k in range(len(THINNING) * PER_LEVEL)])
    every = F.array(*[signature(i, j) for i in levels for j in range(PER_LEVEL)])
    return out.withColumn(own, F.when(F.size("_band") > 0, every).otherwise(plain)).drop(
        "_terms", "_band", *[f"_level{i}" for i in levels])


def likeness(a: str, b: str) -> Column:
    pairs = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    some = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    return F.coalesce(same / F.when(some > 0, some), F.lit(1.0))


def as_text(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda s: F.coalesce(F.lower(F.hex(s)), F.lit("-"))), ".")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc_id, …)`` with ``next_<c>`` of the row that follows by descending doc_id; after the last comes the first.

    Rows meet in ranges of the id, as many as the rows need: coarse ranges by approximate quantiles of all ids, and within each finer
    ones by its own quantiles. The first rows of a range also visit the range before it, as the successors of its last one.
    """
    lowest = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(lowest))
    rows = docs.withColumn("_key", key).withColumn("_tie", F.xxhash64("text"))
    total = docs.count()
    coarse = min(max(total // RANGE_ROWS, 1), COARSE)
    fine = max(-(-total // (coarse * RANGE_ROWS)), 1) if coarse == COARSE else 1

    def cuts(parts: int) -> Column:
        return F.array_distinct(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 100 * parts))

    def above(limits: Column) -> Column:
        """Range 0 has the greatest ids."""
        return F.size(F.filter(limits, lambda b: b >= F.col("_key")))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if coarse * fine <= SMALL_TABLE else df

    bounds = rows.select("_key").agg(cuts(coarse)).first()[0] if coarse > 1 else []
    rows = rows.withColumn("_coarse", above(F.array(*[F.lit(b) for b in bounds])) if bounds else F.lit(0))
    if fine > 1:
        inner = rows.select("_coarse", "_key").groupBy("_coarse").agg(cuts(fine).alias("_cuts"))
        rows = rows.join(small(inner), "_coarse").withColumn("_fine", above(F.col("_cuts"))).drop("_cuts")
    else:
        rows = rows.withColumn("_fine", F.lit(0))
    rows = rows.withColumn("_range", F.struct("_coarse", "_fine"))
    along = Window.orderBy("_range")  # of one small row a range
    heads = rows.select("_range", "_key").groupBy("_range").agg(F.max("_key").alias("_key"))
    visits = heads.select("_key", F.coalesce(F.lag("_range").over(along), F.max("_range").over(
        along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_visits"))
    rows = rows.join(small(visits), "_key", "left")
    places = F.when(F.col("_visits").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("_visits").alias("r"), F.lit(1).alias("guest"))))
    placed = rows.withColumn("_place", F.explode(places)).withColumn("_r", F.col("_place.r")).withColumn("_guest", F.col("_place.guest"))
    order = Window.partitionBy("_r").orderBy("_guest", F.col("_key").desc(), "_tie")
    return placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_guest = 0").select(
        *docs.columns, *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame, bitmap: Column | None = None) -> DataFrame:
    """``(doc_id, signatures)`` under the lexicon of ``docs``, or a given one."""
    bitmap = lexicon(docs) if bitmap is None else bitmap
    return signatures(F.col("text"), bitmap, "signatures", clean_docs(docs)).select("doc_id", "signatures")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row with its fingerprint, that of its text with the second half replaced by the next document, and both likenesses."""
    bitmap = lexicon(docs)
    own = signatures(F.col("text"), bitmap, "own", clean_docs(docs))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = with_next(own, ["text", "own"]).withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    done = signatures(F.col("edited"), bitmap, "changed", both.select("doc_id", "n_chars", "own", "next_own", "edited"))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    return edited_fingerprints(read_documents(spark, folder))
