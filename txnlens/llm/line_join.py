"""Line deduplication by an exact set-similarity join: a line goes if an earlier one has a Jaccard similarity of 0.8 or more.

The tokens of a line are its distinct words (runs of letters and digits, in lower case), the longest first, which are rare ones
mostly. Lines are found by couples of tokens that follow each other in this order: a couple is much rarer than its tokens. A token
that another line lacks breaks two couples, one that only the other line has breaks one, so of n tokens' couples at most
0.4 n are broken between similar lines, and the first ``floor(0.4 n) + 1 + t`` of both lines have t + 1 in common; t grows with n, as
long lines share one by chance. Pairs that meet so often pass the length filter and differ in few enough bits of a parity of their
tokens before their full sets are compared. Lines with the same tokens are one from the start. In a group of lines that share a couple, each is first compared with the earliest; only those
that don't match it are joined with all others, so a large group of similar lines isn't multiplied out.

Earlier means a smaller (doc_id, line number); an earlier line counts whether or not it goes itself. Lines without words stay. A
null text counts as empty, a null doc_id comes before all others. Of rows that repeat a doc_id, lines with the same number count
as one place; where they differ, the greater one is compared. An empty table gives an empty result. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlens.llm.common import clean_docs, drop_table, free_shuffles, kept_table, read_documents, unused

#: Bits of a token's hash; above them is its length, the greatest first, up to a limit.
HASH_BITS, LONGEST = 58, 31
#: Low bits of a line's mark, for its number of tokens, and the greatest that fits.
SIZE_BITS = 10
MOST_SIZE = (1 << SIZE_BITS) - 1
#: Lines of fewer tokens are similar only to lines of the same ones.
LEAST_TOKENS = 4
#: Document ids that are sent to every task, at most; more are joined by a shuffle.
SMALL_IDS = 1_000_000


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def ordered_tokens(line: Column) -> Column:
    """Distinct tokens, the longest first."""
    token = lambda w: F.shiftleft((LONGEST - F.least(F.char_length(w), F.lit(LONGEST))).cast("long"), HASH_BITS).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS))
    return F.sort_array(F.array_distinct(F.transform(words_of(line), token)))


def spare(n: Column) -> Column:
    """How many couples, beside one, similar lines of ``n`` or more tokens have in common."""
    return F.floor(n / 20).cast("int")


def couples(tokens: str) -> Column:
    """Hashes of the first couples of neighbours, as many as similar lines need to have one in common."""
    n = F.size(tokens)
    most = F.when(n >= LEAST_TOKENS, F.floor(n * 2 / 5).cast("int") + 1 + spare(F.least(n, F.lit(MOST_SIZE)))).otherwise(0)
    return F.zip_with(F.slice(tokens, 1, most), F.slice(tokens, 2, most), lambda x, y: F.hash(x, y))


def flips(tokens: str | Column) -> Column:
    """64 bits, each flipped by every token that falls on it."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(bit(t)))


def mark(tokens: str) -> Column:
    """What tells lines apart in eight bytes: 54 of their ``flips``, and the number of tokens, or the greatest that fits."""
    return flips(tokens).bitwiseAND(F.lit(~MOST_SIZE)).bitwiseOR(F.least(F.size(tokens), F.lit(MOST_SIZE)).cast("long"))


def size_of(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(MOST_SIZE)).cast("int")


def parity(tokens: str, half: int) -> Column:
    """``flips`` of one half of the tokens; the two halves take them between them."""
    return flips(F.filter(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)) == half))


def line_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``; line numbers count from 0."""
    return clean_docs(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


class Places:
    """Places ``(doc_id, line_no)`` in their order: one long where those of ``lines`` fit into it, else a struct."""

    def __init__(self, lines: DataFrame) -> None:
        low, high, last = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line_no")).first()
        self.low, self.width = low or 0, (last or 0) + 1
        self.packed = ((high or 0) - self.low + 2) * self.width < 1 << 62

    def doc(self) -> Column:
        """The document of a row as a number, null before all others."""
        return F.coalesce(F.col("doc_id") - F.lit(self.low) + 1, F.lit(0)).cast("long") if self.packed else F.coalesce("doc_id", F.lit(-(1 << 63)))

    def of_row(self) -> Column:
        return self.doc() * self.width + F.col("line_no") if self.packed else F.struct(self.doc().alias("d"), F.col("line_no").alias("i"))

    def doc_of(self, place: str) -> Column:
        return F.expr(f"{place} div {self.width}") if self.packed else F.col(f"{place}.d")


def similar_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, Places]:
    """All lines with words ``(doc_id, line_no, a, b)`` keyed by two hashes of their tokens, distinct ones ``(a, b, first, gone)``, and places.

    ``first`` is the place of the earliest line with these tokens; ``gone`` says that it has an earlier match itself.
    """
    # Lines without words are left out by the line itself: a filter on its tokens would be moved below them and make them twice.
    lines = line_rows(docs).where(F.col("line").rlike(r"[\p{L}\p{N}]")).withColumn("tokens", ordered_tokens(F.col("line"))).select(
        "doc_id", "line_no", F.xxhash64("tokens").alias("a"), F.xxhash64("tokens", F.lit(1)).alias("b"),
        mark("tokens").alias("mark"), couples("tokens").alias("couples"))
    spark = docs.sparkSession
    full, full_path = kept_table(lines, "line-rows")
    places = Places(full)
    # The couples of the earliest line stand for all of them, as they have the same tokens.
    distinct, distinct_path = kept_table(full.groupBy("a", "b").agg(
        F.min(places.of_row()).alias("first"), F.max("mark").alias("mark"), F.max("couples").alias("couples")).select(
        "first", "mark", "couples"), "line-distinct")
    lines, _ = kept_table(full.select("doc_id", "line_no", "a", "b"), "line-keys")
    drop_table(spark, full_path)
    free_shuffles(spark)
    group = Window.partitionBy("couple")
    rows = distinct.select("first", "mark", F.explode("couples").alias("couple")).withColumns(
        {"h": F.min(F.struct("first", "mark")).over(group), "size": F.count("*").over(group)})
    # Two lines under a couple are done once they are compared; of more, all but the earliest may still meet each other.
    near = possible("first", "mark", "h.first", "h.mark")
    enough = 1 + spare(F.least(size_of(F.col("mark")), size_of(F.col("h.mark"))))
    met, met_path = kept_table(rows.where(F.col("first") != F.col("h.first")).where(near | (F.col("size") > 2)).select(
        "couple", "first", "mark", F.when(near, F.col("h.first")).alias("other"), F.when(near, enough).alias("enough"),
        (F.col("size") > 2).alias("several")), "line-couples")
    drop_table(spark, distinct_path)
    free_shuffles(spark)

    to_head, _ = kept_table(met.where("other IS NOT NULL").groupBy("first", "other", "enough").agg(F.count("*").alias("c")), "line-heads")
    gone, _ = kept_table(verified(docs, to_head.where("c >= enough").select("first", "other"), places), "line-gone")
    every = met.where("several").select("couple", "first", "mark")
    others = every.select(F.col("couple").alias("_couple"), F.col("first").alias("other"), F.col("mark").alias("_mark"))
    between = every.join(gone, "first", "left_anti").join(others, (F.col("couple") == F.col("_couple")) & possible(
        "first", "mark", "other", "_mark")).select("first", "other", (1 + spare(F.least(size_of(F.col("mark")), size_of(
            F.col("_mark"))))).alias("enough")).groupBy("first", "other", "enough").agg(F.count("*").alias("c"))
    # Meetings with a head and others add up; those that were enough by themselves have been verified.
    rest = to_head.where("c < enough").join(gone, "first", "left_anti").unionByName(between).groupBy("first", "other").agg(
        F.sum("c").alias("c"), F.max("enough").alias("enough")).where("c >= enough").select("first", "other")
    later, _ = kept_table(verified(docs, rest, places), "line-gone")
    drop_table(spark, met_path)
    free_shuffles(spark)
    firsts = lines.groupBy("a", "b").agg(F.min(places.of_row()).alias("first"))
    return lines, firsts.join(gone.unionByName(later).withColumn("gone", F.lit(True)), "first", "left").withColumn(
        "gone", F.coalesce("gone", F.lit(False))), places


def possible(first: str, one: str, before: str, two: str) -> Column:
    """Whether the line at ``first`` may match the earlier one at ``before``, by their marks.

    Every flip in which they differ is a token that one of the lines lacks. Where a number of tokens didn't fit, the test only
    lets more pass.
    """
    n, m = size_of(F.col(one)), size_of(F.col(two))
    apart = F.bit_count(F.col(one).bitwiseXOR(F.col(two)).bitwiseAND(F.lit(~MOST_SIZE)))
    # An overlap of 0.8 / 1.8 of the sum leaves a ninth of it apart.
    return (F.col(before) < F.col(first)) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m)


def verified(docs: DataFrame, pairs: DataFrame, places: Places) -> DataFrame:
    """``(first)`` of the lines in ``pairs(first, other)`` whose words are similar enough to those of one ``other``."""
    pairs, _ = kept_table(pairs, "line-pairs")
    wanted, _ = kept_table(pairs.select(F.explode(F.array("first", "other")).alias("p")).distinct(), "line-wanted")
    ids = wanted.select(places.doc_of("p").alias("d")).distinct()
    rows = clean_docs(docs)
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    rows = rows.join(ids, places.doc() == F.col("d"), "left_semi")
    few = F.broadcast(wanted) if wanted.count() <= SMALL_IDS else wanted
    free_shuffles(docs.sparkSession)
    lines = line_rows(rows).select(places.of_row().alias("p"), "line")
    sets, _ = kept_table(lines.join(few, "p", "left_semi").groupBy("p").agg(F.max("line").alias("line")).withColumn(
        "tokens", ordered_tokens(F.col("line"))).select("p", F.array_distinct(words_of(F.col("line"))).alias("words"), F.size("tokens").alias(
            "n"), parity("tokens", 0).alias("u"), parity("tokens", 1).alias("v")), "line-sets")

    def of(*columns: str) -> tuple[DataFrame, DataFrame]:
        return tuple(sets.select(F.col("p").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns]) for p in ("first", "other"))

    # More bits leave few pairs whose words must meet.
    one, other = of("n", "u", "v")
    apart = F.bit_count(F.col("first_u").bitwiseXOR(F.col("other_u"))) + F.bit_count(F.col("first_v").bitwiseXOR(F.col("other_v")))
    some = pairs.join(one, "first").join(other, "other").where(9 * apart <= F.col("first_n") + F.col("other_n")).select("first", "other")
    one, other = of("words")
    both = some.join(one, "first").join(other, "other")
    shared = F.size(F.array_intersect("first_words", "other_words"))
    return both.where(9 * shared >= 4 * (F.size("first_words") + F.size("other_words"))).select("first").distinct()


def decisions(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)``, a row a document; ``removed`` lists line numbers from 0."""
    lines, distinct, places = similar_lines(docs)
    flags = lines.join(distinct, ["a", "b"]).where(F.col("gone") | (F.col("first") != places.of_row()))
    by_doc = flags.groupBy("doc_id").agg(F.count("*").alias("n_removed"), F.sort_array(F.collect_list("line_no")).alias("removed"))
    sizes = clean_docs(docs).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return sizes.join(by_doc.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all rows and columns, its texts without the removed lines."""
    other, removed = unused(docs, "_id", "_removed")
    cut = decisions(docs).where("n_removed > 0").select(F.col("doc_id").alias(other), F.col("removed").alias(removed)).distinct()
    joined = docs.join(cut, docs["doc_id"].cast("long").eqNullSafe(cut[other]), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(removed, i)), "\n")
    return joined.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(left)).select(docs.columns)


def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of ``documents``."""
    return decisions(read_documents(spark, folder)).withColumn("removed", F.array_join("removed", ","))
