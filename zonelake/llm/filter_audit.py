"""Filter interaction audit: what each of five filters removes, in every order, from one histogram of failure masks.

Native expressions judge every whole text by four filters; the fifth, exact copies, takes the smallest doc_id of each
text from a group-by on the text's SHA-256 (equal digests are taken as equal texts), so a crowd of copies is combined
before the shuffle and no text is shuffled. Rows then meet that minimum and their labels by doc_id, which no group of
copies makes hot. All 120 orders follow from the 32 counts of each part: what a filter removes at a step are the rows
that fail it and none before it.

Defined results: null text: empty; null source: the part with the empty name; a null doc_id is smaller than none, has no
label and never counts as a copy; rows that share doc_id and text are both kept by the copy filter; several label
rows of a document: good or toxic if any says so; a part without documents or an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import let, text_of, words_of

#: The filters in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 200, 50, 2, "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D."""
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = lambda words: (
        F.size(words) < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PCT * F.size(words), 100 * upper > MAX_UPPER_PCT * F.length(text), text.rlike(SYMBOLS),
    )
    return let(words_of(text), lambda words: sum((c.cast("int") * (1 << k) for k, c in enumerate(failed(words))), F.lit(0)))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic), a row for each document."""
    doc_id = F.col(f"`{id_col}`")
    base = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    # Null ids meet nothing, so they are dealt by where they were read instead of to one task.
    salt = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(F.lit(0))
    rows = base.select("doc_id", salt.alias("salt"), "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = base.groupBy(F.unhex(F.sha2("text", 256)).alias("m_digest")).agg(F.min("doc_id").alias("m_id")).where("m_id IS NOT NULL").withColumn("m_salt", F.lit(0))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id"), F.lit(0).alias("l_salt")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = rows.join(first, (F.col("doc_id") == F.col("m_id")) & (F.col("salt") == F.col("m_salt")) & (F.col("digest") == F.col("m_digest")), "left")
    met = met.join(marks, (F.col("doc_id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left")
    copy = (F.col("doc_id").isNotNull() & F.col("m_id").isNull()).cast("int") * (1 << FILTERS.index("E"))
    return met.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    counted = masks(docs, labels, id_col, text_col, part_col).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # 32 cells at most for each part, whatever the number of documents.
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = [F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << FILTERS.index(x)) for x in p]).alias("bits")) for p in permutations(FILTERS)]
    steps = cells.select("*", F.inline(F.array(*orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("bit", F.element_at("bits", F.col("step")))
    steps = steps.withColumn("earlier", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b)))

    def total(which, of: str = "n", times=None) -> Column:
        weigh = lambda c: c[of] if times is None else c[of] * times(c)
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, c: a + weigh(c))

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    still = lambda c: c["mask"].bitwiseAND(F.col("earlier")) == 0
    here = lambda c: fails(c) & still(c)
    # Of the orders of a mask's k filters, each of them comes first in one of k.
    share = lambda c: F.floor(F.lit(factorial(len(FILTERS))) / F.bit_count(c["mask"]))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: still(c) & ~fails(c)).alias("kept"), total(here).alias("removed"), total(lambda c: fails(c) & ~still(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        total(fails, "n", share).alias("shapley"),
    )
