"""Quality rules: surface counts plus distribution divergence, in DataFrame functions only.

Base counts come from the words of the whole text. The method compares two histograms of a document, its
character classes and the common words of its language, with the references of that language by the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). References are means of normalised
histograms over all documents that pass the base rules and the length guards, kept as integer parts per
million so that their sums don't depend on the order of rows.

Defined results: null or empty text: all counts 0, base_failed true; null or unknown language: the group
``other``, whose common-word histogram isn't compared; texts under a guard are judged by the base rules
alone; repeated rows are judged one by one; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import SPACE, let, materialise, text_of, words_of

# Frequent function words of the languages with a reference.
COMMON_WORDS = {
    "en": "the of and to a in is that for was on with as it by at from this are be or an have not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec elle ce".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo es como más".split(),
}
N_COMMON = max(map(len, COMMON_WORDS.values())) + 1

#: Character classes of what is left without a-z, each by the characters that it removes.
CLASSES = ("[A-Z]+", "[0-9]+", SPACE, r"[.,;:'\"()\[\]?!-]+", r"[\x21-\x7E]+")

PPM = 1_000_000
MIN_CHARS, MIN_WORDS = 200, 60
#: Limit of the class distance alone, and of the sum of both distances; short texts get LENGTH_SLACK / words more.
MAX_CLASS_DISTANCE, MAX_SUM, LENGTH_SLACK = 0.32, 0.38, 13.0
WINDOW = 8


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes within one text. Sorting brings equal windows together; the sorted
    starts of repeated windows then cover min(8, distance to the next start) words each.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(starts: Column) -> Column:
        following = F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1)))
        gaps = F.zip_with(starts, following, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def starts(pairs: Column) -> Column:
        equals = lambda x, j: F.coalesce(x["h"] == F.get(pairs, j)["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, j: equals(x, j - 1) | equals(x, j + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda p: let(starts(p), covered)))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def class_counts(text: Column, rest: Column) -> Column:
    """Characters by class: a-z, the CLASSES in order (each among what the earlier ones left), all others."""

    def after(col: Column, k: int, counts: list[Column]) -> Column:
        if k == len(CLASSES):
            return F.array(*counts, F.length(col))
        return let(F.regexp_replace(col, CLASSES[k], ""), lambda left: after(left, k + 1, [*counts, F.length(col) - F.length(left)]))

    return after(rest, 0, [F.length(text) - F.length(rest)])


def common_counts(words: Column, lang: Column) -> Column:
    """Occurrences of each common word of the language, then all other words; null for ``other``."""
    def counted(listed: list[str]) -> Column:
        few = F.transform(F.filter(words, lambda w: F.lower(w).isin(listed)), F.lower)
        unused = [F.lit(0)] * (N_COMMON - 1 - len(listed))
        return let(few, lambda c: F.array(*[F.size(c) - F.size(F.array_remove(c, w)) for w in listed], *unused, F.size(words) - F.size(c)))

    found = None
    for code, listed in COMMON_WORDS.items():
        found = (F if found is None else found).when(lang == code, counted(listed))
    return found


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One pass over the texts; everything later reads these narrow rows."""
    lang = F.col(f"`{lang_col}`")
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"),
        F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("other")).alias("lang"),
    )
    base = base.select("doc_id", "text", "lang", words_of(F.col("text")).alias("words"), F.regexp_replace("text", "[a-z]+", "").alias("rest"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("rest") - F.length(F.regexp_replace("rest", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        class_counts(F.col("text"), F.col("rest")).cast("array<bigint>").alias("classes"),
        common_counts(F.col("words"), F.col("lang")).cast("array<bigint>").alias("common"),
    )


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)


def shares(counts: Column) -> Column:
    """Parts per million, rounded down; null without counts."""
    return let(total(counts), lambda n: F.when(n > 0, F.transform(counts, lambda c: F.floor(c.cast("double") * PPM / n).cast("long"))))


def references(feats: DataFrame) -> DataFrame:
    """Mean histograms by language: at most one row for each listed language and ``other``."""
    usable = feats.where(~F.col("base_failed") & (total(F.col("classes")) >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS))
    usable = usable.select("lang", shares(F.col("classes")).alias("c"), shares(F.col("common")).alias("w"))
    sums = [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)] + [F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON)]
    return usable.groupBy("lang").agg(*sums).select(
        "lang", F.array(*[f"c{i}" for i in range(len(CLASSES) + 2)]).alias("ref_classes"), F.array(*[f"w{i}" for i in range(N_COMMON)]).alias("ref_common")
    )


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is null or has no counts."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def distance(n: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: let(F.struct((x / n["a"]).alias("p"), (y / n["b"]).alias("q")), lambda v: part(v["p"], (v["p"] + v["q"]) / 2) + part(v["q"], (v["p"] + v["q"]) / 2)))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2))

    sums = F.struct(total(a).alias("a"), total(b).alias("b"))
    return F.when(a.isNotNull() & b.isNotNull(), let(sums, lambda n: F.when((n["a"] > 0) & (n["b"] > 0), distance(n))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: base counts, both distances and the verdict ``kept``."""
    feats = features(docs, id_col, text_col, lang_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    feats = materialise(feats.withColumn("base_failed", failed))
    judged = feats.join(F.broadcast(references(feats)), "lang", "left")
    judged = judged.withColumn("class_distance", F.when(total(F.col("classes")) >= MIN_CHARS, js_distance(F.col("classes"), F.col("ref_classes"))))
    judged = judged.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("common"), F.col("ref_common"))))
    both = F.col("class_distance") + F.col("word_distance") > MAX_SUM + LENGTH_SLACK / F.col("n_words")
    diverges = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(both, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~diverges).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
