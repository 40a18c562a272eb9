"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gets a histogram of character classes and one of its language's common words. Summed over
all texts of a language they give the language's references. A text fails where its Jensen-Shannon
distance to a reference is above a limit, if it has words enough for that histogram to mean something.
Plain counts (words, symbols, repeated lines and 8-word windows) stand beside the verdict.

Rows: a null text counts as empty, has no words and fails the base rule. A null language is a language
of its own; a language without a word list has all its words in "other", so that only its character
classes count. Repeated rows are judged alike. Empty tables give empty results. Texts of any length are
treated whole; the repeat count sorts a text's window hashes (64 bits) and never compares all pairs.
Extra columns pass through; columns named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, unpacked

SPACE = r"[\x20\x09-\x0D]"
#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "at", "by", "this", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "im", "ist", "nicht", "ein", "dem", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}
#: Character classes by pattern; what none of them matches (other letters, mostly) is the last class.
CLASSES = {"space": SPACE, "upper": "[A-Z]", "digit": "[0-9]", "stop": r"[.,;:!?'\"()\-]", "symbol": r"[#*$%&|<>]"}
#: Characters that belong to none of them, taken out before the counts (a positive class, as the regex engine is slow on long negated ones).
PLAIN = r"[a-z\x{80}-\x{10FFFF}]+"
#: Words a text needs before a histogram is judged, and the largest distances that pass.
MIN_WORDS_CLASSES, MIN_WORDS_COMMON = 20, 100
MAX_CLASSES, MAX_COMMON = 0.27, 0.32
#: The base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (0 to 1) between two histograms of the same length, given as arrays of counts; null where one is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    def term(a: Column, b: Column) -> Column:
        """a * log2(a / m) for m between a and b."""
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    def both(n: Column, m: Column) -> Column:
        return F.zip_with(F.transform(p, lambda v: v / n), F.transform(q, lambda v: v / m), lambda a, b: term(a, b) + term(b, a))

    n, m = total(p), total(q)
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both(n, m), F.lit(0.0), lambda acc, v: acc + v) / 2)))


def with_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the arrays class_counts and common_counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_counts", "common_counts"]
    df = df.drop(*made)
    kept = df.columns
    commons = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = df.select(
        packed(df, kept),
        F.array_remove(F.split(t, SPACE + "++"), "").alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.char_length(t).alias("_chars"),
        F.regexp_replace(t, PLAIN, "").alias("_marks"),
        F.coalesce(F.try_element_at(commons, F.col(lang)), F.array().cast("array<string>")).alias("_common"),
    )
    marks = [F.regexp_count("_marks", F.lit(p)) for p in CLASSES.values()]
    n = F.size("_words")
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    out = out.select(
        "_row",
        "_chars",
        F.array(*marks).alias("_classes"),
        "_common",
        n.alias("_n"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup"),
        F.filter("_words", lambda w: w.isin(every)).alias("_found"),
        F.when(n > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    for step in (1, 2, 4):  # hashes of 2, 4 and then 8 words; those that reach beyond the end go after
        later = F.slice("_hashes", step + 1, F.greatest(F.size("_hashes") - step, F.lit(0)))
        out = out.withColumn("_hashes", F.zip_with("_hashes", later, lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("_hashes", F.slice("_hashes", 1, F.greatest(F.size("_hashes") - WINDOW + 1, F.lit(0))))
    size = max(map(len, COMMON_WORDS.values()))
    found = [F.when(F.size("_common") > i, F.size("_found") - F.size(F.array_remove("_found", F.get("_common", F.lit(i))))) for i in range(size)]
    out = out.withColumn("_in", F.array_compact(F.array(*found))).withColumn("_again", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    out = out.withColumn("_pairs", F.when(F.col("_again"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("_starts", F.sort_array(F.filter(F.transform("_pairs", lambda x, i: F.when((F.get(F.col("_pairs"), i - 1)["h"] == x["h"]) | (F.get(F.col("_pairs"), i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("_starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), i + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda acc, v: acc + v)
    inside = F.aggregate("_in", F.lit(0), lambda acc, v: acc + v)
    seen = F.aggregate("_classes", F.lit(0), lambda acc, v: acc + v)
    repeat = F.coalesce(covered, F.lit(0)).cast("long")
    return out.select(
        *unpacked(kept),
        F.col("_n").cast("long").alias("n_words"),
        (F.col("_chars") - F.col("_classes")[0]).cast("long").alias("word_chars"),
        F.col("_classes")[4].cast("long").alias("n_symbols"),
        F.col("_dup").cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.concat("_classes", F.array(F.col("_chars") - seen)).cast("array<double>").alias("class_counts"),
        F.concat("_in", F.array(F.col("_n") - inside)).cast("array<double>").alias("common_counts"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def references(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language: the histograms summed over all its texts, as arrays."""
    size = 1 + max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(1 + len(CLASSES))] + [F.sum(F.get("common_counts", F.lit(i))).alias(f"w{i}") for i in range(size)]
    given = counted.groupBy(F.col(lang).alias("_lang")).agg(*sums)
    return given.select(
        "_lang",
        F.array(*[f"c{i}" for i in range(1 + len(CLASSES))]).alias("_class_ref"),
        F.filter(F.array(*[f"w{i}" for i in range(size)]), lambda v: v.isNotNull()).alias("_common_ref"),
    )


def judge(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds class_distance, common_distance and kept to what with_counts gives."""
    counted = counted.drop("class_distance", "common_distance", "kept")
    out = counted.join(references(counted, lang), F.col(lang).eqNullSafe(F.col("_lang")), "left")
    out = out.withColumn("class_distance", jensen_shannon(F.col("class_counts"), F.col("_class_ref")))
    out = out.withColumn("common_distance", jensen_shannon(F.col("common_counts"), F.col("_common_ref")))
    far = (F.col("n_words") >= MIN_WORDS_CLASSES) & (F.col("class_distance") > MAX_CLASSES)
    far = far | ((F.col("n_words") >= MIN_WORDS_COMMON) & (F.col("common_distance") > MAX_COMMON))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("_lang", "_class_ref", "_common_ref")
