"""Quality rules by distribution divergence, with DataFrame functions only.

Each document has two histograms: of its characters by class, and of its words by the common words of
its language. Each language has the sums of both over all its documents for a reference.
A document is rejected when the Jensen-Shannon distance (base 2, 0 to 1) between its
histogram and the reference is over a limit. Histograms of few characters or words are noise:
below a minimum length no verdict is given, and above it the limit is
widened by the divergence that a sample of that size is expected to show.

The base rules count words, symbols, repeated lines and words in repeated 3-word windows.
Windows are compared by 64-bit hashes, sorted with their positions within the row, so that
nothing is exploded or shuffled: an n-word text takes O(n log n) steps in its own row, O(n) if no window is repeated.

One pass makes a row of counts for each document, written to the shared folder; the references
are sums over those rows, one for each listed language and one for the others.

Null texts have no words, fail the base and are rejected. A null or unlisted language is judged by
characters alone, against all such documents. Bytes that aren't UTF-8 count as U+FFFD, one of the other characters. Repeated rows each give their row; columns other than
the id, text and language don't matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANKS, WORD_GAP, materialise

#: Common words by language.
COMMON_WORDS = {
    "de": ["das", "der", "die", "ein", "ist", "mit", "und", "von", "zu", "in", "den", "sich", "auf", "für", "nicht", "des"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be", "at"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "una", "su"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
N_COMMON = 16
#: Character classes in the order in which they are taken out of the text; what is left is the last class.
CLASSES = [("lower", "[a-z]+"), ("blank", "[ \\t\\n\\x0B\\f\\r]+"), ("stop", "[.,;:'\"?()-]+"), ("upper", "\\p{Lu}+"), ("other_letter", "\\p{L}+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>!+=/\\\\^~@_]+")]

DEFAULTS = {"min_words": 50, "min_chars": 200, "max_char_distance": 0.285, "max_word_distance": 0.195}


def _counts(docs: DataFrame, id_column: str, text_column: str, lang_column: str, *carried: Column) -> DataFrame:
    """One row of counts for each document, with the carried columns. Each step's expensive columns are used by name, so that they are computed once."""
    text = F.make_valid_utf8(F.coalesce(F.col(text_column), F.lit("")))
    lang = F.when(F.col(lang_column).isin(*COMMON_WORDS), F.col(lang_column)).otherwise(F.lit("other"))
    df = docs.select(F.col(id_column).alias("doc_id"), lang.alias("lang"), text.alias("text"), *carried)
    # characters by class: each class is taken out of what the others left
    df = df.withColumns({"n_chars": F.length("text").cast("long"), "left": F.col("text")})
    for name, pattern in CLASSES:
        df = df.withColumn("next", F.regexp_replace("left", pattern, ""))
        df = df.withColumns({f"c_{name}": F.length("left") - F.length("next"), "left": F.col("next")})
    taken = F.array(*(F.col(f"c_{name}").cast("long") for name, _ in CLASSES), F.length("left").cast("long"))
    df = df.withColumns({"chars": taken, "n_symbols": F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))}).drop("left", "next", *(f"c_{name}" for name, _ in CLASSES))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    df = df.withColumn("trimmed", F.btrim("text", F.lit(BLANKS)))
    df = df.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", WORD_GAP))).drop("trimmed", "text")
    df = df.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"), "spaced": F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" "))})
    # of common words: every word stands between blanks of its own
    listed = None
    for code, words in COMMON_WORDS.items():
        listed = (F.when if listed is None else listed.when)(F.col("lang") == code, F.array(*(F.lit(f" {x} ") for x in words)))
    df = df.withColumn("listed", listed.otherwise(F.array().cast("array<string>")))
    common = F.expr("transform(listed, w -> CAST((octet_length(spaced) - octet_length(replace(spaced, w, ''))) / octet_length(w) AS BIGINT))")
    df = df.withColumn("common", common).drop("spaced", "listed")
    # where windows that the text has twice or more begin, in order
    df = df.withColumn("windows", F.expr("CASE WHEN n_words > 2 THEN transform(sequence(1, CAST(n_words AS INT) - 2), i -> xxhash64(words[i - 1], words[i], words[i + 1])) ELSE CAST(array() AS ARRAY<BIGINT>) END")).drop("words")
    df = df.withColumn("placed", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (x, i) -> struct(x AS h, i AS p))) ELSE CAST(array() AS ARRAY<STRUCT<h: BIGINT, p: INT>>) END")).drop("windows")
    df = df.withColumn("placed", F.expr("filter(placed, (x, j) -> x.h = get(placed, j - 1).h OR x.h = get(placed, j + 1).h)"))
    df = df.withColumn("starts", F.expr("sort_array(transform(placed, x -> x.p))")).drop("placed")
    # a window adds the words that the window before it, in order of position, doesn't hold
    repeated = F.expr("aggregate(zip_with(starts, slice(starts, 2, size(starts)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)")
    return df.withColumn("n_repeat_words", repeated).drop("starts")


def _distance(own: str, reference: str) -> Column:
    """The Jensen-Shannon distance, base 2, of two columns of histograms given as shares; null if one is."""
    part = F.expr(f"zip_with({own}, {reference}, (p, q) -> CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0D END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0D END)")
    return F.sqrt(F.greatest(F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    """Counts as shares of a total; null if the total is 0."""
    return F.when(total > 0, F.transform(counts, lambda x: x / total.cast("double")))


def _with_rest(counts: Column, total: Column) -> Column:
    """Counts and, at the end, what they leave of a total."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)))


def _limit(most: float, classes: int, size: Column) -> Column:
    """The limit on a distance, widened by what a sample of this size is expected to diverge."""
    return F.sqrt(F.lit(most * most) + F.lit((classes - 1) / (8 * math.log(2))) / F.greatest(size, F.lit(1)))


def _judged(docs: DataFrame, id_column: str, text_column: str, lang_column: str, limits: dict[str, float], *carried: Column) -> DataFrame:
    """The counts, base_failed, both distances and kept for each row of docs, with the carried columns."""
    own = DEFAULTS | limits
    counts = materialise(_counts(docs, id_column, text_column, lang_column, *carried), "counts")
    # at most one row for each listed language and one for the others
    chars, words = range(len(CLASSES) + 1), range(N_COMMON)
    sums = [F.sum(F.get("chars", i)).alias(f"c_{i}") for i in chars] + [F.coalesce(F.sum(F.get("common", i)), F.lit(0)).alias(f"w_{i}") for i in words]
    sums = counts.groupBy("lang").agg(*sums, F.sum("n_chars").alias("all_chars"), F.sum("n_words").alias("all_words"))
    r_chars, r_common = F.array(*(F.col(f"c_{i}") for i in chars)), F.array(*(F.col(f"w_{i}") for i in words))
    reference = sums.select("lang", _shares(r_chars, F.col("all_chars")).alias("r_chars"), _shares(_with_rest(r_common, F.col("all_words")), F.col("all_words")).alias("r_words"))
    df = counts.join(F.broadcast(reference), "lang")
    df = df.withColumns({"p_chars": _shares(F.col("chars"), F.col("n_chars")), "p_words": F.when(F.col("lang") != "other", _shares(_with_rest(F.col("common"), F.col("n_words")), F.col("n_words")))})
    df = df.withColumns({"char_distance": _distance("p_chars", "r_chars"), "word_distance": _distance("p_words", "r_words")})
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd_chars = (F.col("n_chars") >= own["min_chars"]) & (F.col("char_distance") > _limit(own["max_char_distance"], len(CLASSES) + 1, F.col("n_chars")))
    odd_words = (F.col("n_words") >= own["min_words"]) & (F.col("word_distance") > _limit(own["max_word_distance"], N_COMMON + 1, F.col("n_words")))
    kept = ~base_failed & ~F.coalesce(odd_chars, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))
    return df.withColumns({"n_symbols": F.col("n_symbols").cast("long"), "base_failed": base_failed, "kept": kept})


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **limits: float) -> DataFrame:
    """The counts, base_failed, both distances and kept for each document, one row for each row of docs."""
    return _judged(docs, id_column, text_column, lang_column, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def keep(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **limits: float) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns: each row goes by its own verdict, whatever its id."""
    return _judged(docs, id_column, text_column, lang_column, limits, F.struct("*").alias("row")).where("kept").select("row.*")
