"""Quality rules, line first, in DataFrame expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are taken out, and a document
that loses too much of its text that way is rejected, as is one that is too short or repeats itself. All work is
inside the row: no shuffle, and no explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS = 0.5  # share of the word characters that may go with failing lines
SHORT_LINE = 8  # words; only shorter lines must end like a sentence
MAX_NOISE = 0.3  # share of a line's words that end in a run of marks
MAX_SEPARATORS = 0.2  # separators for each word of a line

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"
_SENTENCE_END = r"[.!?:;…。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]*$"
_NOISE = r"[!?#*$%&~^=_]{2,}(?=[\x20\x09-\x0D]|$)"
_SEPARATOR = r"(?<![^\x20\x09-\x0D])[|»«›‹·•>/\\-]+(?![^\x20\x09-\x0D])"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|"
    r"enable javascript|javascript is (?:disabled|required)|click here to|sign up for our newsletter|subscribe to our|"
    r"skip to (?:main )?content|powered by|share on (?:facebook|twitter)|lorem ipsum)\b")


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def _line_fails(line: Column) -> Column:
    words = _n_words(line)
    unfinished = (words < SHORT_LINE) & ~line.rlike(_SENTENCE_END)
    noisy = F.regexp_count(line, F.lit(_NOISE)) > MAX_NOISE * words
    navigation = F.regexp_count(line, F.lit(_SEPARATOR)) > MAX_SEPARATORS * words
    return unfinished | noisy | navigation | line.rlike(BOILERPLATE)


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _SPACE, ""))


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows at the given sorted positions."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        positions, begin,
        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["upto"], p)).alias("n"), (p + 3).alias("upto")),
        lambda acc: acc["n"].cast("bigint"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, lost_share and the counts of the contract) for each row of ``docs``; ``row`` holds its columns."""
    body = F.coalesce(F.col("row")[text], F.lit(""))
    base = docs.select(F.struct("*").alias("row")).select("row", body.alias("body"), F.regexp_extract_all(body, F.lit(_WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    counted = base.select(
        "row", n.cast("bigint").alias("n_words"), _word_chars(F.col("body")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("body", _SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("body", "\n", -1), lambda line: line.rlike(_WORD)).alias("lines"),
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("grams"))
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    sorted_grams = counted.select(
        *[c for c in counted.columns if c not in ("grams", "lines")],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(F.filter("lines", _line_fails), F.lit(0).cast("bigint"), lambda acc, line: acc + _word_chars(line)).alias("lost"),
        F.when(repeats, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    again = F.filter("ordered", lambda g, j: (
        (j > 0) & (F.get("ordered", j - 1)["h"] == g["h"])) | F.coalesce(F.get("ordered", j + 1)["h"] == g["h"], F.lit(False)))
    return sorted_grams.select(
        *[c for c in sorted_grams.columns if c not in ("ordered", "lost")],
        F.coalesce(_covered(F.array_sort(F.transform(again, lambda g: g["i"]))), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.when(F.col("word_chars") > 0, F.col("lost") / F.col("word_chars")).otherwise(0.0).alias("lost_share"))


def judged(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """:func:`measure` with ``base_failed`` and ``kept``.

    The row number keeps a filter on the verdict above the projections: pushed below them, it would spell the word
    list out again for every word.
    """
    stay = F.monotonically_increasing_id() >= 0
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measure(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_loss) & stay)


def quality_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_loss: float = MAX_LOSS) -> DataFrame:
    """The verdict on every row: doc_id, the counts, lost_share, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows and null identifiers are judged like any other row;
    other columns are not looked at. Three-word windows are compared by a 64-bit hash of the words.
    """
    return judged(docs.select(doc_id, text), text, max_loss).select(
        F.col("row")[doc_id].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "lost_share", "base_failed", "kept")


def clean_lines(text: Column) -> Column:
    """The text without its failing lines; lines without a word stay."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(_WORD) | ~_line_fails(line)), "\n")


def drop_low_quality(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS, clean: bool = False) -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged; ``clean`` also takes the failing lines out of the text."""
    kept = judged(docs, text, max_loss).filter("kept").select("row.*")
    return kept.withColumn(text, clean_lines(F.col(text))) if clean else kept
