"""Quality rules: line-first cleaning, in DataFrame functions only.

Every ``\\n`` line with a word is judged on its own: a line fails when it is
navigation (a row of short link-like pieces between bars), carries too many
symbols, shouts in capitals, is a line of 6 to 24 words without an end mark
(a heading is shorter, unpunctuated prose longer), or holds a boilerplate
phrase. Failed lines are removed; a document that loses more than
``max_lost`` of its characters is rejected. Document-wide base figures
(words, symbols, repeated lines, repeated five-word windows) are computed on
the whole text beside it.

Everything is computed inside one row (no shuffle); a text's arrays are
bounded by the text itself.

Defined results: a null or empty text has no words and no lines, fails the
base rule (under ``min_words``) and is not kept; repeated rows are judged
alike; other columns of the input pass through untouched whatever their
names, except that a column named like one of the added ones is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import words_of

SYMBOLS = r"[#*$%&|<>]"
A_WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
BASE_MIN_WORDS = 10
BASE_MAX_REPEAT_PCT = 20

#: Rules for one line.
END_MARKS = r"""[.!?:;,"'”’»…)\]][\x20\x09-\x0D]*\z"""
#: 6 to 24 words: longer than a heading, shorter than a paragraph.
OPEN_LINE = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){5,23}[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+\z"
NAV_LINE = r"(?:^|\|)(?:[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D|]++[\x20\x09-\x0D]*+){0,4}\|){3}"
MAX_SYMBOL_SHARE = 0.1
SHOUT_MIN_LETTERS = 20
SHOUT_SHARE = 0.6
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
               "cookie settings", "accept cookies", "accept all cookies", "enable javascript",
               "sign up for our newsletter", "skip to content", "skip to main content", "click here to",
               "share this page", "share this article", "lorem ipsum")
MAX_LOST = 0.5


def holds_boilerplate(lower: Column) -> Column:
    hit = F.lit(False)
    for phrase in BOILERPLATE:
        hit = hit | lower.contains(phrase)
    return hit


def line_fails(line: Column, lower: Column) -> Column:
    """True when a line with a word (``lower``: in lower case) fails one of the line rules."""
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    return (line.rlike(NAV_LINE)
            | (F.regexp_count(line, F.lit(SYMBOLS)) > MAX_SYMBOL_SHARE * F.length(line))
            | ((capitals >= SHOUT_MIN_LETTERS * SHOUT_SHARE) & (letters >= SHOUT_MIN_LETTERS) & (capitals > SHOUT_SHARE * letters))
            | (~line.rlike(END_MARKS) & line.rlike(OPEN_LINE))
            | holds_boilerplate(lower))


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``clean_text`` (failed lines removed) and ``lost`` (share of characters removed, null for an empty text)."""
    d = docs.withColumn("__body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    judged = F.zip_with(F.split("__body", "\n", -1), F.split(F.lower("__body"), "\n", -1), lambda x, low: F.struct(
        x.alias("line"), (~x.rlike(A_WORD) | ~line_fails(x, low)).alias("stays")))
    kept = F.transform(F.filter(judged, lambda x: x["stays"]), lambda x: x["line"])
    d = d.withColumn("clean_text", F.array_join(kept, "\n"))
    whole, left = F.length("__body"), F.length("clean_text")
    return d.withColumn("lost", F.when(whole > 0, (whole - left) / whole)).drop("__body")


def repeat_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Words that lie in a five-word window found twice or more in the text.

    Window hashes are sorted; only texts in which two neighbours agree pay
    for the second step, which sorts (hash, position) and adds up the words
    that the repeated windows cover.
    """
    w = F.col(words)
    n = F.size(w) - (WINDOW - 1)
    hashes = F.when(n > 1, F.transform(F.slice(w, 1, n), lambda x, i: F.xxhash64(
        x, *[F.get(w, i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<long>"))
    d = docs.withColumn("__h", hashes)
    d = d.withColumn("__twice", F.size(F.col("__h")) > F.size(F.array_distinct("__h")))
    pairs = F.when(F.col("__twice"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("__s", pairs)
    size = F.size("__s")
    same = F.zip_with(F.slice("__s", 1, size - 1), F.slice("__s", 2, size - 1), lambda a, b: a["h"] == b["h"])
    d = d.withColumn("__same", F.when(F.col("__twice"), same))
    starts = F.transform(
        F.filter(F.zip_with("__s", F.zip_with(F.concat(F.array(F.lit(False)), "__same"),
                                              F.concat("__same", F.array(F.lit(False))), lambda a, b: a | b),
                            lambda s, hit: F.struct(s["i"].alias("i"), hit.alias("hit"))), lambda x: x["hit"]),
        lambda x: x["i"])
    d = d.withColumn("__at", F.when(F.col("__twice"), F.sort_array(starts)))
    m = F.size("__at")
    covered = F.aggregate(F.zip_with(F.slice("__at", 1, m - 1), F.slice("__at", 2, m - 1),
                                     lambda a, b: F.least(F.lit(WINDOW), b - a)),
                          F.lit(WINDOW), lambda s, x: s + x)
    d = d.withColumn(out, F.when(F.col("__twice"), covered).otherwise(0).cast("long"))
    return d.drop("__h", "__twice", "__s", "__same", "__at")


def quality(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Add the base figures, ``base_failed``, ``clean_text``, ``lost`` and ``kept`` to each document."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(A_WORD))
    d = docs.withColumn("__words", words_of(body)).withColumn("__lines", lines)
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    d = repeat_words(d, "__words", "n_repeat_words").drop("__words", "__lines")
    d = d.withColumn("base_failed", (F.col("n_words") < BASE_MIN_WORDS)
                     | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_MAX_REPEAT_PCT))
    d = clean_lines(d, text)
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("lost"), F.lit(1.0)) <= max_lost))


def accepted(judged: DataFrame) -> DataFrame:
    """The rows of ``quality`` that are kept.

    The row number keeps the filter above the projections; pushed through
    them, every array would be computed anew inside the functions that walk it.
    """
    return judged.withColumn("__n", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("__n") >= 0)).drop("__n")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def document_quality(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The digest table: base figures and verdict for every document."""
    return quality(docs.select("doc_id", "text"), max_lost=max_lost).select(*RESULT)
