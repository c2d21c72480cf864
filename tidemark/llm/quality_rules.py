"""Line-first cleaning: rules per line remove it, then documents that lost too much text are rejected.

A line fails as punctuation (a tenth of it is symbols, it has no letter or digit, ends in a ruled line, or shouts after word upon word), as
navigation (short items between bars or arrows) or as boilerplate (licence, copyright, cookie and sign-up phrases). Lines without a word are neither kept
nor counted as lost.

Edge cases. Null or empty text: no words, base_failed, not kept, cleaned to "". Very long texts are measured whole; all steps are
linear or n log n in the words of one text. Repeated rows, null ids and other columns pass through, columns whose names begin with
`__` with `in_` before them. Equal
3-word windows are told by 64 bits of hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, apart, let, pack_words, whole

SYMBOLS = "#*$%&|<>"
SHOUTS = r"(?:[!?.*#$%&]{2}[\x20\x09]+[^\x20\x09-\x0D]+[\x20\x09]*){4}"
RULE_ENDS = r"^[#*$%&|<>=_~^-]{4}\z"
SEPARATORS = "[|>»·•]"
ITEM_CHARS = 40
# Phrases of boilerplate lines.
BOILERPLATE = ("all rights reserved", "licensed under", "privacy policy", "terms of service", "terms of use", "cookie policy", "accept cookies", "sign up", "subscribe to", "click here", "copyright (c)", "javascript is disabled")
MIN_KEPT_PERCENT = 50
"""Documents keep at least this share of the characters of their lines."""


def window_hashes(words: Column) -> Column:
    """A hash for each 3-word window, in order."""
    return F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _repeated(sorted_: Column) -> Column:
    """Indexes, ascending, of windows that occur more than once; sorted_: hashes with indexes."""
    same = lambda i, j: F.get(sorted_, i)["h"] == F.get(sorted_, j)["h"]
    both = F.filter(sorted_, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    return F.sort_array(F.transform(both, lambda x: x["i"]))


def measure(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """docs with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __base_failed, __cleaned and __kept."""
    text = whole(F.col(text_col))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    df = apart(docs).withColumns({"__words": pack_words(text), "__lines": lines})
    df = df.withColumns(
        {
            "__n_words": F.size("__words").cast("long"),
            "__word_chars": F.char_length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"),
            "__n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": let(F.col("__words"), window_hashes),
        }
    )
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    df = df.withColumn("__sorted", F.when(repeats, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__at", F.when(F.col("__sorted").isNotNull(), let(F.col("__sorted"), _repeated)))
    covered = F.aggregate("__at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    df = df.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("__n_words") < min_words) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * max_repeat_percent)
    df = df.withColumns({"__base_failed": failed, "__good": F.filter("__lines", lambda x: ~fails(x))})
    size = lambda c: F.char_length(F.array_join(c, ""))
    enough = size("__good").cast("long") * 100 >= size("__lines").cast("long") * min_kept_percent
    df = df.withColumns({"__cleaned": F.array_join("__good", "\n"), "__kept": ~F.col("__base_failed") & enough})
    return df.drop("__words", "__lines", "__windows", "__sorted", "__at", "__good")


def fails(line: Column) -> Column:
    """Whether a line fails the punctuation, navigation or boilerplate rule. All patterns are linear in the line."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    symbols = F.char_length(line) - F.char_length(F.regexp_replace(line, "[#*$%&|<>]+", ""))
    marks = (symbols * 10 > F.char_length(line)) | ~line.rlike(r"[\p{L}\p{N}]") | F.right(bare, F.lit(4)).rlike(RULE_ENDS) | line.rlike(SHOUTS)
    separators = F.char_length(line) - F.char_length(F.regexp_replace(line, SEPARATORS, ""))
    navigation = (separators >= 3) & (F.char_length(line) <= (separators + 1) * ITEM_CHARS)
    return marks | navigation | line.rlike("(?i)" + "|".join(p.replace("(", "\\(").replace(")", "\\)") for p in BOILERPLATE))
