"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Everything is a column expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A line fails the navigation rule where more than this share of its characters are symbols, in percent.
MAX_SYMBOL_PCT = 10
#: Phrases of site furniture; the rule only holds for lines up to this many characters.
BOILERPLATE = (r"cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|licensed under|"
               r"released under|subscribe|sign up|log ?in|click here|read more|skip to|lorem ipsum")
BOILERPLATE_CHARS = 200
#: Menus and bread crumbs: a line with so many separators fails.
SEPARATORS = "|›»→"
MAX_SEPARATORS = 2
#: What may end a sentence, with closing quotes and brackets after it.
ENDING = r"""[.!?…:;,][\x22'”’»)\]]*[\x20\x09-\x0D]*$"""
#: A document needs so many percent of its characters in lines that pass.
MIN_KEPT_PCT = 50


def _stripped(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def line_passes(line: Column) -> Column:
    """Whether a line with a word ends like a sentence and is neither navigation nor boilerplate."""
    symbols = F.length(line) - F.length(_stripped(line, SYMBOLS))
    separators = F.length(line) - F.length(_stripped(line, SEPARATORS))
    return (line.rlike(ENDING) & (separators <= MAX_SEPARATORS) & (symbols * 100 <= F.length(line) * MAX_SYMBOL_PCT)
            & ~((F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE)))


def window_hashes(words: Column, n_words: Column) -> Column:
    """64-bit hashes of all 3-word windows, in order."""
    return F.when(n_words >= 3, F.transform(F.sequence(F.lit(0), n_words - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned_text.

    A null text has no words and fails. A line is a piece between \\n; lines without a word are dropped from
    cleaned_text and count for nothing. Repeated rows are judged each; columns named like the new ones are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned_text"]
    t = F.coalesce(F.col(text), F.lit(""))
    at = docs.withColumn("_text", t).drop(*[c for c in new if c != text])
    at = at.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    at = at.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    at = at.withColumn("_n", F.size("_words"))
    at = at.withColumn("_hashes", window_hashes(F.col("_words"), F.col("_n"))).drop("_words")
    # most texts repeat no window: a hash set tells that without a sort
    at = at.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")  # equal hashes are neighbours
    at = at.withColumn("_at", F.sort_array(F.transform(
        F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True)),
        lambda x: x["i"])))
    p = F.col("_at")  # where repeated windows start; each covers three words, or as many as reach the next
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                          F.lit(0), lambda a, b: a + b)
    at = at.withColumn("_good", F.filter("_lines", line_passes))
    at = at.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(_stripped(F.col("_text"), SPACES)).cast("long"),
        "n_symbols": (F.length("_text") - F.length(_stripped(F.col("_text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "cleaned_text": F.array_join("_good", "\n"),
        "_all": F.length(F.array_join("_lines", "\n"))})
    at = at.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    at = at.withColumn("kept", ~F.col("base_failed") & (F.length("cleaned_text") * 100 >= F.col("_all") * MIN_KEPT_PCT))
    keep = [c for c in docs.columns if c not in new]
    return at.select(*keep, *new)
