"""Words and five-word shingles as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
#: Fixed value: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Lower-cased words between runs of ASCII white space; null and blank texts give an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(split_words(text))


def split_words(text: Column) -> Column:
    """``words`` of texts that have some."""
    return F.split(F.lower(F.btrim(text, F.lit(SPACE))), "[ \\t\\n\\x0B\\f\\r]+")


def line_words(lines: DataFrame, line: str = "line", out: str = "w") -> DataFrame:
    """``lines`` with the column ``line``, which must hold a word, replaced by its ``split_words``.

    Nearly all lines have single blanks alone between their words, and these are split without a regular expression.
    """
    w = lines.withColumn("__w", F.split(F.lower(line), " "))
    odd = F.array_contains("__w", "")
    for c in SPACE[1:]:
        odd = odd | F.contains(F.col(line), F.lit(c))
    keep = [c for c in lines.columns if c != line]
    return w.select(*keep, F.when(odd, split_words(F.col(line))).otherwise(F.col("__w")).alias(out))


def shingles(w: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` words, in order; fewer words count as one run, no words as none."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
    return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def shingle_rows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each run of ``width`` words of the column w, with its hash h in place of w; fewer words count as one run.

    ``w`` must hold a word. Runs become rows and not arrays, as compiled code hashes them without a copy of their words.
    """
    keep = [c for c in rows.columns if c != "w"]
    at = rows.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("__i"))
    return at.select(*keep, F.xxhash64(*(F.get("w", F.col("__i") + j) for j in range(width))).alias("h"))
