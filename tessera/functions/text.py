"""Text expressions: tokens, compound parts, counts, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of a search token.
TOKEN = r"[a-zäöüßA-ZÄÖÜ0-9]+(?:-[a-zäöüßA-ZÄÖÜ0-9]+)*"
#: Linking morphemes of German compounds, in the order in which they are tried.
LINKERS = ("ens", "es", "en", "er", "s", "e")
MIN_PART = 3


def tokens(text: Column) -> Column:
    """Lower-cased search tokens of a text; null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def compound_parts(word: Column) -> Column:
    """The word, and for each split point the right part, or both parts where a linker stands between them."""
    n = F.length(word)

    def at(i: Column) -> Column:
        right = F.substring(word, i + 1, n)
        out = F.array(right)
        for link in reversed(LINKERS):
            k = len(link)
            out = F.when(F.startswith(right, F.lit(link)) & (n - i - k >= MIN_PART), F.array(F.substring(word, F.lit(1), i), F.substring(word, i + 1 + k, n))).otherwise(out)
        return out

    points = F.filter(F.sequence(F.lit(0), F.greatest(n - MIN_PART, F.lit(0))), lambda i: i >= MIN_PART)
    return F.concat(F.array(word), F.flatten(F.transform(points, at)))


def word_count(text: Column) -> Column:
    """Words between white space: the count that stands in for a model's tokenizer."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def visible(text: Column) -> Column:
    """Whether ``strip`` leaves anything; no more is read than up to the first such character."""
    return text.rlike(r"(?U)\S")


def squeezed(text: Column) -> Column:
    """Lower-cased without any white space: the form in which quotes are looked for."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out
