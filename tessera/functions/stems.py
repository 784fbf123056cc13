"""Stems of German and English words by the published Snowball rules, over a table of distinct words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Endings of the published rules, longest first in each step.
EN_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
EN_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
EN_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
EN_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def regions(word: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant that follows a vowel, and again behind that."""
    pattern = re.compile(f"[{vowels}][^{vowels}]")
    one = pattern.search(word)
    r1 = one.end() if one else len(word)
    two = pattern.search(word, r1)
    return r1, two.end() if two else len(word)


def ending(word: str, choices) -> str:
    """The longest of ``choices`` that ends the word."""
    return max((x for x in choices if word.endswith(x)), key=len, default="")


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_SPECIAL:
        return EN_SPECIAL[word]
    v = "aeiouy"
    w = re.sub(rf"(?:^|(?<=[{v}]))y", "Y", word.lstrip("'"))
    r1, r2 = regions(w, v)
    special = re.match("gener|commun|arsen", w)
    if special:
        r1 = special.end()
        r2 = r1 + regions(w[r1:], v)[0]
    short = lambda s: bool(re.search(rf"(?:[^{v}][{v}][^{v}wxY]|^[{v}][^{v}])$", s))
    w = re.sub("'s?'?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{v}].", w[:-1]):
        w = w[:-1]
    if w in EN_KEPT:
        return w
    end = ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(f"[{v}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    end = ending(w, EN_STEP2)
    if end and len(w) - len(end) >= r1 and not (end == "ogi" and w[-4:-3] != "l") and not (end == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + EN_STEP2[end]
    end = ending(w, EN_STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + EN_STEP3[end]
    end = ending(w, EN_STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = re.sub(rf"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    r1, r2 = regions(w, v)
    r1 = max(r1, 3)
    inside = lambda end, at: len(w) - len(end) >= at
    end = ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and inside(end, r1) and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = ending(w, ("en", "er", "est", "st"))
    if end and inside(end, r1) and (end != "st" or (len(w) >= 6 and w[-3] in "bdfghklmnt")):
        w = w[: -len(end)]
    end = ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and inside(end, r2):
        before = w[: -len(end)]
        if end in ("end", "ung"):
            w = before[:-2] if before.endswith("ig") and not before.endswith("eig") and len(before) - 2 >= r2 else before
        elif end in ("ig", "ik", "isch"):
            w = w if before.endswith("e") else before
        elif end in ("lich", "heit"):
            w = before[:-2] if before.endswith(("er", "en")) and len(before) - 2 >= r1 else before
        else:
            tail = ending(before, ("lich", "ig"))
            w = before[: -len(tail)] if tail and len(before) - len(tail) >= r2 else before
    return w.lower().translate(str.maketrans("äöü", "aou"))


def stem(lang: str, word: str) -> str:
    """German by the German rules, all other languages by the English ones."""
    return (german if lang == "de" else english)(word)


def stem_vocab(words: DataFrame) -> DataFrame:
    """(lang, word) -> (lang, word, stem): German by the German rules, all other languages by the English ones.

    Meant for distinct words, of which there are few beside texts.
    """

    def work(batches):
        for b in batches:
            stems = [stem(lang, w) if w is not None else None for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stems, pa.string())], names=["lang", "word", "stem"])

    return words.select("lang", "word").mapInArrow(work, "lang string, word string, stem string")
