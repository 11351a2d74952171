"""Counts, ratios and clean-up of text columns, in expressions of the engine.

White space is what Unicode calls so, and the four separators U+001C to U+001F.
A null stays null unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEVANAGARI = "ऀ-ॿ"
DEVANAGARI_DIGIT = "०-९"
CONSONANT = "क-ह"
MATRA = "ा-ौ"
HALANT = "्"
PRIVATE = "\ue000-\uf8ff"
SPACE = r"\s\x1c-\x1f"
# Replacement characters and boxes that stand for lost glyphs, and the private use area.
CORRUPTION = "\ufffd\ufffe\uffff\u25a1\u25a0\u25ab\u25aa\u25fb\u25fc\u2610\u2611\u2612\u25af\u25a2\u25fb\u25fc\u2b1c\u2b1b" + PRIVATE


def n_of(c: Column, characters: str) -> Column:
    """How many of c's characters are in the class."""
    return F.length(F.regexp_replace(c, f"[^{characters}]+", ""))


def n_visible(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(c, f"(?U)[{SPACE}]+", ""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(c: Column) -> Column:
    """True for null too."""
    return F.coalesce(~c.rlike(rf"(?U)[^{SPACE}]"), F.lit(True))


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 of nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def devanagari_ratio(c: Column) -> Column:
    return share(n_of(c, DEVANAGARI), n_visible(c))


def ascii_ratio(c: Column) -> Column:
    return share(n_of(c, "A-Za-z"), n_visible(c))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode's composed form; the engine has no function for it, so batches of strings go to Python."""
    return _nfc(c)


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def tidy(c: Column) -> Column:
    """Private use characters out, runs of spaces and tabs to one space, more than two line ends to two, trimmed."""
    c = F.regexp_replace(unix_lines(c), f"[{PRIVATE}]", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return stripped(F.regexp_replace(c, "\n{3,}", "\n\n"))


def ocr_lines(c: Column) -> Column:
    """Zero-width characters out and each line's spaces to one; tabs part columns and stay."""
    c = unix_lines(F.regexp_replace(c, "[\u200b\u200c\u200d\ufeff]", ""))
    squeezed = lambda x: stripped(F.regexp_replace(x, rf"(?U)[{SPACE}&&[^\n]]+", " "))
    line = lambda x: F.array_join(F.transform(F.split(x, "\t"), squeezed), "\t")
    return stripped(F.array_join(F.transform(F.split(c, "\n"), line), "\n"))


def ocr_content(c: Column) -> Column:
    """ocr_lines, with a Devanagari number joined to the mark after it and single spaces in amounts."""
    c = F.regexp_replace(ocr_lines(c), rf"(?U)([{DEVANAGARI_DIGIT}]+)[{SPACE}]+([.)])", "$1$2")
    return F.regexp_replace(c, rf"(?iU)(Rs\.?|NPR|रु\.?|रू\.?|USD|\$)[{SPACE}&&[^\n]]+(?=[\d,{DEVANAGARI_DIGIT}])", "$1 ")


def clean_cell(c: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U)[{SPACE}]+", " "))


def masked_numbers(c: Column) -> Column:
    """Numbers as "#", single spaces: how a running line is compared."""
    c = F.regexp_replace(stripped(c), rf"(?U)\d+", "#")
    return stripped(F.regexp_replace(c, f"(?U)[{SPACE}]+", " "))


def script(c: Column) -> Column:
    """nepali, english, mixed, numeric or unknown, by the shares of letters and digits."""
    deva, latin = n_of(c, DEVANAGARI), n_of(c, "A-Za-z")
    # Devanagari digits count as letters and as digits.
    digits = F.length(F.regexp_replace(c, r"(?U)[^\p{Nd}²³¹⁰-⁹₀-₉]+", ""))
    total = deva + latin + digits
    return (
        F.when(is_blank(c) | (total == 0), "unknown")
        .when(deva / total > 0.55, "nepali")
        .when(latin / total > 0.55, "english")
        .when((deva > 0) & (latin > 0), "mixed")
        .when(digits / total > 0.5, "numeric")
        .otherwise("mixed")
    )


def character_kind(c: Column) -> Column:
    """nep, eng, numeric, other, or null for white space, of a single character."""
    return F.when(c.rlike(f"[{DEVANAGARI}]"), "nep").when(c.rlike("[A-Za-z]"), "eng").when(c.rlike(r"(?U)\p{Nd}"), "numeric").when(~is_blank(c), "other")


def corruption_score(c: Column) -> Column:
    """Lost glyphs for every twenty characters, at most 1."""
    n = n_of(c, CORRUPTION)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n / F.greatest(F.length(c) / 20, F.lit(1.0))))


def character_error_rate(hypothesis: Column, reference: Column) -> Column:
    """Edit distance for each character of the reference; of an empty one 0 against nothing, else 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(hypothesis, reference) / F.length(reference))


def display_width(c: Column) -> Column:
    """Columns of a terminal: two for a Devanagari character."""
    return F.length(c) + n_of(c, DEVANAGARI)


def attachment_disposition(filename: Column) -> Column:
    """A Content-Disposition header whose plain name is ASCII and whose second one is percent-encoded UTF-8."""
    ext = F.when(filename.rlike(r"[^.].*\.[^./]*\z"), F.regexp_extract(filename, r"(\.[^./]*)\z", 1)).otherwise("")
    stem = F.substring(filename, F.lit(1), F.length(filename) - F.length(ext))
    plain = F.trim(F.regexp_replace(stem, r"[^\x00-\x7f]", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9._\- ]", "_"), r"\A[._\- ]+|[._\- ]+\z", "")
    plain = F.when(plain == "", "document").otherwise(plain)
    quoted = F.replace(F.replace(F.url_encode(filename), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit('attachment; filename="'), plain, ext, F.lit("\"; filename*=UTF-8''"), quoted)
