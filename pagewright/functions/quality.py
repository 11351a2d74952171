"""Scores of text quality and of conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .legacy import is_legacy_font
from .text import DEVANAGARI, is_blank, n_of, n_visible, share, stripped

GARBAGE = r"(?i)undefined|nan|\[object"
SYMBOLS = r"|=\[\]{}<>^~`\\"


def _dominance(c: Column) -> Column:
    """The share of the commonest Devanagari character among all of them; 0 with fewer than five."""
    only = F.regexp_replace(c, f"[^{DEVANAGARI}]+", "")
    distinct = F.array_distinct(F.regexp_extract_all(only, F.lit(f"[{DEVANAGARI}]"), F.lit(0)))
    most = F.array_max(F.transform(distinct, lambda x: F.length(only) - F.length(F.replace(only, x, F.lit("")))))
    return F.when(F.length(only) >= 5, most / F.length(only)).otherwise(F.lit(0.0))


def penalty(c: Column) -> Column:
    visible = n_visible(c)
    deva, latin = share(n_of(c, DEVANAGARI), visible), share(n_of(c, "A-Za-z"), visible)
    return (
        F.when(c.rlike(GARBAGE), 40.0).otherwise(0.0)
        + F.least(F.lit(30.0), 2.0 * n_of(c, SYMBOLS))
        + 8.0 * F.regexp_count(c, F.lit(f"[{DEVANAGARI}]{{22,}}"))
        + F.when(_dominance(c) > 0.18, 25.0).otherwise(0.0)
        + F.when((latin > 0.20) & (deva < 0.40), 25.0).otherwise(0.0)
    )


def score(c: Column) -> Column:
    """Devanagari per cent less the penalty, not under 0; blank text scores 0. Not rounded."""
    return F.when(is_blank(c), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 * share(n_of(c, DEVANAGARI), n_visible(c)) - penalty(c)))


def label(c: Column) -> Column:
    deva, p = share(n_of(c, DEVANAGARI), n_visible(c)), penalty(c)
    return F.when(is_blank(c), "empty").when((deva >= 0.45) & (p < 10), "excellent").when((deva >= 0.25) & (p < 20), "good").when(deva >= 0.10, "partial").otherwise("poor")


def conversion_label(original: Column, converted: Column, font: Column) -> Column:
    """good, garbage, length_mismatch or low_devanagari."""
    before, after = F.length(stripped(original)), F.length(stripped(converted))
    deva = share(n_of(converted, DEVANAGARI), n_visible(converted))
    length_ok = (before == 0) | ((after >= 0.5 * before) & (after <= 2.0 * before))
    return F.when(converted.rlike(GARBAGE), "garbage").when(~length_ok, "length_mismatch").when(is_legacy_font(font) & (deva < 0.15) & (before > 20), "low_devanagari").otherwise("good")


def accepted_conversion(original: Column, converted: Column) -> Column:
    """The conversion if it scores 2 more than the original or a quarter of it is Devanagari, else the original."""
    better = (score(converted) >= score(original) + 2.0) | (share(n_of(converted, DEVANAGARI), n_visible(converted)) >= 0.25)
    return F.when(better, converted).otherwise(original)


def ocr_score(text: Column, mean_confidence: Column, words: Column) -> Column:
    """Confidence by how many words there are, up to 80, and up to a fifth more for Devanagari; -1 for blank text."""
    deva = share(F.length(F.regexp_replace(text, rf"[^\p{{L}}]|[^{DEVANAGARI}]", "")), n_of(text, r"\p{L}"))
    base = mean_confidence * F.least(words, F.lit(80)) / 80.0
    return F.when(is_blank(text), -1.0).when(deva >= 0.25, base * (1 + 0.25 * F.least(deva, F.lit(0.8)))).otherwise(base)


def engine_score(text: Column) -> Column:
    """What an engine's text is worth: Devanagari, quality, length and words, less 20 for garbage."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    deva = share(n_of(text, DEVANAGARI), n_visible(text))
    total = 40.0 * deva + 0.2 * score(text) + F.least(F.lit(30.0), F.length(text) / 100) + F.least(F.lit(20.0), words / 10) - F.when(text.rlike(GARBAGE), 20.0).otherwise(0.0)
    return F.when(is_blank(text), 0.0).otherwise(total)


def repair_score(confidence: Column, quality: Column, words: Column, deva: Column) -> Column:
    """Weighs an extraction attempt: confidence, Unicode quality, words up to 500 and Devanagari."""
    return 0.35 * confidence + 0.30 * quality + 0.15 * F.least(F.lit(100.0), words / 5) + 0.20 * deva


def dpi_for_pages(pages: Column) -> Column:
    return F.when(pages > 200, 350).when(pages > 100, 380).otherwise(400)


def image_file_dpi(pages: Column) -> Column:
    """The resolution of pages in a file of images: lower from 51 and from 151 pages."""
    return F.when(pages > 150, 350).when(pages > 50, 380).otherwise(400)


def image_quality(skew: Column, noise: Column, bleed: Column, shadows: Column, adequate: Column) -> Column:
    """100 less what tilt, noise, bleed-through, shadows and low resolution cost, each up to a bound."""
    cost = lambda x, k, most: F.least(F.lit(most), x * k)
    return F.greatest(F.lit(0.0), 100.0 - cost(F.abs(skew), 3.0, 25.0) - cost(noise, 0.35, 30.0) - cost(bleed, 0.2, 20.0) - cost(shadows, 0.2, 20.0) - F.when(adequate, 0.0).otherwise(15.0))


def image_tier(score: Column) -> Column:
    return F.when(score >= 80, "clean").when(score >= 60, "moderate").when(score >= 40, "noisy").otherwise("poor")


def denoise_level(noise: Column, bleed: Column) -> Column:
    both = noise + bleed * 0.5
    return F.when(both > 60, "strong").when(both > 30, "medium").otherwise("light")


def good_enough(text: Column, mean_confidence: Column, words: Column) -> Column:
    return (mean_confidence >= 85) & (words >= 2) & ~is_blank(text)


def ocr_language(lang: Column, has_nep: bool = True, has_eng: bool = True) -> Column:
    """The language a recogniser is asked for; auto and nep take English along where it is installed."""
    auto = "nep+eng" if has_nep and has_eng else "nep" if has_nep else "eng"
    return F.when(lang == "auto", auto).when((lang == "nep") & F.lit(has_nep and has_eng), "nep+eng").otherwise(lang)


def page_confidence(text: Column, conversion: Column) -> Column:
    """A page's confidence: its score from 50 up, else 70 for a good conversion, else at least 30; 0 without text."""
    s = score(text)
    return F.when(is_blank(text), 0.0).when(s >= 75, F.least(F.lit(100.0), s)).when(s >= 50, s).when(conversion == "good", 70.0).otherwise(F.greatest(F.lit(30.0), s))
