"""Devanagari: validation of sequences, grammar issues and repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONSONANT, CORRUPTION, DEVANAGARI, HALANT, MATRA, SPACE, n_of, stripped

VOWEL = "ऄ-औ"
NUKTA = "़"
MARKS = "ँ-ः"
# Consonants that take a nukta.
NUKTA_BASES = "कखगजडढफय"
# For each consonant, those that commonly follow it after a halant.
CONJUNCTS = {
    "क": "षरतल", "ख": "र", "ग": "रधन", "घ": "र", "ङ": "कगख", "च": "छर", "ज": "ञर", "ञ": "चज", "ट": "र", "ड": "र", "ण": "डण", "त": "तरनमव", "थ": "र",
    "द": "धदरवमय", "ध": "रय", "न": "तदधनमरय", "प": "रत", "ब": "रद", "भ": "र", "म": "रल", "य": "र", "र": "कखगतथदधनपबभमयलवशषसह", "ल": "लकप", "व": "र",
    "श": "रचवन", "ष": "टठण", "स": "तथनरवमल", "ह": "रनमलव",
}


def once(c: Column) -> Column:
    """Repeated vowel signs and nasal marks once."""
    return F.regexp_replace(c, f"([{MATRA}{MARKS}])\\1+", "$1")


def without_orphans(c: Column) -> Column:
    """Without the vowel signs and halants that no consonant, nukta, sign or halant stands before."""
    return F.regexp_replace(c, f"(?<![{CONSONANT}{NUKTA}{MATRA}{HALANT}])[{MATRA}{HALANT}]", "")


def redistributed(c: Column) -> Column:
    """Two vowel signs behind two consonants: one behind each."""
    c = F.regexp_replace(c, f"([{CONSONANT}])([{CONSONANT}])ेा([{CONSONANT}])", "$1े$2ा$3")
    return F.regexp_replace(c, f"([{CONSONANT}])([{CONSONANT}])([{MATRA}])([{MATRA}])", "$1$3$2$4")


def tidy_halants(c: Column) -> Column:
    """No halant before white space or at the end, and one where there are several."""
    c = F.regexp_replace(c, rf"(?U){HALANT}([{SPACE}])", "$1")
    return F.regexp_replace(F.regexp_replace(c, rf"{HALANT}(?=\n?\z)", ""), f"{HALANT}{{2,}}", HALANT)


def repaired(c: Column) -> Column:
    """All repairs, of text in composed form."""
    return tidy_halants(redistributed(without_orphans(once(c))))


def _bigrams(c: Column) -> Column:
    """(place from 0, character before or "", character) of a string."""
    n = F.length(c)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.when(i > 0, F.substring(c, i, F.lit(1))).otherwise("").alias("before"), F.substring(c, i + 1, F.lit(1)).alias("char")))


def n_sequence_errors(c: Column) -> Column:
    """Devanagari characters that can't follow the one before, and signs at the start or behind other scripts; both may count for one place."""
    sign = f"[{MATRA}{HALANT}]"
    invalid = (
        F.regexp_count(c, F.lit(f"(?<=[{DEVANAGARI}&&[^{CONSONANT}{NUKTA}{HALANT}{MATRA}]])[{MATRA}]"))
        + F.regexp_count(c, F.lit(f"(?<=[{DEVANAGARI}&&[^{CONSONANT}{NUKTA}]]){HALANT}"))
        + F.regexp_count(c, F.lit(f"(?<=([{MATRA}]))\\1"))
    )
    orphan = F.regexp_count(c, F.lit(f"(?<![{DEVANAGARI}]){sign}"))
    return invalid + orphan


def sequence_confidence(c: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 5 * n_sequence_errors(c))


def n_grammar_errors(c: Column) -> Column:
    """Orphan signs and halants, wrong nuktas, adjacent vowels, signs behind vowels or equal signs, halants behind signs; a place may break several rules."""
    rules = (
        f"(?<![{CONSONANT}{NUKTA}{HALANT}{MATRA}])[{MATRA}]",
        f"(?<![{CONSONANT}{NUKTA}]){HALANT}",
        f"(?<![{NUKTA_BASES}]){NUKTA}",
        f"(?<=[{VOWEL}])[{VOWEL}]",
        f"(?<=[{VOWEL}])[{MATRA}]",
        f"(?<=([{MATRA}]))\\1",
        f"(?<=[{MATRA}]){HALANT}",
    )
    total = F.lit(0)
    for r in rules:
        total = total + F.regexp_count(c, F.lit(r))
    return total


def n_uncommon_conjuncts(c: Column) -> Column:
    common = "|".join(f"{a}{HALANT}(?=[{b}])" for a, b in CONJUNCTS.items())
    return F.regexp_count(c, F.lit(f"(?<=[{CONSONANT}]){HALANT}(?=[{CONSONANT}])")) - F.regexp_count(c, F.lit(common))


def word_likelihood(c: Column) -> Column:
    """0 to 100: how likely a string is a word of Nepali."""
    deva = n_of(c, DEVANAGARI)
    total = 100 - 15 * n_grammar_errors(c) - 5 * n_uncommon_conjuncts(c) - F.when(deva / F.length(c) < 0.7, 20).otherwise(0) - F.when(F.length(c) > 20, 10).otherwise(0)
    total = F.when(c.rlike(f"\\A[{CONSONANT}{VOWEL}]\\z"), F.least(total, F.lit(80))).otherwise(total)
    return F.when(deva == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))


def grammar_repaired(c: Column, rounds: int = 5) -> Column:
    """Five rewrites, repeated: signs at a word's start, repeated signs, halants behind signs, several halants, halants at a word's end."""
    for _ in range(rounds):
        c = F.regexp_replace(c, rf"(?U)\A[{SPACE}]?[{MATRA}{HALANT}]", "")
        c = F.regexp_replace(c, rf"(?U)[{SPACE}][{MATRA}{HALANT}]", " ")
        c = F.regexp_replace(c, f"([{MATRA}])\\1+", "$1")
        c = F.regexp_replace(c, f"([{MATRA}]){HALANT}", "$1")
        c = F.regexp_replace(c, f"{HALANT}{{2,}}", HALANT)
        c = F.regexp_replace(c, rf"(?U){HALANT}(?=[{SPACE}]|\z)", "")
    return c


def character_properties(c: Column) -> Column:
    """Eleven yes-or-no properties of a single character."""
    names = {
        "is_devanagari": f"[{DEVANAGARI}]", "is_consonant": f"[{CONSONANT}]", "is_vowel": f"[{VOWEL}]", "is_matra": f"[{MATRA}{HALANT}]", "is_halant": HALANT, "is_anusvara": "ं",
        "is_chandrabindu": "ँ", "is_visarga": "ः", "is_nukta": NUKTA, "is_digit": "[०-९]", "is_prebase_matra": "ि",
    }
    return F.struct(*(c.rlike(p).alias(n) for n, p in names.items()))


def skeleton(c: Column) -> Column:
    """The consonants only."""
    return F.regexp_replace(c, f"[^{CONSONANT}]", "")


def loose_skeleton(c: Column) -> Column:
    """Devanagari without vowel signs, halants, anusvara and visarga."""
    return F.regexp_replace(c, f"[ा-ॏॢॣंः]|[^{DEVANAGARI}]", "")


# Words between clauses, and words that tell of law and of questions.
CONJUNCTION_WORDS = ("ra", "र", "tara", "तर", "bhane", "भने", "ki", "कि", "ani", "अनि")
LEGAL_WORDS = ("नियमवाली", "नियमावली", "ऐन", "दफा", "राजपत्र", "संशोधन", "प्रावधान", "आयकर", "गजेट")
QUESTION = r"(?U)के\s*हो|कति|कसरी|किन|\?"


def clauses(c: Column) -> Column:
    """Parts between sentence ends or conjunctions, of three characters or more."""
    flat = stripped(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U)[{SPACE}]+", " "))
    parts = F.split(flat, r"(?i)(?<=[।.;])\s+|\s+(?:" + "|".join(CONJUNCTION_WORDS) + r")\s+")
    return F.filter(F.transform(parts, stripped), lambda x: F.length(x) >= 3)


def clause_domain(c: Column) -> Column:
    return F.when(c.rlike("|".join(LEGAL_WORDS)), "legal").otherwise("general")


def is_question(c: Column) -> Column:
    return c.rlike(QUESTION)


# Damaged phrases and what they should be.
CONTEXTS = (
    (r"(पेट्रोलियम\s+उद्योग\s*\(\s*आयकर\s*\))[^,，]{0,20}[,，]\s*(२०\d{2})", "$1 नियमवाली, $2"),
    (r"(नेपाल)\s+(?:[^ऀ-ॿ।]*[ऀ-ॿ]{0,4})?पत्र(मा\s+प्रकाशित)", "$1 राजपत्र$2"),
    (r"(प्रकाशित)\s+(?:[^ऀ-ॿ।]*[ऀ-ॿ]{0,4})?ति\s*[:：]", "$1 मिति :"),
    (r"(संक्षिप्त)\s+(?:[^ऀ-ॿ।]*[ऀ-ॿ]{0,4})?(?:र\s+प्रारम्भ)", "$1 नाम र प्रारम्भ"),
)


def in_context(c: Column) -> Column:
    for pattern, becomes in CONTEXTS:
        c = F.regexp_replace(c, "(?U)" + pattern, becomes)
    return c


def without_lost_glyphs(c: Column) -> Column:
    return F.regexp_replace(c, f"[{CORRUPTION}]", "")


def document_kind(c: Column) -> Column:
    """One of four kinds, by the first 500 characters; the kinds are defined on a text's beginning."""
    head = F.substring(c, 1, 500)
    return (
        F.when(head.rlike("ऐन|नियमावली|नियमहरू|विनियमावली"), "Nepali law / government act")
        .when(head.rlike("कार्यविधि|निर्देशिका|मार्गदर्शन"), "Nepali government procedure")
        .when(head.rlike("पाठ्यक्रम|पाठ्यपुस्तक|अध्याय"), "Nepali educational content")
        .otherwise("general Nepali document")
    )


