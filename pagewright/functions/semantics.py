"""Checks of amounts, dates, shares, references, languages and numbers in a text, as arrays of issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DEVANAGARI, n_of, n_visible, share, stripped

# Patterns of amounts, dates, percentages, sections and mixed numbers, and what excuses a large percentage.
AMOUNT = r"(?:रु\.?|Rs\.?|NRs\.?)\s*([\d,]+(?:\.\d+)?)"
DATE = r"(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})"
PERCENTAGE = r"([\d.]+)\s*(?:%|प्रतिशत)"
SECTION, DEFINED = r"दफा\s*([\d०-९]+)", r"दफा\s*([\d०-९]+)\s*[.:]"
MIXED_DIGITS = r"[०-९]+[0-9]+|[0-9]+[०-९]+"
MORE_THAN, LOOK_BACK = "से अधिक", 20


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _issues(severity: str, category: str, found: Column) -> Column:
    """An issue for each of the strings."""
    return F.transform(found, lambda x: F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), x.cast("string").alias("found")))


def large_amounts(c: Column, most: float = 1e15) -> Column:
    return _issues("warning", "amount", F.filter(_all(c, AMOUNT), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double") > most))


def wrong_dates(c: Column) -> Column:
    """Months and days that can't be, of years from 2000 to 2120; a date may give both."""
    part = lambda d, i: F.element_at(F.split(d, r"[./\-]"), i).cast("int")
    near = F.filter(_all(c, DATE, 0), lambda d: part(d, 1).between(2000, 2120))
    month = F.transform(F.filter(near, lambda d: ~part(d, 2).between(1, 12)), lambda d: F.concat(F.lit("month "), d))
    day = F.transform(F.filter(near, lambda d: ~part(d, 3).between(1, 32)), lambda d: F.concat(F.lit("day "), d))
    return _issues("error", "date", F.concat(month, day))


def large_shares(c: Column) -> Column:
    """Percentages over 100 without MORE_THAN in the LOOK_BACK characters of the text before."""
    between = F.split(c, PERCENTAGE, -1)
    matches = F.transform(_all(c, PERCENTAGE, 0), lambda m, i: F.struct(F.get(between, i).alias("between"), m.alias("match")))
    start = F.expr("cast(named_struct('before', '', 'found', array()) as struct<before:string,found:array<string>>)")
    last = lambda x: F.right(x, F.lit(LOOK_BACK))

    def step(acc, m):
        before = last(F.concat(acc["before"], m["between"]))
        value = F.regexp_extract(m["match"], r"^[\d.]+", 0)
        large = F.coalesce(value.try_cast("double") > 100, F.lit(False)) & ~before.contains(MORE_THAN)
        return F.struct(last(F.concat(before, m["match"])).alias("before"), F.when(large, F.concat(acc["found"], F.array(value))).otherwise(acc["found"]).alias("found"))

    # Texts without a mark of a percentage have none.
    found = F.when(c.rlike("%|प्रतिशत"), F.aggregate(matches, start, step)["found"]).otherwise(F.array().cast("array<string>"))
    return _issues("warning", "amount", found)


def missing_sections(c: Column) -> Column:
    """Sections referred to that the text doesn't define, if it defines any."""
    defined = F.array_distinct(_all(c, DEFINED))
    missing = F.array_except(_all(c, SECTION), defined)
    return _issues("info", "reference", F.when(F.size(defined) > 0, missing).otherwise(F.array().cast("array<string>")))


def mixed_paragraphs(c: Column) -> Column:
    """Paragraphs of twenty characters or more with 30 to 70 % of either script."""
    numbered = F.transform(F.split(c, "\n\n"), lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i")))
    ratio = lambda p, k: share(n_of(p, k), n_visible(p))
    odd = F.filter(numbered, lambda x: (F.length(stripped(x["p"])) >= 20) & ratio(x["p"], DEVANAGARI).between(0.3, 0.7) & ratio(x["p"], "A-Za-z").between(0.3, 0.7))
    return _issues("warning", "language", F.transform(odd, lambda x: x["i"]))


def mixed_numbers(c: Column, most: int = 3) -> Column:
    """The first numbers of digits of both scripts; the report names that many."""
    return _issues("warning", "number", F.slice(_all(c, MIXED_DIGITS, 0), 1, most))


def all_issues(c: Column, domain: Column | None = None) -> Column:
    domain = F.lit("general") if domain is None else domain
    c = F.coalesce(c, F.lit(""))
    none = F.array().cast("array<struct<severity:string,category:string,found:string>>")
    legal = F.when(domain.isin("legal", "government"), missing_sections(c)).otherwise(none)
    return F.concat(large_amounts(c), wrong_dates(c), large_shares(c), legal, mixed_paragraphs(c), mixed_numbers(c))


def verdict(issues: Column) -> Column:
    """struct(is_valid, n_errors, n_warnings, adjustment): ten off for an error, three for a warning."""
    n = lambda s: F.size(F.filter(issues, lambda x: x["severity"] == s))
    return F.struct((n("error") == 0).alias("is_valid"), n("error").alias("n_errors"), n("warning").alias("n_warnings"), (-10 * n("error") - 3 * n("warning")).alias("adjustment"))
