"""Row tests of the column functions: conversion gates, repairs, classes, scores."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import classes, fidelity, legacy, quality, semantics, text
from pagewright.functions import devanagari as dv


def values(spark, inputs, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string").select("i", *(f.alias(f"v{k}") for k, f in enumerate(columns))).collect()
    out = [tuple(r)[1:] for r in sorted(rows)]
    return [x[0] for x in out] if len(columns) == 1 else out


C = None


@pytest.fixture(autouse=True)
def column(spark):
    """Columns need a session; tests write C for theirs."""
    global C
    C = F.col("c")


def test_plain_numbers_are_never_legacy(spark):
    inputs = ["10", "500", "2081-01-01", "12/34", "0"]
    assert values(spark, inputs, legacy.is_plain_ascii(C), legacy.is_legacy_encoded(C), legacy.converted(C, F.lit("Preeti"))) == [(True, False, x) for x in inputs]


def test_dates_and_addresses(spark):
    assert values(spark, ["@)#!.$.!*", "www.nepal.gov.np/a;b", "me@site.org", "hello, world", "", None], legacy.is_legacy_encoded(C)) == [True, False, False, True, False, False]


def test_transliteration_takes_longest_keys(spark):
    assert values(spark, ["g]kfn", "cf}", "cfcf]", "If\\", "abc'-x", ""], legacy.transliterated(C, legacy.PREETI)) == ["नेपाल", "औ", "आओ", "क्ष्", "बदअ'-ह", ""]
    assert values(spark, ["k|b"], legacy.transliterated(C, {"k": "1", "k|": "2"})) == ["2b"]
    # Two dashes of the Preeti font stand for themselves and need no key.
    assert len(legacy.PREETI) == 247 and len(legacy.KANTIPUR) == 81 and len(legacy.SAGARMATHA) == 96


def test_fonts_have_maps(spark):
    assert values(spark, ["ABCDEF+Preeti", "e-Kantipur", "Himalb-Bold", "Times New Roman", None], legacy.is_legacy_font(C), legacy.map_name(C)) == [(True, "preeti"), (True, "kantipur"), (True, "himali"), (False, "preeti"), (False, "preeti")]


def test_unknown_map_leaves_text(spark):
    assert values(spark, ["g]kfn"], legacy.force_converted(C, F.lit("himali")), legacy.force_converted(C, F.lit("preeti"))) == [("g]kfn", "नेपाल")]


def test_marks_are_collapsed(spark):
    assert values(spark, ["पूँँजीगत", "संंकलन", "अन्तःःशुल्क", "काा", "नेपाल"], dv.once(C)) == ["पूँजीगत", "संकलन", "अन्तःशुल्क", "का", "नेपाल"]


def test_repairs_are_idempotent(spark):
    inputs = ["ाकि", "कखिा", "क् ", "नेपाल", "", "abc"]
    first = values(spark, inputs, dv.repaired(C))
    assert first == ["कि", "किखा", "क ", "नेपाल", "", "abc"] and values(spark, first, dv.repaired(C)) == first


def test_grammar_counts(spark):
    assert values(spark, ["अा", "का्", "कक", "क़", "च़", "नेपाल", "क्झ"], dv.n_grammar_errors(C), dv.n_uncommon_conjuncts(C)) == [(2, 0), (2, 0), (0, 0), (0, 0), (1, 0), (0, 0), (0, 1)]
    assert values(spark, ["नेपाल", "क", "abc", "अा"], dv.word_likelihood(C)) == [100, 80, 0, 70]


def test_intents(spark):
    asked = ["How do I create an invoice?", "where is the trial balance", "what is VAT", "journal voucher", "why isn't it posting", "which file renders this", "hello"]
    assert values(spark, asked, classes.intent(C)) == ["action_path", "nav", "definition", "definition", "troubleshoot", "code", "general"]


def test_fidelity():
    assert [fidelity.Fidelity.of(x).mode for x in (None, "as-is", "ASSISTED")] == ["forensic", "forensic", "assisted"]
    with pytest.raises(ValueError):
        fidelity.Fidelity.of("bogus")
    assert not fidelity.Fidelity().placeholders and fidelity.Fidelity("assisted").lexicon


def test_quality(spark):
    got = values(spark, ["नेपाल सरकार को ऐन", "undefined", "plain english words", "", None], quality.label(C), quality.score(C))
    assert got[0][0] == "excellent" and got[1][1] == 0.0 and got[2] == ("poor", 0.0) and got[3] == got[4] == ("empty", 0.0)


def test_character_error_rate(spark):
    same = values(spark, ["नेपाल", ""], text.character_error_rate(C, C))
    assert same == [0.0, 0.0] and values(spark, ["नेपल"], text.character_error_rate(C, F.lit("नेपाल"))) == [0.2]


def test_scripts_and_cells(spark):
    assert values(spark, ["नेपाल", "Nepal", "नेपाल abc", "123", "", "!"], text.script(C)) == ["nepali", "english", "nepali", "numeric", "unknown", "unknown"]
    assert values(spark, ["  a \n b\t", None], text.clean_cell(C)) == ["a b", ""]
    assert values(spark, ["a  b\tc  d\n x "], text.ocr_lines(C)) == ["a b\tc d\nx"]
    assert values(spark, ["Page 12 of १२"], text.masked_numbers(C)) == ["Page # of #"]


def test_header_names_files_in_both_ways(spark):
    assert values(spark, ["नेपाल.pdf", "a b.txt"], text.attachment_disposition(C))[0].startswith('attachment; filename="document.pdf"; filename*=UTF-8\'\'%E0%A4')


def test_semantics(spark):
    got = values(spark, ["2080/13/40 and 250% and Rs. 9999999999999999999", "दफा 1. x दफा 2", "fine"], F.transform(semantics.all_issues(C, F.lit("legal")), lambda x: F.concat(x["severity"], F.lit(":"), x["category"])), semantics.verdict(semantics.all_issues(C))["adjustment"])
    assert sorted(got[0][0]) == ["error:date", "error:date", "warning:amount", "warning:amount"] and got[0][1] == -26
    assert got[1][0] == ["info:reference"] and got[2] == ([], 0)


def test_element_classes(spark):
    c = classes.element_class(C, F.lit(10.0), F.lit(10.0), F.lit(False))
    assert values(spark, ["1. item", "(a) x", "Figure 2", "a = b = c", "words", " "], c) == ["list_item", "list_item", "caption", "equation", "paragraph", "empty"]


def test_nfc(spark):
    assert values(spark, ["é", None], text.nfc(C)) == ["é", None]
