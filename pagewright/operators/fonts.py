"""Fonts: names, the registry, documents' font tables and what follows for conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legacy import guessed_font, is_legacy_encoded, is_legacy_font, is_plain_ascii, is_unicode_text
from ..functions.text import DEVANAGARI, is_blank, stripped

# Parts of font names, with display name, family and map.
REGISTRY = {
    "preeti": ("Preeti", "preeti", "preeti"), "ganess": ("Ganess", "preeti", "preeti"), "ganesh": ("Ganesh", "preeti", "preeti"), "fontasy": ("Fontasy Himali", "preeti", "preeti"),
    "kanchan": ("Kanchan", "preeti", "preeti"), "navjeevan": ("Navjeevan", "preeti", "preeti"), "siddhi": ("Siddhi", "preeti", "preeti"), "vishwash": ("Vishwash", "preeti", "preeti"),
    "kantipur": ("Kantipur", "kantipur", "kantipur"), "ekantipur": ("e-Kantipur", "kantipur", "kantipur"), "sagarmatha": ("Sagarmatha", "sagarmatha", "sagarmatha"),
    "himalaya": ("Himalaya", "unicode", None), "himali": ("Himali", "himali", "himali"), "himalb": ("Himali Bold", "himali", "himali"), "aakriti": ("Aakriti", "aakriti", "aakriti"),
    "pcsnepali": ("PCS Nepali", "pcsnepali", "pcsnepali"), "pcs": ("PCS", "pcsnepali", "pcsnepali"), "kalimati_old": ("Kalimati (Old)", "preeti", "preeti"),
    "mangal": ("Mangal", "unicode", None), "kalimati": ("Kalimati", "unicode", None), "lohit": ("Lohit Devanagari", "unicode", None), "noto": ("Noto Sans Devanagari", "unicode", None),
    "mukta": ("Mukta", "unicode", None), "tiro": ("Tiro Devanagari", "unicode", None), "yatra": ("Yatra One", "unicode", None), "laila": ("Laila", "unicode", None),
    "bitstreamvera": ("Bitstream Vera", "unicode", None), "arial": ("Arial Unicode", "unicode", None), "times": ("Times New Roman", "unicode", None), "helvetica": ("Helvetica", "unicode", None),
    "courier": ("Courier", "unicode", None),
}
CID = "cid|type0|identity-h|identity-v|-cjk"
DECORATIVE = "wingdings|webdings|symbol|zapfdingbats"


def parsed_name(font: Column) -> dict[str, Column]:
    """An embedded font's name: subset tag, base name and whether glyphs go by id."""
    raw = stripped(F.coalesce(font, F.lit("")))
    subset = raw.rlike(r"\A[A-Z]{6}\+")
    base = F.when(subset, F.substring(raw, F.lit(8), F.length(raw))).otherwise(raw)
    return {"is_subset": subset, "subset_id": F.when(subset, F.substring(raw, 1, 6)), "base_name": base, "normalized_name": stripped(F.lower(base)), "is_cid": F.lower(raw).rlike(CID)}


def identified(font: Column) -> dict[str, Column]:
    """matched_name, family, conversion_map, is_legacy, encoding of a font's name: the longest part of the registry that it has."""
    p = parsed_name(font)
    name = p["normalized_name"]
    passes = p["is_cid"] & ~name.rlike("preeti|kantipur|sagarmatha|himali|aakriti|pcs")
    entry = lambda matched, family, m: F.struct(matched.alias("matched_name"), F.lit(family).alias("family"), F.lit(m).cast("string").alias("conversion_map"))
    found = F.when(passes, entry(p["base_name"], "unicode", None))
    for part in sorted(REGISTRY, key=len, reverse=True):
        matched, family, m = REGISTRY[part]
        found = found.when(name.contains(part), entry(F.lit(matched), family, m))
    found = found.when(font.rlike(f"[{DEVANAGARI}]"), entry(font, "unicode", None)).otherwise(entry(font, "unknown", None))
    family = found["family"]
    return {k: p[k] for k in ("base_name", "subset_id", "is_subset", "is_cid")} | {
        "matched_name": found["matched_name"],
        "family": family,
        "conversion_map": found["conversion_map"],
        "is_legacy": ~family.isin("unicode", "unknown"),
        "encoding": F.when(family == "unicode", "unicode").when(family == "unknown", "unknown").otherwise("legacy"),
    }


def is_decorative(font: Column) -> Column:
    return F.lower(font).rlike(DECORATIVE)


def should_convert(text: Column, font: Column, family: Column, is_legacy: Column, is_cid: Column, encoding: Column) -> Column:
    """Whether a span goes through a legacy map; Unicode text and fonts never do."""
    unicode_font = (family == "unicode") | (is_cid & ~is_legacy) | (encoding == "unicode")
    stays = is_blank(text) | is_decorative(font) | is_plain_ascii(text) | is_unicode_text(text) | unicode_font
    return ~stays & (is_legacy_font(font) | is_legacy | is_legacy_encoded(text))


def font_table(spans: DataFrame, sample: int = 200) -> DataFrame:
    """doc_id, font, char_count, matched_name, family, conversion_map, confidence, is_legacy for each font of each document.

    spans: (doc_id, place, font, text). A font of an unknown family is guessed
    from its first spans, up to sample characters and the span that passes
    them; what isn't Unicode then counts as legacy, by preeti's map.
    """
    seen = spans.where(~is_blank(F.col("text")))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id", "font").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = seen.select("doc_id", "font", F.col("place").alias("p"), "text", before.alias("before"))
    pieces = F.collect_list(F.when(F.col("before") < sample, F.struct("p", "text")))
    grouped = marked.groupBy("doc_id", "font").agg(F.sum(F.length("text")).alias("char_count"), F.min("p").alias("first"), F.array_join(F.transform(F.array_sort(pieces), lambda x: x["text"]), "").alias("sample"))
    named = grouped.select("*", *(v.alias(k) for k, v in identified(F.col("font")).items()))
    guess = guessed_font(F.col("sample"))
    unknown = (F.col("family") == "unknown") & (F.col("sample") != "")
    out = named.withColumn("guess", F.when(unknown, guess))
    family = F.coalesce("guess.family", "family")
    legacy = F.when(F.col("guess").isNotNull(), family != "unicode").otherwise(F.col("is_legacy"))
    return out.select("doc_id", "font", "char_count", "first", "matched_name", family.alias("family"), F.when(F.col("guess").isNotNull() & (family != "unicode"), F.coalesce("conversion_map", F.lit("preeti"))).otherwise(F.col("conversion_map")).alias("conversion_map"), F.coalesce("guess.confidence", F.lit(90)).alias("confidence"), legacy.alias("is_legacy"))


def font_summary(fonts: DataFrame) -> DataFrame:
    """doc_id, n_fonts, dominant_family, dominant_map, is_mixed, strategy for each document of a font table."""
    by_family = fonts.groupBy("doc_id", "family").agg(F.sum("char_count").alias("n"), F.min(F.struct((-F.col("char_count")).alias("less"), "first")).alias("lead"), F.min_by("conversion_map", F.when(F.col("conversion_map").isNotNull(), F.struct((-F.col("char_count")).alias("less"), "first"))).alias("map"), F.count("*").alias("k"))
    per_doc = by_family.groupBy("doc_id").agg(F.sum("k").alias("n_fonts"), F.min_by(F.struct("family", "map"), F.struct((-F.col("n")).alias("less"), "lead")).alias("d"), F.collect_set("family").alias("families"))
    known = F.array_except("families", F.array(F.lit("unknown")))
    legacy = F.array_except(known, F.array(F.lit("unicode")))
    strategy = F.when(F.size(known) == 0, "unknown").when(F.size(legacy) == 0, "unicode_passthrough").when((F.size(legacy) == 1) & ~F.array_contains(known, "unicode"), "legacy_convert").otherwise("mixed")
    return per_doc.select("doc_id", "n_fonts", F.col("d.family").alias("dominant_family"), F.col("d.map").alias("dominant_map"), (F.size(known) > 1).alias("is_mixed"), strategy.alias("strategy"))


def aliases(fonts: DataFrame) -> DataFrame:
    """doc_id, alias, font: raw, base and normalised names; a later font takes an alias over."""
    p = parsed_name(F.col("font"))
    names = F.array_distinct(F.array(F.col("font"), p["base_name"], p["normalized_name"]))
    each = fonts.select("doc_id", "font", "first", F.explode(names).alias("alias"))
    return each.groupBy("doc_id", "alias").agg(F.max_by("font", F.struct("first", "font")).alias("font"))


def resolved(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """spans with family, conversion_map and is_legacy: by raw, base or normalised name, else from the registry."""
    look = aliases(fonts).join(fonts, ["doc_id", "font"]).select("doc_id", "alias", F.struct("family", "conversion_map", "is_legacy").alias("info"))
    p = parsed_name(F.col("font"))
    out = spans
    for i, key in enumerate((F.col("font"), p["base_name"], p["normalized_name"])):
        side = look.select(F.col("doc_id").alias("_d"), F.col("alias").alias("_a"), F.col("info").alias(f"_i{i}"))
        out = out.join(side, (F.col("doc_id") == F.col("_d")) & (key == F.col("_a")), "left").drop("_d", "_a")
    own = identified(F.col("font"))
    info = F.coalesce("_i0", "_i1", "_i2", F.struct(own["family"].alias("family"), own["conversion_map"].alias("conversion_map"), own["is_legacy"].alias("is_legacy")))
    return out.withColumn("_info", info).select(*spans.columns, "_info.family", "_info.conversion_map", "_info.is_legacy")


def block_fonts(spans: DataFrame) -> DataFrame:
    """doc_id, block, font, n_chars, share_percent, confidence of the block: shares of fonts, weighted by characters. spans: (doc_id, block, font, text, confidence)."""
    each = spans.where(~is_blank(F.col("text"))).groupBy("doc_id", "block", "font").agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.length("text") * F.col("confidence")).alias("weight"))
    w = Window.partitionBy("doc_id", "block")
    return each.select("doc_id", "block", "font", "n_chars", (100.0 * F.col("n_chars") / F.sum("n_chars").over(w)).alias("share_percent"), (F.sum("weight").over(w) / F.sum("n_chars").over(w)).alias("confidence"))
