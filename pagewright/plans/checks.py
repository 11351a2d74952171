"""Queries on single values and small groups: clean-up, fonts, recognition, images, boxes, spans, words, structure, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, geometry, legacy, quality, semantics, text
from ..functions import devanagari as dv
from ..operators import blocks, corrections, crosspage, documents, images, intelligence, layout, vocabulary
from ..sources import adapters
from . import sql
from .layouts import ELEMENTS, elements
from .texts import ASKED_SQL, CHARS, EVENTS_SQL, LEGACY_SQL, S1, VOCAB_SQL, _code, asked, edits, read, s1, wide

QUERIES, ORACLE = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


# A line as a recogniser gives it, with zero-width and combining characters.
MESSY = "\u200b २३   . Rs.    5,000  \t  cell  two \r\n e\u0301 \r रु.  १२ )"
_LINES = "regexp_replace(regexp_replace(t, '[\u200b\u200c\u200d\ufeff]', '', 'g'), '\\r\\n?', chr(10), 'g')"
_SQUEEZED = f"array_to_string(list_transform(string_split({_LINES}, chr(10)), lambda l: array_to_string(list_transform(string_split(l, chr(9)), lambda c: {sql.strip(chr(39).join(['regexp_replace(c, ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))}), chr(9))), chr(10))"


@query(f"""WITH r AS (SELECT p_partkey AS id, p_name || {sql.q(MESSY)} || p_type AS t, p_name || '/' || p_brand || '~*' || ' é' || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE '.tar.gz' END AS f FROM part)
SELECT id, nfc_normalize(t) AS composed, regexp_replace(regexp_replace({sql.strip(_SQUEEZED)}, '([०-९]+)\\s+([.)])', '\\1\\2', 'g'), '(?i)(Rs\\.?|NPR|रु\\.?|रू\\.?|USD|\\$)[ \\t]+([0-9,०-९])', '\\1 \\2', 'g') AS content,
  {sql.strip("regexp_replace(t, '\\s+', ' ', 'g')")} AS cell,
  CAST(length(regexp_replace(t, '[^ऀ-ॿ]', '', 'g')) AS BIGINT) AS nep, CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS eng, CAST(length(regexp_replace(t, '[^0-9]', '', 'g')) AS BIGINT) AS num,
  'attachment; filename="' || regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(f, '\\.[^./]*$', ''), '[^\\x00-\\x7f]', '', 'g')), '[^A-Za-z0-9._\\- ]', '_', 'g'), '^[._\\- ]+|[._\\- ]+$', '', 'g')
   || CASE WHEN id % 3 = 1 THEN '' ELSE regexp_extract(f, '\\.[^./]*$') END || '"; filename*=UTF-8''''' || replace(url_encode(f), '%2F', '/') AS header
FROM r""")
def q65_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed form, recognised lines, cells, characters by kind and headers of file names."""
    part = read(spark, sf_dir, "part")
    ext = F.when(F.col("p_partkey") % 3 == 0, ".pdf").when(F.col("p_partkey") % 3 == 1, "").otherwise(".tar.gz")
    rows = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(MESSY), "p_type").alias("t"), F.concat("p_name", F.lit("/"), "p_brand", F.lit("~* é"), ext).alias("f"))
    t, kinds = F.col("t"), F.transform(F.split("t", ""), text.character_kind)
    n = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long")
    return rows.select("id", text.nfc(t).alias("composed"), text.ocr_content(t).alias("content"), text.clean_cell(t).alias("cell"), n("nep").alias("nep"), n("eng").alias("eng"), n("numeric").alias("num"), text.attachment_disposition(F.col("f")).alias("header"))


# The maps of the sample fonts, in their order.
MAP_NAMES = ("preeti", "kantipur", "sagarmatha", "preeti", "preeti", "pcsnepali", "preeti", "preeti", "preeti", "preeti", "preeti", "preeti", "preeti")
_FORCED = f"(CASE WHEN {sql.plain_ascii('raw')} THEN raw WHEN m = 'preeti' THEN {sql.transliterated('raw', legacy.PREETI)} WHEN m = 'kantipur' THEN {sql.transliterated('raw', legacy.KANTIPUR)} WHEN m = 'sagarmatha' THEN {sql.transliterated('raw', legacy.SAGARMATHA)} ELSE raw END)"
_TIDY = "regexp_replace(s, 'ि([क-ह])', '\\1ि', 'g')"
for _m in "ािीुूेैोौ":
    _TIDY = f"regexp_replace({_TIDY}, '{_m}+', '{_m}', 'g')"
_TIDY = f"regexp_replace(regexp_replace({_TIDY}, '्+', '्', 'g'), '्\\s', ' ', 'g')"


@query(f"""{S1}, n AS (SELECT *, ([{", ".join(sql.q(m) for m in MAP_NAMES)}])[id % {len(MAP_NAMES)} + 1] AS m FROM s1)
SELECT id, m AS map, {_FORCED} AS forced, CASE WHEN {LEGACY_SQL} THEN {_FORCED} WHEN {sql.legacy_encoded('raw')} AND NOT {sql.plain_ascii('raw')} THEN s ELSE raw END AS cell, {_TIDY} AS tidy,
  CASE WHEN {sql.n_of('raw', 'A-Za-z')} > 0 THEN {sql.n_of('raw', ';/' + chr(92) * 2 + 'lLfmosuv')} / {sql.n_of('raw', 'A-Za-z')} > 0.18 ELSE false END AS sagarmatha, {sql.deva('s')} >= 0.15 AS is_unicode FROM n""")
def q66_font_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of a font, what it makes of a text or cell, and what a text itself tells."""
    rows, raw, font = s1(spark, sf_dir), F.col("raw"), F.col("font")
    m = legacy.map_name(font)
    return rows.select("id", m.alias("map"), legacy.force_converted(raw, m).alias("forced"), legacy.converted_cell(raw, font).alias("cell"), legacy.tidy_transliteration(F.col("s")).alias("tidy"), legacy.is_likely_sagarmatha(raw).alias("sagarmatha"), legacy.is_unicode_text(F.col("s")).alias("is_unicode"))


@query(f"""{CHARS}, x AS (SELECT id, k, any_value(w) AS w, sum(CASE WHEN regexp_matches(c, '^[ा-ौ]$') AND regexp_matches(p, '^[ऀ-ॿ]$') AND NOT regexp_matches(p, '^[क-ह़्ा-ौ]$') THEN 1 ELSE 0 END
  + CASE WHEN c = '्' AND regexp_matches(p, '^[ऀ-ॿ]$') AND NOT regexp_matches(p, '^[क-ह़]$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(c, '^[ा-ौ]$') AND c = p THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(c, '^[ा-्]$') AND NOT regexp_matches(p, '^[ऀ-ॿ]$') THEN 1 ELSE 0 END) AS e, count(*) FILTER (regexp_matches(c, '^[क-ह]$')) AS consonants, count(*) FILTER (regexp_matches(c, '^[ऄ-औ]$')) AS vowels,
  count(*) FILTER (regexp_matches(c, '^[ा-्]$')) AS signs, count(*) FILTER (regexp_matches(c, '^[०-९]$')) AS digits FROM ch GROUP BY ALL)
SELECT w AS word, CAST(any_value(e) AS INTEGER) AS errors, any_value(e) = 0 AS valid, CAST(greatest(0, 100 - 5 * any_value(e)) AS INTEGER) AS confidence, CAST(any_value(consonants) AS INTEGER) AS consonants, CAST(any_value(vowels) AS INTEGER) AS vowels, CAST(any_value(signs) AS INTEGER) AS signs, CAST(any_value(digits) AS INTEGER) AS digits FROM x GROUP BY w""")
def q67_word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that can't follow the one before, and each word's characters by their properties."""
    words = s1(spark, sf_dir).select(F.explode(F.split("s", " ")).alias("word")).where("word <> ''").distinct()
    w = F.col("word")
    each = F.transform(F.split(w, ""), dv.character_properties)
    n = lambda p: F.size(F.filter(each, lambda x: x[p]))
    return words.select("word", dv.n_sequence_errors(w).alias("errors"), (dv.n_sequence_errors(w) == 0).alias("valid"), dv.sequence_confidence(w).alias("confidence"), n("is_consonant").alias("consonants"), n("is_vowel").alias("vowels"), n("is_matra").alias("signs"), n("is_digit").alias("digits"))


KIND_ROWS = ("यो ऐन हो", "कार्यविधि २०८०", "अध्याय १ ऐन", "पाठ्यक्रम", "अन्य", "x" * 500 + "ऐन", "नेपाल abcd पत्रमा प्रकाशित", "संक्षिप्त x र प्रारम्भ", "प्रकाशित x ति :", "lost \ue001□ glyph")
KIND_WANT = ("law / government act", "government procedure", "law / government act", "educational content", "general", "general", "general", "general", "general", "general")


@query(f"""SELECT CAST(i AS INTEGER) AS id, w AS kind, f AS fixed FROM (VALUES {", ".join(f"({i}, {sql.q('general Nepali document' if w == 'general' else 'Nepali ' + w)}, {sql.q(f)})" for i, (w, f) in enumerate(zip(KIND_WANT, KIND_ROWS[:6] + ("नेपाल राजपत्रमा प्रकाशित", "संक्षिप्त नाम र प्रारम्भ", "प्रकाशित मिति :", "lost  glyph"), strict=True)))}) v(i, w, f)""")
def q68_document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of documents by their beginning, and damaged phrases mended by what is around them, of fixed samples with results that are spelt out."""
    t = F.col("t")
    return spark.createDataFrame(list(enumerate(KIND_ROWS)), "id int, t string").select("id", dv.document_kind(t).alias("kind"), dv.without_lost_glyphs(dv.in_context(t)).alias("fixed"))


_LETTERS = "regexp_replace(t, '[^\\p{L}]', '', 'g')"
_GARBAGE = "regexp_matches(t, '(?i)undefined|nan|\\[object')"


@query(f"""{S1}, r AS (SELECT id, CASE WHEN id % 11 = 0 THEN '  ' WHEN id % 4 = 0 THEN raw ELSE s END AS t, CAST(id % 101 AS DOUBLE) AS conf, CAST(id % 90 AS INTEGER) AS words FROM s1),
d AS (SELECT *, CASE WHEN length({_LETTERS}) > 0 THEN length(regexp_replace({_LETTERS}, '[^ऀ-ॿ]', '', 'g')) / length({_LETTERS}) ELSE 0 END AS letters, len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS n FROM r)
SELECT id, CAST(round(CASE WHEN {sql.blank('t')} THEN -1.0 WHEN letters >= 0.25 THEN conf * least(words, 80) / 80.0 * (1 + 0.25 * least(letters, 0.8)) ELSE conf * least(words, 80) / 80.0 END, 4) AS DOUBLE) AS ocr,
  conf >= 85 AND words >= 2 AND NOT {sql.blank('t')} AS good, words < 2 OR conf < 75 AS again,
  CAST(round(0.35 * conf + 0.30 * {sql.score('t')} + 0.15 * least(100.0, words / 5) + 0.20 * letters, 4) AS DOUBLE) AS repair,
  CAST(round(CASE WHEN {sql.blank('t')} THEN 0.0 ELSE 40.0 * {sql.deva('t')} + 0.2 * {sql.score('t')} + least(30.0, length(t) / 100) + least(20.0, n / 10) - CASE WHEN {_GARBAGE} THEN 20.0 ELSE 0.0 END END, 4) AS DOUBLE) AS engine,
  CAST(round({sql.score('t')}, 4) AS DOUBLE) AS quality,
  CAST(round(CASE WHEN {sql.blank('t')} THEN 0.0 WHEN {sql.score('t')} >= 75 THEN least(100.0, {sql.score('t')}) WHEN {sql.score('t')} >= 50 THEN {sql.score('t')} WHEN id % 3 = 0 THEN 70.0 ELSE greatest(30.0, {sql.score('t')}) END, 4) AS DOUBLE) AS page,
  CASE id % 4 WHEN 0 THEN 'nep+eng' WHEN 1 THEN 'nep+eng' WHEN 2 THEN 'eng' ELSE 'hin' END AS lang FROM d""")
def q69_recognition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recognised texts are worth by several scores, and whether and in which language they are read again."""
    base = s1(spark, sf_dir)
    t = F.when(F.col("id") % 11 == 0, "  ").when(F.col("id") % 4 == 0, F.col("raw")).otherwise(F.col("s"))
    rows = base.select("id", t.alias("t"), (F.col("id") % 101).cast("double").alias("conf"), (F.col("id") % 90).cast("int").alias("words"))
    t, conf, words = F.col("t"), F.col("conf"), F.col("words")
    letters = text.share(F.length(F.regexp_replace(t, rf"[^\p{{L}}]|[^{text.DEVANAGARI}]", "")), text.n_of(t, r"\p{L}"))
    lang = F.element_at(F.array(*map(F.lit, ("auto", "nep", "eng", "hin"))), (F.col("id") % 4 + 1).cast("int"))
    made = F.when(F.col("id") % 3 == 0, "good").otherwise("garbage")
    return rows.select(
        "id", F.round(quality.ocr_score(t, conf, words), 4).alias("ocr"), quality.good_enough(t, conf, words).alias("good"), documents.metrics_of_words(conf, words).alias("again"),
        F.round(quality.repair_score(conf, quality.score(t), words, letters), 4).alias("repair"), F.round(quality.engine_score(t), 4).alias("engine"), F.round(quality.score(t), 4).alias("quality"),
        F.round(quality.page_confidence(t, made), 4).alias("page"), quality.ocr_language(lang).alias("lang"),
    )


@query("""WITH r AS (SELECT p_partkey AS id, CAST(p_partkey % 17 - 8 AS DOUBLE) AS skew, CAST(p_partkey % 100 AS DOUBLE) AS noise, CAST(p_partkey * 7 % 100 AS DOUBLE) AS bleed, CAST(p_partkey * 3 % 100 AS DOUBLE) AS shadows, p_partkey % 3 = 0 AS adequate FROM part),
s AS (SELECT *, greatest(0.0, 100.0 - least(25.0, abs(skew) * 3.0) - least(30.0, noise * 0.35) - least(20.0, bleed * 0.2) - least(20.0, shadows * 0.2) - CASE WHEN adequate THEN 0.0 ELSE 15.0 END) AS q FROM r)
SELECT id, CAST(round(q, 4) AS DOUBLE) AS score, CASE WHEN round(q, 6) >= 80 THEN 'clean' WHEN round(q, 6) >= 60 THEN 'moderate' WHEN round(q, 6) >= 40 THEN 'noisy' ELSE 'poor' END AS tier,
  CASE WHEN noise + bleed * 0.5 > 60 THEN 'strong' WHEN noise + bleed * 0.5 > 30 THEN 'medium' ELSE 'light' END AS denoise, CASE WHEN id % 300 > 200 THEN 350 WHEN id % 300 > 100 THEN 380 ELSE 400 END AS dpi,
  CASE WHEN id % 300 > 150 THEN 350 WHEN id % 300 > 50 THEN 380 ELSE 400 END AS image_dpi FROM s""")
def q70_image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good an image is, how strongly it is cleaned, and at what resolution pages are rendered."""
    d = lambda c: c.cast("double")
    k = F.col("p_partkey")
    skew, noise, bleed, shadows = d(k % 17 - 8), d(k % 100), d(k * 7 % 100), d(k * 3 % 100)
    score = quality.image_quality(skew, noise, bleed, shadows, k % 3 == 0)
    pages = k % 300
    return read(spark, sf_dir, "part").select(k.alias("id"), F.round(score, 4).alias("score"), quality.image_tier(F.round(score, 6)).alias("tier"), quality.denoise_level(noise, bleed).alias("denoise"), quality.dpi_for_pages(pages).alias("dpi"), quality.image_file_dpi(pages).alias("image_dpi"))


_BOX = {"a": ("k % 40", "k % 30", "k % 40 + 10 + k % 7", "k % 30 + 8 + k % 5"), "b": ("k * 3 % 40", "k * 5 % 30", "k * 3 % 40 + 12 + k % 3", "k * 5 % 30 + 6 + k % 11")}


@query(f"""WITH r AS (SELECT p_partkey AS k FROM part), b AS (SELECT k, {", ".join(f"CAST({e} AS DOUBLE) AS {n}{c}" for n, es in _BOX.items() for e, c in zip(es, ("x0", "y0", "x1", "y1"), strict=True))} FROM r),
i AS (SELECT *, least(ax1, bx1) - greatest(ax0, bx0) AS w, least(ay1, by1) - greatest(ay0, by0) AS h, (ax1 - ax0) * (ay1 - ay0) AS sa, (bx1 - bx0) * (by1 - by0) AS sb FROM b),
j AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END AS common FROM i)
SELECT k AS id, CAST(round(common / (sa + sb - common), 6) AS DOUBLE) AS iou, CAST(round(common / sa, 6) AS DOUBLE) AS ratio, CAST(round(CASE WHEN h > 0 THEN h / least(ay1 - ay0, by1 - by0) ELSE 0 END, 6) AS DOUBLE) AS vertical,
  CAST(round(CASE WHEN w > 0 THEN w / least(ax1 - ax0, bx1 - bx0) ELSE 0 END, 6) AS DOUBLE) AS horizontal, common / least(sa, sb) >= 0.1 AS overlaps, bx0 >= ax0 - 2 AND by0 >= ay0 - 2 AND bx1 <= ax1 + 2 AND by1 <= ay1 + 2 AS inside FROM j""")
def q71_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two boxes lie to each other."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    a, b = (geometry.box(*(F.expr(e) for e in es)) for es in _BOX.values())
    six = lambda c: F.round(c, 6)
    return rows.select(F.col("k").alias("id"), six(geometry.iou(a, b)).alias("iou"), six(geometry.overlap_ratio(a, b)).alias("ratio"), six(geometry.vertical_overlap(a, b)).alias("vertical"), six(geometry.x_overlap(a, b)).alias("horizontal"), geometry.overlaps(a, b).alias("overlaps"), geometry.contains(a, b).alias("inside"))


# Words as a recogniser gives them, some of them stray marks.
READ = ("नेपाल", "ab", "invoice", "|", "क", "__", "total", "a", "12", " ", "&", "सरकार")
_TSV = f"""WITH w AS (SELECT s_suppkey AS doc_id, CAST(i AS INTEGER) AS place, trim(([{", ".join(sql.q(x) for x in READ)}])[(s_suppkey + i * 5) % {len(READ)} + 1]) AS text, CAST((s_suppkey * 7 + i * 13) % 100 AS DOUBLE) AS conf,
  CAST(i % 4 * 60 + s_suppkey % 5 * (i % 2) * 9 AS DOUBLE) AS x0, CAST(i // 4 * 20 + (s_suppkey + i) % 3 AS DOUBLE) AS y0, CAST(i % 4 * 60 + s_suppkey % 5 * (i % 2) * 9 + 40 AS DOUBLE) AS x1, CAST(i // 4 * 20 + (s_suppkey + i) % 3 + 10 AS DOUBLE) AS y1
 FROM supplier, range(12) t(i)),
k AS (SELECT * FROM w WHERE NOT (text = '' OR regexp_matches(text, '^[_|\\[\\]\\\\/=\\-]+$') OR (conf < CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 30 ELSE 45 END AND length(text) < 3)
  OR (NOT regexp_matches(text, '[ऀ-ॿ]') AND conf < 60 AND regexp_matches(text, '^[a-zA-Z&@#]+$') AND length(text) < 4)))"""


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of twelve words for each supplier."""
    s, i = F.col("s_suppkey"), F.sequence(F.lit(0), F.lit(11))
    each = lambda f: F.transform(i, f)
    left = lambda j: (j % 4 * 60 + s % 5 * (j % 2) * 9).cast("int")
    return read(spark, sf_dir, "supplier").select(
        s.alias("doc_id"), each(lambda j: F.get(F.array(*map(F.lit, READ)), ((s + j * 5) % len(READ)).cast("int"))).alias("text"), each(lambda j: (s * 7 + j * 13) % 100).alias("conf"),
        each(left).alias("left"), each(lambda j: (F.floor(j / 4) * 20 + (s + j) % 3).cast("int")).alias("top"), each(lambda j: F.lit(40)).alias("width"), each(lambda j: F.lit(10)).alias("height"),
    )


@query(f"{_TSV} SELECT * FROM k")
def q72_recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_of(recognised(spark, sf_dir))


@query(f"""{_TSV}, m AS (SELECT *, coalesce(CAST(abs((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER o) >= lag(greatest(1.0, y1 - y0)) OVER o * 0.6 AS INTEGER), 0) AS fresh FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY y0, x0, text)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY y0, x0, text) AS row FROM m),
p AS (SELECT *, x0 - lag(x1) OVER o AS gap, lag(greatest(1.0, y1 - y0)) OVER o AS height, row_number() OVER o AS n FROM r WINDOW o AS (PARTITION BY doc_id, row ORDER BY x0, text)),
l AS (SELECT doc_id, row, string_agg(CASE WHEN gap IS NULL THEN text WHEN gap > height * 1.5 THEN chr(9) || text ELSE ' ' || text END, '' ORDER BY n) AS line FROM p GROUP BY ALL)
SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY row)) AS text FROM l GROUP BY doc_id""")
def q73_layout_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words put back in rows and columns."""
    return layout.layout_text(layout.words_of(recognised(spark, sf_dir)))


_SPANS = """WITH s AS (SELECT l_orderkey AS doc_id, 1 AS page, 1 AS block, CAST(l_linenumber // 4 AS INTEGER) AS line, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS span, CAST(l_linenumber % 4 * 50 + l_partkey % 7 * 10 AS DOUBLE) AS x0,
  CAST(l_linenumber % 4 * 50 + l_partkey % 7 * 10 + 30 AS DOUBLE) AS x1, l_returnflag || CAST(l_linenumber AS VARCHAR) AS text, CAST(8 + l_partkey % 5 AS DOUBLE) AS size, l_partkey % 3 = 0 AS bold, 'F' || CAST(l_partkey % 3 AS VARCHAR) AS font FROM lineitem)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a block, its items as spans with fonts and places."""
    x0 = F.expr("l_linenumber % 4 * 50 + l_partkey % 7 * 10").cast("double")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("block"), F.floor(F.col("l_linenumber") / 4).cast("int").alias("line"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("span"), x0.alias("x0"), (x0 + 30).alias("x1"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), (8 + F.col("l_partkey") % 5).cast("double").alias("size"), (F.col("l_partkey") % 3 == 0).alias("bold"), F.concat(F.lit("F"), (F.col("l_partkey") % 3).cast("string")).alias("font"))


def _joined(before: str) -> str:
    return f"""{_SPANS}, g AS (SELECT *, x0 - lag({before}) OVER (PARTITION BY doc_id, page, block, line ORDER BY span) AS gap FROM s)
SELECT doc_id, line, string_agg(CASE WHEN gap > 50 THEN chr(9) || text WHEN gap > 5 THEN ' ' || text ELSE text END, '' ORDER BY span) AS text FROM g GROUP BY ALL"""


@query(_joined("x1"))
def q74_span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.joined_spans(spans(spark, sf_dir)).drop("page", "block")


@query(_joined("x0"))
def q75_block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of single blocks, whose gaps count from the start of the span before."""
    return layout.joined_spans(spans(spark, sf_dir), from_start=True).drop("page", "block")


@query(f"""{_SPANS}, l AS (SELECT doc_id, line, string_agg(text, '' ORDER BY span) AS t FROM s GROUP BY ALL), f AS (SELECT doc_id, font, sum(length(text)) AS n, min(row(line, span)) AS first FROM s GROUP BY ALL),
x AS (SELECT doc_id, count(*) AS n_lines, arg_min(t, line) AS first_line FROM l GROUP BY ALL), y AS (SELECT doc_id, font, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM f)
SELECT s.doc_id, CAST(sum(length(regexp_replace(text, '\\s', '', 'g'))) AS BIGINT) AS n_chars, any_value(n_lines) AS n_lines, max(size) AS max_size, bool_or(bold) AS is_bold, any_value(y.font) AS font, any_value(first_line) AS first_line,
  CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS eng FROM s JOIN x USING (doc_id) JOIN y ON y.doc_id = s.doc_id AND y.k = 1 GROUP BY s.doc_id""")
def q76_block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.block_metrics(spans(spark, sf_dir)).select("doc_id", "n_chars", "n_lines", "max_size", "is_bold", "font", "first_line", "eng")


_BEST = f"""WITH {VOCAB_SQL}, {ASKED_SQL}, a AS (SELECT DISTINCT word, regexp_replace(word, '[^क-ह]', '', 'g') AS k FROM asked),
m AS (SELECT word, w, d, levenshtein({_code('word')}, {_code('w')}) AS dist, a.k = v2.k AS same FROM a JOIN v2 ON v2.k <> '' AND (a.k = v2.k OR (length(a.k) >= 2 AND levenshtein({_code('a.k')}, {_code('v2.k')}) <= 1))),
n AS (SELECT *, bool_or(same) OVER (PARTITION BY word) AS any_same FROM m WHERE dist <= 2),
best AS (SELECT word, w, d, dist FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, w) AS r FROM n WHERE same OR NOT any_same) WHERE r = 1)"""


@query(f"""{_BEST} SELECT a.word, CASE WHEN v.w IS NOT NULL THEN a.word ELSE coalesce(b.w, a.word) END AS corrected, CAST(CASE WHEN v.w IS NOT NULL OR b.dist = 0 THEN 100 WHEN b.dist = 1 THEN 85 WHEN b.dist = 2 THEN 65 ELSE 30 END AS DOUBLE) AS confidence,
  CASE WHEN v.w IS NOT NULL THEN 'exact_match' WHEN b.w IS NULL THEN 'unknown' WHEN b.dist = 0 THEN 'exact_' || b.d WHEN b.dist = 1 THEN 'near_match_' || b.d ELSE 'fuzzy_match_' || b.d END AS source
FROM a LEFT JOIN v ON v.w = a.word LEFT JOIN best b ON b.word = a.word""")
def q77_corrected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.corrected_words(asked(spark, sf_dir), vocabulary.vocabulary(spark))


@query(f"WITH {VOCAB_SQL} SELECT k AS skeleton, array_to_string(list(w ORDER BY w), ' ') AS words FROM v2 WHERE k <> '' GROUP BY k")
def q78_skeleton_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.skeleton_index(vocabulary.vocabulary(spark)).select("skeleton", F.array_join("words", " ").alias("words"))


@query(f"WITH {ELEMENTS} SELECT doc_id, count(*) AS n, avg(confidence) AS overall, min(confidence) AS least, max(confidence) AS greatest, count(*) FILTER (confidence < 60) AS n_low, coalesce(array_to_string(list(element_id ORDER BY element_id) FILTER (confidence < 60)[1:20], ' '), '') AS low FROM e GROUP BY doc_id")
def q79_confidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intelligence.confidence_report(elements(spark, sf_dir)).withColumn("low", F.array_join("low", " "))


_INK = f"""WITH {ELEMENTS}, b AS (SELECT *, place % 3 <> 0 AS contains_text, kind IN ('image', 'figure', 'chart') OR place % 5 = 0 AS contains_image, kind = 'table' OR place % 13 = 0 AS contains_table, place % 17 = 0 AS mixed_fonts,
  'Font' || CAST(place % 4 AS VARCHAR) AS font, CASE place % 4 WHEN 0 THEN 'unicode' WHEN 1 THEN 'legacy' WHEN 2 THEN 'unknown' ELSE 'mixed' END AS encoding FROM e),
i AS (SELECT *, kind NOT IN ('signature', 'qr_code', 'barcode', 'figure', 'chart', 'formula', 'stamp') AND contains_image AND NOT contains_text AS ink FROM b)"""


def inked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as blocks, with what they hold, fonts and encodings."""
    k = F.col("place")
    e = elements(spark, sf_dir).withColumns({
        "contains_text": k % 3 != 0, "contains_image": F.col("kind").isin("image", "figure", "chart") | (k % 5 == 0), "contains_table": (F.col("kind") == "table") | (k % 13 == 0), "mixed_fonts": k % 17 == 0,
        "font": F.concat(F.lit("Font"), (k % 4).cast("string")), "encoding": F.element_at(F.array(*map(F.lit, ("unicode", "legacy", "unknown", "mixed"))), (k % 4 + 1).cast("int")),
    })
    return e.withColumn("ocr_eligible", classes.ocr_eligible(F.col("kind"), F.col("contains_text"), F.col("contains_image")))


@query(f"""{_INK}, p AS (SELECT doc_id, page, bool_or(contains_text) AS has_text, bool_or(kind IN ('image', 'figure', 'chart')) AS has_images, bool_or(kind = 'table') AS has_tables, bool_or(kind = 'stamp') AS has_stamps,
  array_to_string(list_sort(list(DISTINCT font)), ' ') AS fonts, coalesce(array_to_string(list_sort(list(DISTINCT font) FILTER (encoding = 'legacy')), ' '), '') AS legacy, bool_and(ink) AS all_ink FROM i GROUP BY ALL),
t AS (SELECT *, CASE WHEN has_text AND NOT has_images THEN CASE WHEN legacy <> '' THEN 'digital_legacy' ELSE 'digital_unicode' END WHEN NOT has_text AND has_images THEN 'scanned_clean' ELSE 'mixed' END AS page_type FROM p)
SELECT doc_id, page, page_type, CASE page_type WHEN 'digital_legacy' THEN 'direct_with_conversion' WHEN 'digital_unicode' THEN 'direct' WHEN 'scanned_clean' THEN 'ocr_standard' ELSE 'hybrid' END AS strategy, fonts, legacy, has_tables, has_images, has_stamps, has_text, all_ink,
  row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN has_tables THEN 10 ELSE 0 END + CASE WHEN page > 1 THEN 5 ELSE 0 END DESC, page) AS place FROM t""")
def q80_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page is, how it is read, whether only recognition can, and in which order pages are taken."""
    rows = inked(spark, sf_dir)
    pages = intelligence.page_types(rows).join(intelligence.all_image_based(rows), ["doc_id", "page"]).withColumn("columns", F.when(F.col("page") > 1, 2).otherwise(1))
    placed = intelligence.processing_order(pages)
    return placed.select("doc_id", "page", "page_type", "strategy", F.array_join("fonts", " ").alias("fonts"), F.array_join("legacy_fonts", " ").alias("legacy"), "has_tables", "has_images", "has_stamps", "has_text", "all_ink", F.col("place").cast("long").alias("place"))


@query(f"""{_INK} SELECT element_id, ink, CASE kind WHEN 'paragraph' THEN 'body_text' WHEN 'image' THEN 'figure' WHEN 'chart' THEN 'figure' WHEN 'formula' THEN 'equation' ELSE kind END AS region,
  CASE WHEN contains_table THEN 'table_extraction' WHEN mixed_fonts OR encoding = 'mixed' THEN 'pdf_extraction' WHEN encoding = 'unicode' THEN 'direct' WHEN encoding = 'legacy' THEN 'direct_with_conversion'
   WHEN NOT contains_text AND contains_image THEN CASE WHEN ink THEN 'ocr_standard' ELSE 'skip' END WHEN kind IN ('qr_code', 'figure', 'image', 'chart', 'stamp', 'signature') THEN 'skip' ELSE 'direct' END AS strategy,
  CASE WHEN (y0 + y1) / 2 <= 64 THEN 'header' WHEN (y0 + y1) / 2 >= 736 THEN 'footer' ELSE 'body' END AS zone,
  CAST(CASE WHEN length(text) > 20 THEN 5 ELSE 0 END + CASE kind WHEN 'heading' THEN 78 WHEN 'list' THEN 75 WHEN 'caption' THEN 70 WHEN 'formula' THEN 68 WHEN 'paragraph' THEN 82 ELSE 75 END AS DOUBLE) AS sure,
  CASE WHEN size <= 0 THEN 0 WHEN size >= 17.75 THEN 1 WHEN size >= 13.75 THEN 2 WHEN size >= 11.75 THEN 3 WHEN bold AND size >= 9.5 THEN 3 ELSE 0 END AS level,
  size < 9 AND (regexp_matches(text, '^[0-9*†‡¹²³⁴⁵⁶⁷⁸⁹⁰]+[.)]\\s') OR (regexp_matches(text, '^[0-9]+\\s') AND y0 > 640)) AS footnote FROM i""")
def q81_block_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, strategy, zone, confidence, heading level and footnotes of blocks."""
    rows = intelligence.regions(inked(spark, sf_dir))
    height, t = F.lit(800.0), F.col("text")
    level = intelligence.heading_level(F.col("size"), F.col("bold"), F.lit(10.0), F.array(F.lit(18.0), F.lit(16.0), F.lit(14.0), F.lit(12.0)))
    return rows.select("element_id", F.col("ocr_eligible").alias("ink"), "region", "strategy", classes.zone((F.col("y0") + F.col("y1")) / 2, height).alias("zone"), classes.block_confidence(F.col("kind"), F.length(t)).alias("sure"), level.alias("level"), classes.is_footnote(t, F.col("size"), F.col("y0"), height).alias("footnote"))


_IMAGES = """WITH i AS (SELECT p_partkey AS id, p_size AS doc_id, 1 AS page, CAST(p_partkey * 53 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 31 % 760 AS DOUBLE) AS y0, CAST(p_partkey * 53 % 500 + 30 + p_partkey % 9 * 20 AS DOUBLE) AS x1,
  CAST(p_partkey * 31 % 760 + 30 + p_partkey % 5 * 30 AS DOUBLE) AS y1, CAST(p_partkey % 8 AS INTEGER) AS strokes FROM part)"""


def made_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images and drawings on a page."""
    k, d = F.col("p_partkey"), lambda e: F.expr(e).cast("double")
    return read(spark, sf_dir, "part").select(k.alias("id"), F.col("p_size").alias("doc_id"), F.lit(1).alias("page"), d("p_partkey * 53 % 500").alias("x0"), d("p_partkey * 31 % 760").alias("y0"), d("p_partkey * 53 % 500 + 30 + p_partkey % 9 * 20").alias("x1"), d("p_partkey * 31 % 760 + 30 + p_partkey % 5 * 30").alias("y1"), (k % 8).cast("int").alias("strokes"))


@query(f"""{_IMAGES}, m AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM i), t AS (SELECT * FROM i WHERE id % 4 = 0)
SELECT id, 'signature' AS what FROM m WHERE y0 >= 520 AND w > h AND w BETWEEN 48 AND 300 AND h <= 96
UNION ALL SELECT id, 'stamp' FROM m WHERE (cx < 210 OR cx > 390) AND (cy < 280 OR cy > 520) AND w / h BETWEEN 0.7 AND 1.4 AND w BETWEEN 36 AND 180
UNION ALL SELECT id, 'handwriting' FROM i WHERE strokes >= 4 AND (x1 <= 90 OR x0 >= 400) AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = i.doc_id AND least(t.x1, i.x1) > greatest(t.x0, i.x0) AND least(t.y1, i.y1) > greatest(t.y0, i.y0)
  AND (least(t.x1, i.x1) - greatest(t.x0, i.x0)) * (least(t.y1, i.y1) - greatest(t.y0, i.y0)) / ((i.x1 - i.x0) * (i.y1 - i.y0)) > 0.2)""")
def q82_ink_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, stamps and handwriting by size and place."""
    images = made_images(spark, sf_dir)
    named = lambda df, what: df.select("id", F.lit(what).alias("what"))
    return named(blocks.signatures(images, 600.0, 800.0), "signature").union(named(blocks.stamps(images, 600.0, 800.0), "stamp")).union(named(blocks.handwriting(images, images.where("id % 4 = 0"), 90.0, 400.0), "handwriting"))


@query("""WITH p AS (SELECT p_size AS doc_id, p_partkey AS page, CAST(p_partkey * 7 % 30 AS DOUBLE) AS coverage, CAST(p_partkey * 3 % 25 AS DOUBLE) AS ink, CAST(p_partkey % 9 - 4 AS DOUBLE) AS skew, p_partkey % 3 = 0 AS uni, p_partkey % 7 = 0 AS leg, p_partkey % 4 AS scans, p_partkey % 5 AS tables, p_partkey % 6 AS images, p_partkey % 50 AS nep, p_partkey % 40 AS eng, p_partkey % 3 AS num FROM part),
k AS (SELECT *, CASE WHEN coverage < 1 AND ink < 1 THEN 'blank' WHEN coverage < 3 AND ink > 3 AND abs(skew) > 2 THEN 'scanned_rotated' WHEN coverage < 3 AND ink > 15 THEN 'scanned_noisy' WHEN coverage < 3 AND ink > 3 THEN 'scanned' WHEN leg AND coverage >= 3 THEN 'digital_legacy'
  WHEN uni AND coverage >= 5 THEN 'digital_unicode' WHEN coverage >= 3 AND scans > 0 THEN 'mixed' WHEN tables >= 2 AND coverage < 20 THEN 'table_heavy' WHEN coverage >= 3 THEN 'digital' ELSE 'mixed_low' END AS kind FROM p),
c AS (SELECT *, CAST(CASE kind WHEN 'blank' THEN 90 WHEN 'scanned_rotated' THEN 80 WHEN 'scanned_noisy' THEN 75 WHEN 'scanned' THEN 85 WHEN 'digital_legacy' THEN 88 WHEN 'digital_unicode' THEN 92 WHEN 'mixed' THEN 70 WHEN 'table_heavy' THEN 78 WHEN 'digital' THEN 75 ELSE 55 END AS DOUBLE) AS sure FROM k),
d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (coverage >= 5) AS digital, count(*) FILTER (coverage < 5 AND (scans > 0 OR kind IN ('scanned', 'scanned_noisy'))) AS scanned, count(*) FILTER (leg) AS leg, count(*) FILTER (tables > 0) AS tables, count(*) FILTER (images > 0) AS images, avg(sure) AS sure, sum(nep) AS nep, sum(eng) AS eng, sum(num) AS num FROM c GROUP BY doc_id),
l AS (SELECT doc_id, array_to_string(list(name ORDER BY v DESC, i), ' ') AS languages, list(name ORDER BY v DESC, i) AS ls FROM (SELECT doc_id, unnest(['nep', 'eng', 'numeric']) AS name, unnest([0, 1, 2]) AS i, unnest([nep, eng, num]) AS v FROM d) WHERE v > 0 GROUP BY doc_id)
SELECT d.doc_id, n AS n_pages, digital AS digital_pages, scanned AS scanned_pages, n - digital - scanned AS mixed_pages, leg AS legacy_font_pages, tables AS pages_with_tables, images AS pages_with_images, digital / n >= 0.8 AS is_digital, scanned / n >= 0.8 AND digital / n < 0.2 AS is_scanned,
  round(sure, 6) AS confidence, coalesce(languages, '') AS languages, CASE WHEN scanned / n >= 0.8 AND digital / n < 0.2 THEN 'ocr_full' WHEN leg > 0 THEN 'direct_legacy_conversion' WHEN digital / n >= 0.8 THEN 'direct_unicode' ELSE 'hybrid' END AS pipeline,
  CASE WHEN list_contains(ls, 'nep') AND list_contains(ls, 'eng') THEN 'nep+eng' WHEN list_contains(ls, 'nep') THEN 'nep' WHEN list_contains(ls, 'eng') THEN 'eng' ELSE 'nep+eng' END AS hint FROM d LEFT JOIN l USING (doc_id)""")
def q83_document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of pages by text, ink and fonts, and of documents by their pages."""
    k, d = F.col("p_partkey"), lambda c: c.cast("double")
    p = read(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), k.alias("page"), d(k * 7 % 30).alias("coverage"), d(k * 3 % 25).alias("ink"), d(k % 9 - 4).alias("skew"), (k % 3 == 0).alias("uni"), (k % 7 == 0).alias("has_legacy"), (k % 4).alias("n_scanned"), (k % 5).alias("n_tables"), (k % 6).alias("n_images"), (k % 50).alias("nep"), (k % 40).alias("eng"), (k % 3).alias("numeric"))
    c = blocks.page_class(F.col("coverage"), F.col("ink"), F.col("skew"), F.col("uni"), F.col("has_legacy"), F.col("n_scanned"), F.col("n_tables"))
    found = blocks.document_class(p.withColumn("c", c).withColumn("kind", F.col("c.kind")).withColumn("confidence", F.col("c.confidence")))
    out = found.withColumn("pipeline", intelligence.recommended_pipeline(F.col("is_scanned"), F.col("is_digital"), F.col("legacy_font_pages"))).withColumn("hint", intelligence.language_hint(F.col("languages")))
    return out.select("doc_id", "n_pages", "digital_pages", "scanned_pages", "mixed_pages", "legacy_font_pages", "pages_with_tables", "pages_with_images", "is_digital", "is_scanned", F.round("confidence", 6).alias("confidence"), F.array_join("languages", " ").alias("languages"), "pipeline", "hint")


@query(f"WITH {EVENTS_SQL} SELECT domain, corrected AS word, count(*) AS n FROM ev WHERE domain <> '' GROUP BY ALL")
def q84_domain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.domain_words(edits(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT count(DISTINCT (original, font, domain)) AS corrections, count(DISTINCT (font, original)) FILTER (font <> '') AS font_entries, count(DISTINCT domain) FILTER (domain <> '') AS domains FROM ev")
def q85_correction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.statistics(edits(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT font, original, event_id, corrected FROM (SELECT *, row_number() OVER (PARTITION BY font, original ORDER BY event_id DESC) AS k FROM ev) WHERE k <= 5")
def q86_recent_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.recent(edits(spark, sf_dir).select("font", "original", "event_id", "corrected"), ["font", "original"], "event_id")


_AMOUNTS = """WITH a AS (SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'भ्याट' WHEN 2 THEN 'करयोग्य' WHEN 3 THEN 'जम्मा' ELSE 'Part ' || CAST(l_linenumber AS VARCHAR) END AS label,
  CASE l_linenumber WHEN 1 THEN CAST(13 + l_orderkey % 3 AS DOUBLE) WHEN 2 THEN 100.0 WHEN 3 THEN 113.0 ELSE CAST(l_quantity * 4 AS DOUBLE) END AS value FROM lineitem)"""


@query(f"""{_AMOUNTS}, b AS (SELECT *, max(value) FILTER (label = 'भ्याट') OVER o AS vat, max(value) FILTER (label = 'करयोग्य') OVER o AS taxable, max(value) FILTER (label = 'जम्मा') OVER o AS total FROM a WINDOW o AS (PARTITION BY doc_id))
SELECT DISTINCT doc_id, 'vat' AS issue, label FROM b WHERE label = 'भ्याट' AND abs(vat - taxable * 0.13) > taxable * 0.13 * 0.05 UNION ALL SELECT doc_id, 'component', label FROM b WHERE label <> 'जम्मा' AND value > total * 1.01""")
def q87_amount_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items as labelled amounts: tax, taxable sum, total and parts."""
    k = F.col("l_linenumber")
    label = F.when(k == 1, "भ्याट").when(k == 2, "करयोग्य").when(k == 3, "जम्मा").otherwise(F.concat(F.lit("Part "), k.cast("string")))
    value = F.when(k == 1, (13 + F.col("l_orderkey") % 3).cast("double")).when(k == 2, 100.0).when(k == 3, 113.0).otherwise((F.col("l_quantity") * 4).cast("double"))
    return intelligence.amount_issues(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), label.alias("label"), value.alias("value")))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey % 15 AS m, o_orderkey % 40 AS d, 1990 + o_orderkey % 140 AS y FROM orders)
SELECT id, CASE WHEN y NOT BETWEEN 2000 AND 2120 THEN 'year ' ELSE '' END || CASE WHEN m NOT BETWEEN 1 AND 12 THEN 'month ' ELSE '' END || CASE WHEN d NOT BETWEEN 1 AND 32 THEN 'day ' ELSE '' END AS wrong FROM o""")
def q88_date_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    date = F.concat_ws("-", (1990 + k % 140).cast("string"), (F.col("o_custkey") % 15).cast("string"), (k % 40).cast("string"))
    found = intelligence.date_issues(F.concat(F.lit("on "), date, F.lit(" it was")))
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(" "))), "").alias("wrong"))


@query("""WITH c AS (SELECT s_suppkey AS doc_id, 1 AS page, 'Supplier#0000 stays' AS text FROM supplier) SELECT s_suppkey AS doc_id, 1 AS page,
  CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, 'Supplier', 'Sapplier') ELSE replace(replace(s_name, '0000', 'OOOO'), 'Supplier', 'Sapplier') END AS text FROM supplier""")
def q89_cross_page_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the corrections of enough frequency, one after the other; rare ones aren't made."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page"), F.col("s_name").alias("text"))
    each = F.explode(F.array(F.struct(F.lit("0000").alias("original"), F.lit("OOOO").alias("suggested"), F.when(F.col("doc_id") % 2 == 0, 4).otherwise(5).alias("frequency")), F.struct(F.lit("Supplier").alias("original"), F.lit("Sapplier").alias("suggested"), F.lit(9).alias("frequency"))))
    return crosspage.with_corrections(rows, rows.select("doc_id", "page", each.alias("e")).select("doc_id", "page", "e.*"))


@query("""SELECT 'n' || CAST(o_custkey AS VARCHAR) AS node, array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0), ' ') AS children, min(o_orderkey) FILTER (o_orderkey % 2 = 1) AS caption FROM orders GROUP BY o_custkey""")
def q90_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children and captions in a graph of relations: customers with their orders."""
    o = read(spark, sf_dir, "orders")
    node, even = F.concat(F.lit("n"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 2 == 0
    edges = o.select(F.col("o_orderkey").alias("place"), F.when(even, node).otherwise(F.col("o_orderkey").cast("string")).alias("source"), F.when(even, F.col("o_orderkey").cast("string")).otherwise(node).alias("target"), F.when(even, "parent_child").otherwise("caption_of").alias("relation"))
    kids = intelligence.children(edges.withColumn("target", F.when(F.col("relation") == "parent_child", F.col("place")))).select(F.col("source").alias("node"), F.array_join("children", " ").alias("children"))
    notes = intelligence.captions_of(edges).select(F.col("target").alias("node"), F.col("caption").cast("long").alias("caption"))
    return o.select(node.alias("node")).distinct().join(kids, "node", "left").join(notes, "node", "left")


@query(f"""WITH {ELEMENTS}, l AS (SELECT *, {sql.strip('text')} AS t, CASE WHEN size >= 17.75 THEN 1 WHEN size >= 13.75 THEN 2 WHEN size >= 11.75 THEN 3 WHEN bold AND size >= 9.5 THEN 3 ELSE 0 END AS level FROM e)
SELECT doc_id, page, regexp_replace(string_agg(CASE WHEN level > 0 THEN chr(10) || repeat('#', level) || ' ' || t ELSE t END, chr(10) ORDER BY y0, x0, CASE WHEN level > 0 THEN chr(10) || repeat('#', level) || ' ' || t ELSE t END), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text,
  CAST(round(coalesce(avg(confidence) FILTER (confidence > 0), 0), 6) AS DOUBLE) AS confidence, string_agg(text, chr(10) || chr(10) ORDER BY place) AS plain FROM l GROUP BY ALL""")
def q91_structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text with marked headings, and as plain text in reading order with a mean confidence."""
    rows = elements(spark, sf_dir)
    sizes = rows.select("doc_id").distinct().select("doc_id", F.lit(10.0).alias("body_size"), F.array(F.lit(18.0), F.lit(16.0), F.lit(14.0), F.lit(12.0)).alias("sizes"))
    plain = intelligence.page_text(rows.withColumn("reading_order", F.col("place"))).select("doc_id", "page", F.col("text").alias("plain"), F.round("confidence", 6).alias("confidence"))
    return intelligence.structured_text(rows, sizes).join(plain, ["doc_id", "page"])


_PAGED = "p_name || CASE p_partkey % 3 WHEN 0 THEN chr(10) || chr(10) || '--- Page Break ---' || chr(10) || p_type WHEN 1 THEN ' --- page break --- ' || p_type || '---Page Break---' ELSE '' END"


@query(f"SELECT p_partkey AS id, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS n, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_name || '|' || p_type || '|' ELSE p_name END AS pages FROM part")
def q92_split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents.split_pages(F.col("t"))
    k, br = F.col("p_partkey") % 3, "--- Page Break ---"
    t = F.concat("p_name", F.when(k == 0, F.concat(F.lit(f"\n\n{br}\n"), "p_type")).when(k == 1, F.concat(F.lit(f" {br.lower()} "), "p_type", F.lit("---Page Break---"))).otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select(F.col("p_partkey").alias("id"), F.size(pages).alias("n"), F.array_join(pages, "|").alias("pages"))


@query("""SELECT p_partkey AS id, CAST(least(100.0, CASE WHEN p_partkey % 2 = 0 THEN 40 ELSE 0 END + least(30.0, p_partkey % 90 * 0.5) + least(20.0, p_partkey % 100 * 0.3) + CASE WHEN p_partkey % 5 = 0 THEN 10 ELSE 0 END
  + CASE WHEN p_partkey % 20 > 10 THEN 15 WHEN p_partkey % 20 > 0 THEN 5 ELSE 0 END) AS DOUBLE) AS trust, CAST(p_partkey % 8 AS INTEGER) AS depth FROM part""")
def q93_font_trust_and_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far fonts' tables can be trusted; and the depth of nodes in chains of eight, by the longest path."""
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(k, F.floor(k / 8).alias("doc_id"), k.alias("node"))
    edges = part.where(k % 8 != 7).select("doc_id", F.col("node").alias("source"), (F.col("node") + 1).alias("target")).union(part.where(k % 8 == 1).select("doc_id", F.col("node"), F.col("node") + 3))
    nodes = part.select("doc_id", "node").union(edges.select("doc_id", "target")).union(part.where(k % 8 != 0).select("doc_id", (k - k % 8).alias("node"))).distinct()
    chain = edges.union(part.where(k % 8 != 0).select("doc_id", (F.col("node") - 1).alias("source"), F.col("node"))).distinct()
    depth = documents.graph_order(nodes, chain.where("source >= 0")).select("node", F.col("rank").alias("depth"))
    trust = intelligence.font_confidence(k % 2 == 0, k % 90, k % 100, k % 5 == 0, k % 20)
    return part.select(k.alias("id"), F.round(trust, 6).alias("trust")).join(depth, F.col("id") == F.col("node")).select("id", "trust", "depth")


@query("""SELECT s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE levenshtein(replace(s_name, '0', CASE WHEN s_suppkey % 3 = 0 THEN 'o' ELSE '0' END), s_name) / length(s_name) END AS rate,
  CASE WHEN s_suppkey % 5 = 0 THEN 'MISSING' WHEN s_suppkey % 3 = 0 AND contains(s_name, '0') THEN 'FAIL' ELSE 'PASS' END AS status FROM supplier""")
def q94_golden_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read with wrong digits, or not at all, against what they should be."""
    k = F.col("s_suppkey")
    found = F.when(k % 5 != 0, F.when(k % 3 == 0, F.replace("s_name", F.lit("0"), F.lit("o"))).otherwise(F.col("s_name")))
    return documents.golden_pairs(read(spark, sf_dir, "supplier").select(k.alias("name"), F.col("s_name").alias("expected"), found.alias("found")))


@query(f"""{_IMAGES}, t AS (SELECT * FROM i WHERE id % 4 = 0), c AS (SELECT *, 55.0 AS sure FROM i WHERE id % 4 = 1 AND (x1 - x0) * (y1 - y0) >= 2000 AND (x1 - x0) / (y1 - y0) > 0.4 AND (x1 - x0) / (y1 - y0) < 2.5
 UNION ALL SELECT *, 50.0 FROM i WHERE id % 4 > 1 AND strokes + id % 4 >= 8 AND x1 - x0 > 80 AND y1 - y0 > 60)
SELECT id, CAST(sure AS DOUBLE) AS confidence FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = c.doc_id AND least(t.x1, c.x1) > greatest(t.x0, c.x0) AND least(t.y1, c.y1) > greatest(t.y0, c.y0)
  AND (least(t.x1, c.x1) - greatest(t.x0, c.x0)) * (least(t.y1, c.y1) - greatest(t.y0, c.y0)) / ((c.x1 - c.x0) * (c.y1 - c.y0)) > 0.3)""")
def q95_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = made_images(spark, sf_dir)
    vectors = images.where("id % 4 > 1").withColumn("strokes", F.col("strokes") + (F.col("id") % 4).cast("int"))
    return blocks.charts(images.where("id % 4 = 1"), vectors, images.where("id % 4 = 0")).select("id", "confidence")


@query("""WITH w AS (SELECT l_orderkey AS doc_id, l_returnflag || CAST(l_linenumber AS VARCHAR) AS text, CAST(l_partkey % 130 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 70 AS DOUBLE) AS y0 FROM lineitem),
p AS (SELECT *, (x0 + x0 + 10) / 2 AS cx, (y0 + y0 + 8) / 2 AS cy FROM w)
SELECT doc_id, 1 AS page, CAST(floor(cy / 20) + 1 AS INTEGER) AS row, CAST(floor(cx / 40) + 1 AS INTEGER) AS "column", string_agg(text, ' ' ORDER BY y0, x0, text) AS text FROM p
WHERE doc_id % 3 <> 0 AND cx < 120 AND cy < 60 GROUP BY ALL""")
def q96_ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items as words on a grid of four upright and four level lines; every third order has upright ones only."""
    item = read(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 130).cast("double"), (F.col("l_suppkey") * 7 % 70).cast("double")
    words = item.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + 8).alias("y1"))
    line = lambda a, b, c, d: F.struct(*(F.lit(float(v)).alias(n) for n, v in (("x0", a), ("y0", b), ("x1", c), ("y1", d))))
    upright, level = F.array(*(line(x, 0, x + 0.5, 60) for x in (0, 39.4, 40.2, 80, 120))), F.array(*(line(0, y, 120, y + 0.5) for y in (0, 20, 40, 60)))
    every = item.select(F.col("l_orderkey").alias("doc_id")).distinct()
    rulings = every.select("doc_id", F.lit(1).alias("page"), F.explode(F.when(F.col("doc_id") % 3 == 0, upright).otherwise(F.concat(upright, level))).alias("l")).select("doc_id", "page", "l.*")
    return layout.ruled_tables(words, rulings, 1.0)


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '([0-9]{{4}})[./\\-]([0-9]{{1,2}})[./\\-]([0-9]{{1,2}})') AS ds FROM documents)
SELECT doc_id, CAST(greatest(0.0, doc_id % 40 - 10 * len(list_filter(ds, lambda d: CAST(substr(d, 1, 4) AS INTEGER) BETWEEN 2000 AND 2120 AND CAST(regexp_split_to_array(d, '[./\\-]')[2] AS INTEGER) NOT BETWEEN 1 AND 12))
  - 10 * len(list_filter(ds, lambda d: CAST(substr(d, 1, 4) AS INTEGER) BETWEEN 2000 AND 2120 AND CAST(regexp_split_to_array(d, '[./\\-]')[3] AS INTEGER) NOT BETWEEN 1 AND 32))) AS DOUBLE) AS confidence FROM t""")
def q97_adjusted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up confidences after the dates that can't be."""
    rows = wide(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", documents.adjusted_confidence((F.col("doc_id") % 40).cast("double"), semantics.wrong_dates(F.col("text"))).alias("confidence"))


@query(f"""{S1}, r AS (SELECT id, i AS place, CAST((id * 7 + i * 23) % 101 AS DOUBLE) AS conf, CASE WHEN (id + i) % 3 = 0 THEN raw WHEN (id + i) % 3 = 1 THEN s ELSE s || substr(s, 1, 4) END AS t FROM s1, range(5) k(i)),
w AS (SELECT *, {sql.n_of('t', sql.DEVA)} AS d FROM r),
q AS (SELECT id, coalesce(bool_or(place = 0 AND conf >= 85 AND (d / length(t) >= 0.3 OR d > 20)), false) AS first, coalesce(min(place) FILTER (place > 0 AND conf >= 90 AND d > 30), 4) AS stop FROM w GROUP BY id),
o AS (SELECT w.*, first, row_number() OVER (PARTITION BY w.id ORDER BY round(conf * 0.3 + d * 2 + length(t) * 0.1, 9) DESC, place) AS n FROM w JOIN q USING (id) WHERE place <= CASE WHEN first THEN 0 ELSE stop END)
SELECT id AS doc_id, 'v' || CAST(place AS VARCHAR) AS variant, t AS text, conf AS confidence, first FROM o WHERE n = 1""")
def q98_best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of five made-up readings of a page stays."""
    base = s1(spark, sf_dir).select("id", "raw", "s", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("place"))
    k = (F.col("id") + F.col("place")) % 3
    t = F.when(k == 0, F.col("raw")).when(k == 1, F.col("s")).otherwise(F.concat("s", F.substring("s", 1, 4)))
    rows = base.select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), "place", F.concat(F.lit("v"), F.col("place").cast("string")).alias("variant"), t.alias("text"), ((F.col("id") * 7 + F.col("place") * 23) % 101).cast("double").alias("confidence"))
    return images.best_reading(rows).drop("page")


@query("""WITH r AS (SELECT p_partkey AS id, 300 + p_partkey % 700 AS w, 400 + p_partkey % 900 AS h, CAST(p_partkey * 3 % 25 AS DOUBLE) / 2 AS ink, p_partkey % 12 + 1 AS cores, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 16 END AS gb, p_partkey % 300 AS pages, 700000 + p_partkey % 40 * 10000 AS size FROM part),
t AS (SELECT *, CASE WHEN cores >= 8 AND coalesce(gb, 99) >= 8 THEN 0 WHEN cores >= 4 AND coalesce(gb, 99) >= 4 THEN 1 ELSE 2 END AS tier FROM r)
SELECT id AS doc_id, 'scanned_image' AS kind, 'ltr' AS direction, CAST(ink > 1 AS INTEGER) AS n_scanned, CASE WHEN ink > 1 THEN ink END AS scanned_percent, CAST(ink > 5 AS INTEGER) AS n_handwritten, 'p001_b001' AS name, CAST(w AS DOUBLE) AS x1, CAST(h AS DOUBLE) AS y1,
 (['high', 'balanced', 'safe'])[tier + 1] AS tier, CAST(6.0 - 0.5 * tier - CASE WHEN pages > 200 THEN 1.5 WHEN pages > 100 THEN 1.0 WHEN pages > 30 THEN 0.5 ELSE 0 END AS DOUBLE) AS scale,
 CAST(CASE WHEN size <= 900000 THEN 88 WHEN size - 40000 <= 900000 THEN 86 WHEN size - 80000 <= 900000 THEN 84 ELSE 82 END AS INTEGER) AS quality FROM t""")
def q99_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files as pages and blocks; the scale of pages by machine and length; the quality that keeps a page's file small."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k.alias("doc_id"), (300 + k % 700).alias("width"), (400 + k % 900).alias("height"), ((k * 3 % 25).cast("double") / 2).alias("ink"), F.lit(0.0).alias("skew"))
    tier = images.machine_tier(k % 12 + 1, F.when(k % 5 != 0, k % 16))
    sizes = F.transform(F.sequence(F.lit(80), F.lit(90)), lambda q: F.struct(q.alias("quality"), (700000 + k % 40 * 10000 - (88 - q) * 20000).alias("bytes")))
    chosen = read(spark, sf_dir, "part").select(k.alias("doc_id"), tier.alias("tier"), images.drawing_scale(k % 300, tier).alias("scale"), images.kept_quality(sizes).alias("quality"))
    pages = images.image_pages(rows).select("doc_id", "kind", "direction", "n_scanned", "scanned_percent", "n_handwritten")
    return pages.join(images.image_blocks(rows).select("doc_id", "name", "x1", "y1"), "doc_id").join(chosen, "doc_id")


@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM conversations)
SELECT doc_id, string_agg({sql.strip('l')}, chr(10) ORDER BY k) AS text FROM c WHERE regexp_matches(l, '\\S') GROUP BY doc_id""")
def q100_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations given as single characters, put together again."""
    lines = wide(read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))
    each = lines.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("block"), "line", F.posexplode(F.split("l", "")).alias("place", "c"))
    return layout.characters_text(each).select("doc_id", "text")


@query(f"""{S1}, m AS (SELECT id, CASE WHEN id % 4 = 0 THEN substr(raw, 1, 9) WHEN id % 9 = 1 THEN '2081' ELSE raw END AS raw, CASE id % 6 WHEN 0 THEN substr(s, 1, 2) || substr(raw, 3, 7) WHEN 1 THEN substr(s, 1, 4) || raw WHEN 2 THEN raw WHEN 3 THEN NULL ELSE s END AS made FROM s1)
SELECT id, CASE WHEN made <> raw AND made <> '' AND ({sql.deva('made')} >= 0.40 OR {sql.date_code('raw')} OR (length({sql.strip('raw')}) <= 12 AND {sql.deva('made')} >= 0.15)) THEN made END AS accepted FROM m""")
def q101_other_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken of a converter's made-up answers."""
    k, raw, s = F.col("id") % 6, F.col("raw"), F.col("s")
    made = F.when(k == 0, F.concat(F.substring(s, 1, 2), F.substring(raw, 3, 7))).when(k == 1, F.concat(F.substring(s, 1, 4), raw)).when(k == 2, raw).when(k == 3, None).otherwise(s)
    asked_ = F.when(F.col("id") % 4 == 0, F.substring(raw, 1, 9)).when(F.col("id") % 9 == 1, "2081").otherwise(raw)
    return s1(spark, sf_dir).select("id", legacy.accepted_mapping(asked_, made).alias("accepted"))


@query("""SELECT 'degraded' AS status, 'recognition_missing' AS reasons, 'नेपाल' AS converter_test, '' AS adapters""")
def q102_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an installation without adapters that has Nepali."""
    return adapters.health(spark, ("nep", "eng"), present=())


@query("""WITH f AS (SELECT replace(p_name, ' ', '.') || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE '/a' END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS text, CASE WHEN p_partkey % 7 = 0 THEN 'no' END AS error FROM part)
SELECT name, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN error IS NULL AND text <> '' THEN regexp_replace(name, '\\.[^/.]+$', '') || '_unicode.txt' END AS entry, CASE WHEN error IS NULL AND text <> '' THEN text END AS text FROM f""")
def q103_batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, "").otherwise("/a"))
    files = read(spark, sf_dir, "part").select(name.alias("name"), F.when(k % 5 == 0, "").when(k % 7 == 0, None).otherwise(F.col("p_type")).alias("text"), F.when(k % 7 == 0, "no").alias("error"))
    return documents.batch_files(files)
