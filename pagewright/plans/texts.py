"""Queries on texts: quality, scripts, classes, legacy fonts, Devanagari, semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, fidelity, legacy, quality, semantics, text
from ..functions import devanagari as dv
from ..operators import corrections, fonts, vocabulary
from ..operators.repair import repaired_corruption
from . import sql

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as the cluster has cores, where its files give fewer; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, raw, font: parts' names, types and brands as text that a legacy font may have typed."""
    part = wide(read(spark, sf_dir, "part"))
    listed = F.array(*(F.lit(f) for f in FONTS))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("doc_id"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("raw"), F.get(listed, F.pmod("p_partkey", F.lit(len(FONTS))).cast("int")).alias("font"))


FONTS = ("Preeti", "ABCDEF+Kantipur-Bold", "Sagarmatha", "Times New Roman", "QWERTY+Arial,Bold", "PCS Nepali", "Unheard", "CIDFont+F1", "Himalaya", "KALIMATI_OLD", "Wingdings", "Mangal", "ABCDEF+Type0Preeti")
NAMES = f"""names AS (SELECT p_partkey AS id, p_size AS doc_id, concat_ws(' ', p_name, lower(p_type), lower(p_brand)) AS raw,
  ([{", ".join(sql.q(f) for f in FONTS)}])[p_partkey % {len(FONTS)} + 1] AS font FROM part)"""
S1 = f"WITH {NAMES}, s1 AS (SELECT id, doc_id, raw, font, {sql.transliterated('raw', legacy.PREETI)} AS s FROM names)"


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names with s, their text transliterated by the Preeti map: Devanagari with many irregular sequences."""
    return names(spark, sf_dir).withColumn("s", legacy.transliterated(F.col("raw"), legacy.PREETI))


@query(f"""SELECT lang, count(*) AS n_docs, CAST(sum({sql.n_of('text', sql.DEVA)}) AS BIGINT) AS devanagari, CAST(sum({sql.n_of('text', 'A-Za-z')}) AS BIGINT) AS latin,
  CAST(sum({sql.visible('text')}) AS BIGINT) AS visible, count(*) FILTER ({sql.legacy_encoded('text')}) AS legacy_encoded,
  CAST(sum({sql.penalty('text')}) AS BIGINT) AS penalty, count(*) FILTER ({sql.deva('text')} < 0.10) AS poor, count(*) FILTER ({sql.score('text')} > 0) AS scored
FROM (SELECT lang, {sql.strip("regexp_replace(regexp_replace(text, '[ ]+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM documents) GROUP BY lang""")
def q01_quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language: documents, their characters by script, those that look legacy-encoded, penalties and labels."""
    docs = wide(read(spark, sf_dir, "documents").select("lang", "text")).select("lang", text.tidy(F.col("text")).alias("text"))
    t = F.col("text")
    each = docs.select("lang", text.n_of(t, text.DEVANAGARI).alias("d"), text.n_of(t, "A-Za-z").alias("l"), text.n_visible(t).alias("v"), legacy.is_legacy_encoded(t).alias("e"), quality.penalty(t).alias("p"), quality.label(t).alias("q"), quality.score(t).alias("s"))
    return each.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("d").alias("devanagari"), F.sum("l").alias("latin"), F.sum("v").alias("visible"), F.count_if("e").alias("legacy_encoded"),
        F.sum("p").cast("long").alias("penalty"), F.count_if(F.col("q") == "poor").alias("poor"), F.count_if(F.col("s") > 0).alias("scored"),
    )


@query(f"""WITH c AS (SELECT lang, text, {sql.n_of('text', sql.DEVA)} AS d, {sql.n_of('text', 'A-Za-z')} AS l, {sql.n_of('text', '0-9०-९²³¹')} AS n FROM documents)
SELECT lang, CASE WHEN {sql.blank('text')} OR d + l + n = 0 THEN 'unknown' WHEN d / (d + l + n) > 0.55 THEN 'nepali' WHEN l / (d + l + n) > 0.55 THEN 'english'
  WHEN d > 0 AND l > 0 THEN 'mixed' WHEN n / (d + l + n) > 0.5 THEN 'numeric' ELSE 'mixed' END AS script, count(*) AS n FROM c GROUP BY ALL""")
def q02_script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(read(spark, sf_dir, "documents").select("lang", "text")).groupBy("lang", text.script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


QUESTIONS = (
    "How do I create an invoice?", "where is the trial balance", "what is VAT", "journal voucher", "why isn't my report showing", "steps to post a voucher", "which account is debited", "sql query for ledger",
    "How do I access the stock report", "hello there", "What gets credited on purchase?", "", "Explain payroll", "balance sheet?",
)


def _intent_sql(c: str) -> str:
    word = lambda p: f"(^|[^\\p{{L}}\\p{{N}}_])({p})($|[^\\p{{L}}\\p{{N}}_])"
    cases = " ".join(f"WHEN {sql.has(c, '(?i)' + word(p))} THEN '{n}'" for n, p in classes.INTENTS)
    words = f"len(list_filter(string_split(regexp_replace({c}, '[?.,!]', '', 'g'), ' '), lambda x: x <> ''))"
    bare = f"{c} <> '' AND NOT {sql.has(c, '(?i)^(' + classes.QUESTION_START + ')($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')} AND {words} BETWEEN 1 AND 4 AND {sql.has(c, '(?i)' + word(classes.TOPICS))}"
    return f"CASE {cases} WHEN {bare} THEN 'definition' ELSE 'general' END"


@query(f"""WITH asked AS (SELECT 'turns' AS kind, {sql.strip('text')} AS t FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'samples', {sql.strip('t')} FROM (VALUES {", ".join(f"({sql.q(x)})" for x in QUESTIONS)}) v(t))
SELECT kind, {_intent_sql('t')} AS intent, count(*) AS n FROM asked GROUP BY ALL""")
def q03_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.lit("turns").alias("kind"), F.col("text").alias("t"))
    samples = spark.createDataFrame([("samples", x) for x in QUESTIONS], "kind string, t string")
    return wide(turns).union(samples).groupBy("kind", classes.intent(F.col("t")).alias("intent")).agg(F.count("*").alias("n"))


def _class_sql() -> str:
    k = {
        "legal_act": f"least(40, 8 * {sql.count('text', '(?i)' + classes.LEGAL_ACT)})",
        "legal_circular": f"CASE WHEN {sql.has('text', '(?i)' + classes.LEGAL_CIRCULAR)} THEN 35 ELSE 0 END",
        "financial_statement": f"CASE WHEN {sql.has('text', '(?i)' + classes.FINANCIAL)} THEN 35 ELSE 0 END",
        "audit_report": f"CASE WHEN {sql.has('text', '(?i)' + classes.AUDIT)} THEN 35 ELSE 0 END",
        "book": f"CASE WHEN {sql.has('text', '(?i)' + classes.BOOK)} THEN 30 ELSE 0 END",
        "newspaper": "0",
        "form": f"least(30, 10 * {sql.count('text', '(?i)' + classes.FORM)})",
        "general": "0",
    }
    listed = ", ".join(f"{{'p': {v}, 'i': {i}, 'n': '{n}'}}" for i, (n, v) in enumerate(k.items()))
    return f"""WITH s AS (SELECT doc_id, unnest([{listed}]) AS x FROM documents),
r AS (SELECT doc_id, x.p AS p, x.n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY x.p DESC, x.i) AS k FROM s)
SELECT CASE WHEN a.p < 15 THEN 'general' ELSE a.n END AS primary_class, b.n AS secondary_class, CAST(least(100, a.p + 10) AS INTEGER) AS confidence, count(*) AS n
FROM r a JOIN r b USING (doc_id) WHERE a.k = 1 AND b.k = 2 GROUP BY ALL"""


@query(_class_sql())
def q04_document_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes.document_class(F.col("text"))
    found = wide(read(spark, sf_dir, "documents").select("text")).select(c.alias("c"))
    return found.groupBy(F.col("c.primary").alias("primary_class"), F.col("c.secondary").alias("secondary_class"), F.col("c.confidence").cast("int").alias("confidence")).agg(F.count("*").alias("n"))


ODD = ("10", "500", "2081-01-01", "12/34", "0", "@)#!.$.!*", "www.example.com/a;b", "a@b.np", "hello, world", "नेपाल सरकार", "g]kfn", "", "  ", "plain text 1.2", "sf7df8f}+;", "मिश्रित text {here}")
ODD_ROWS = ", ".join(f"({i}, {sql.q(x)})" for i, x in enumerate(ODD))


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ODD)), "id int, t string")


@query(f"""WITH t AS (SELECT id, t FROM (VALUES {ODD_ROWS}) v(id, t) UNION ALL SELECT 1000 + p_partkey, p_name || '; ' || p_brand FROM part)
SELECT id, {sql.plain_ascii('t')} AS plain, {sql.legacy_encoded('t')} AS legacy, {sql.date_code('t')} AS date_code, {sql.likely_preeti('t')} AS preeti FROM t""")
def q05_encoding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odd(spark).selectExpr("cast(id as long) as id", "t").union(read(spark, sf_dir, "part").select(F.col("p_partkey") + 1000, F.concat("p_name", F.lit("; "), "p_brand")))
    t = F.col("t")
    return rows.select("id", legacy.is_plain_ascii(t).alias("plain"), legacy.is_legacy_encoded(t).alias("legacy"), legacy.is_date_code(t).alias("date_code"), legacy.is_likely_preeti(t).alias("preeti"))


def _guess_sql(c: str) -> str:
    n = lambda ps: " + ".join(f"CAST(contains({c}, {sql.q(p)}) AS INTEGER)" for p in ps)
    return f"""(CASE WHEN {sql.blank(c)} THEN {{'f': 'unknown', 'c': 0}} WHEN {sql.deva(c)} >= 0.40 THEN {{'f': 'unicode', 'c': CAST(round_even({sql.deva(c)} * 100, 0) AS INTEGER)}}
 WHEN {sql.latin(c)} >= 0.25 AND ({n(legacy.KANTIPUR_PIECES)}) > ({n(legacy.PREETI_PIECES)}) THEN {{'f': 'kantipur', 'c': least(90, 50 + 8 * ({n(legacy.KANTIPUR_PIECES)}))}}
 WHEN {sql.latin(c)} >= 0.25 AND ({n(legacy.PREETI_PIECES)}) > 0 THEN {{'f': 'preeti', 'c': least(90, 50 + 8 * ({n(legacy.PREETI_PIECES)}))}}
 WHEN {sql.latin(c)} >= 0.25 THEN {{'f': 'unknown', 'c': 20}} ELSE {{'f': 'unknown', 'c': 10}} END)"""


@query(f"""WITH {NAMES}, t AS (SELECT id, raw AS t FROM names UNION ALL SELECT -1 - id, t FROM (VALUES {ODD_ROWS}) v(id, t))
SELECT id, g.f AS family, g.c AS confidence FROM (SELECT id, {_guess_sql('t')} AS g FROM t)""")
def q07_font_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir).select("id", F.col("raw").alias("t")).union(odd(spark).select((-1 - F.col("id")).cast("long"), "t"))
    return rows.select("id", legacy.guessed_font(F.col("t")).alias("g")).select("id", "g.family", "g.confidence")


def _transliteration(name: str):
    keys = legacy.MAPS[name]

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return names(spark, sf_dir).select("id", legacy.transliterated(F.col("raw"), keys).alias("s"))

    f.__name__ = f"q08_transliterate_{name}"
    query(f"WITH {NAMES} SELECT id, {sql.transliterated('raw', keys)} AS s FROM names")(f)


for _name in legacy.MAPS:
    _transliteration(_name)

LEGACY_SQL = f"coalesce(regexp_matches(lower(font), {sql.q('|'.join(legacy.LEGACY_FONTS))}), false)"


@query(f"""{S1} SELECT id, {sql.n_of('s', sql.DEVA)} AS devanagari, {sql.visible('s')} AS visible,
 CASE WHEN {sql.has('s', '(?i)undefined|nan|' + chr(92) + '[object')} THEN 'garbage'
  WHEN NOT (length({sql.strip('raw')}) = 0 OR (length({sql.strip('s')}) >= 0.5 * length({sql.strip('raw')}) AND length({sql.strip('s')}) <= 2.0 * length({sql.strip('raw')}))) THEN 'length_mismatch'
  WHEN {LEGACY_SQL} AND {sql.deva('s')} < 0.15 AND length({sql.strip('raw')}) > 20 THEN 'low_devanagari' ELSE 'good' END AS label FROM s1""")
def q09_conversion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s1(spark, sf_dir)
    return rows.select("id", text.n_of(F.col("s"), text.DEVANAGARI).cast("long").alias("devanagari"), text.n_visible(F.col("s")).cast("long").alias("visible"), quality.conversion_label(F.col("raw"), F.col("s"), F.col("font")).alias("label"))


@query(f"""{S1}, c AS (SELECT id, CASE WHEN {sql.score('s')} >= {sql.score('raw')} + 2.0 OR {sql.deva('s')} >= 0.25 THEN s ELSE raw END AS accepted,
  CASE WHEN {sql.legacy_encoded('raw')} AND {LEGACY_SQL} THEN s ELSE raw END AS gated FROM s1) SELECT id, accepted, gated FROM c""")
def q10_conversion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s1(spark, sf_dir)
    gated = F.when(legacy.is_legacy_encoded(F.col("raw")) & legacy.is_legacy_font(F.col("font")), F.col("s")).otherwise(F.col("raw"))
    return rows.select("id", quality.accepted_conversion(F.col("raw"), F.col("s")).alias("accepted"), gated.alias("gated"))


def _identified_sql(font: str) -> dict[str, str]:
    raw, subset = f"trim({font})", f"regexp_matches(trim({font}), '^[A-Z]{{6}}\\+')"
    base = f"(CASE WHEN {subset} THEN substr({raw}, 8) ELSE {raw} END)"
    name = f"trim(lower({base}))"
    cid = f"regexp_matches(lower({raw}), '{fonts.CID}')"
    chain = [f"WHEN {cid} AND NOT regexp_matches({name}, 'preeti|kantipur|sagarmatha|himali|aakriti|pcs') THEN {{'m': {base}, 'f': 'unicode', 'c': NULL::VARCHAR}}"]
    for part in sorted(fonts.REGISTRY, key=len, reverse=True):
        m, f, c = fonts.REGISTRY[part]
        chain.append(f"WHEN contains({name}, '{part}') THEN {{'m': {sql.q(m)}, 'f': '{f}', 'c': {sql.q(c) if c else 'NULL'}::VARCHAR}}")
    return {"subset": f"CASE WHEN {subset} THEN substr({raw}, 1, 6) END", "cid": cid, "entry": f"CASE {' '.join(chain)} ELSE {{'m': {font}, 'f': 'unknown', 'c': NULL::VARCHAR}} END"}


_ID = _identified_sql("font")


@query(f"WITH {NAMES} SELECT id, {_ID['subset']} AS subset_id, {_ID['cid']} AS is_cid, e.m AS matched_name, e.f AS family, e.c AS conversion_map FROM (SELECT id, font, {_ID['entry']} AS e FROM names)")
def q11_font_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = fonts.identified(F.col("font"))
    return names(spark, sf_dir).select("id", i["subset_id"].alias("subset_id"), i["is_cid"].alias("is_cid"), i["matched_name"].alias("matched_name"), i["family"].alias("family"), i["conversion_map"].alias("conversion_map"))


@query(f"""WITH {NAMES}, w AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, font ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM names),
g AS (SELECT doc_id, font, sum(length(raw)) AS n, min(id) AS first, string_agg(raw, '' ORDER BY id) FILTER (b < 200) AS sample FROM w GROUP BY ALL),
i AS (SELECT *, {_ID['entry']} AS e, {_guess_sql('sample')} AS gs FROM g),
t AS (SELECT doc_id, font, n, first, CASE WHEN e.f = 'unknown' THEN gs.f ELSE e.f END AS family, CASE WHEN e.f = 'unknown' AND gs.f <> 'unicode' THEN 'preeti' ELSE e.c END AS map FROM i),
f AS (SELECT doc_id, family, sum(n) AS n, count(*) AS k, min(row(-n, first)) AS lead, arg_min(map, -n) FILTER (map IS NOT NULL) AS map FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(k) AS k, list(family) AS fs FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lead) AS o FROM f)
SELECT d.doc_id, CAST(d.k AS BIGINT) AS n_fonts, r.family AS dominant_family, len(list_filter(fs, lambda x: x <> 'unknown')) > 1 AS is_mixed,
  CASE WHEN len(list_filter(fs, lambda x: x <> 'unknown')) = 0 THEN 'unknown' WHEN len(list_filter(fs, lambda x: x NOT IN ('unknown', 'unicode'))) = 0 THEN 'unicode_passthrough'
   WHEN len(list_filter(fs, lambda x: x NOT IN ('unknown', 'unicode'))) = 1 AND NOT list_contains(fs, 'unicode') THEN 'legacy_convert' ELSE 'mixed' END AS strategy
FROM d JOIN r ON r.doc_id = d.doc_id AND o = 1""")
def q12_font_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = names(spark, sf_dir).select("doc_id", F.col("id").alias("place"), "font", F.col("raw").alias("text"))
    return fonts.font_summary(fonts.font_table(spans)).drop("dominant_map")


def _repair(name: str, f, oracle: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return s1(spark, sf_dir).select("id", f(F.col("s")).alias("s"))

    run.__name__ = name
    query(f"{S1} SELECT id, {oracle} AS s FROM s1")(run)


_repair("q13_double_marks", dv.once, sql.once("s"))
_repair("q14_orphans", dv.without_orphans, sql.without_orphans("s"))
_repair("q15_displacement", dv.redistributed, sql.redistributed("s"))
_repair("q16_halants", dv.tidy_halants, sql.tidy_halants("s"))
_repair("q20_grammar_repair", dv.grammar_repaired, sql.grammar_repaired("s"))


@query(f"""{S1}, a AS (SELECT id, {sql.once('s')} AS s FROM s1), b AS (SELECT id, {sql.without_orphans('s')} AS s FROM a), c AS (SELECT id, {sql.redistributed('s')} AS s FROM b)
SELECT id, {sql.tidy_halants('s')} AS s FROM c""")
def q17_full_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s1(spark, sf_dir).select("id", dv.repaired(F.col("s")).alias("s"))


M, C, V = f"[{sql.MATRAS}]", "[क-ह]", "[ऄ-औ]"
CHARS = f"""{S1}, w AS (SELECT id, unnest(string_split(s, ' ')) AS w, unnest(range(1, len(string_split(s, ' ')) + 1)) AS k FROM s1),
ch AS (SELECT id, k, w, i, substr(w, i, 1) AS c, CASE WHEN i > 1 THEN substr(w, i - 1, 1) ELSE '' END AS p, substr(w, i + 1, 1) AS n FROM (SELECT id, k, w, unnest(range(1, length(w) + 1)) AS i FROM w WHERE w <> '')),
e AS (SELECT id, k, w,
  sum(CASE WHEN regexp_matches(c, '^{M}$') AND NOT regexp_matches(p, '^[क-ह़्{sql.MATRAS}]$') THEN 1 ELSE 0 END
    + CASE WHEN c = '्' AND NOT regexp_matches(p, '^[क-ह़]$') THEN 1 ELSE 0 END + CASE WHEN c = '़' AND NOT regexp_matches(p, '^[{dv.NUKTA_BASES}]$') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(c, '^{V}$') AND regexp_matches(p, '^{V}$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(c, '^{M}$') AND regexp_matches(p, '^{V}$') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(c, '^{M}$') AND c = p THEN 1 ELSE 0 END + CASE WHEN c = '्' AND regexp_matches(p, '^{M}$') THEN 1 ELSE 0 END) AS errors,
  sum(CASE WHEN c = '्' AND regexp_matches(p, '^{C}$') AND regexp_matches(n, '^{C}$') AND NOT regexp_matches(p || n, '^({"|".join(f"{a}[{b}]" for a, b in dv.CONJUNCTS.items())})$') THEN 1 ELSE 0 END) AS odd
  FROM ch GROUP BY ALL)"""


@query(f"""{CHARS} SELECT w AS word, CAST(any_value(errors) AS INTEGER) AS errors, CAST(any_value(odd) AS INTEGER) AS uncommon,
  CAST(any_value(CASE WHEN {sql.n_of('w', sql.DEVA)} = 0 THEN 0 ELSE greatest(0, least(100, CASE WHEN regexp_matches(w, '^([क-ह]|[ऄ-औ])$') THEN least(80, base) ELSE base END)) END) AS INTEGER) AS likelihood, count(*) AS n
FROM (SELECT *, 100 - 15 * errors - 5 * odd - CASE WHEN {sql.n_of('w', sql.DEVA)} / length(w) < 0.7 THEN 20 ELSE 0 END - CASE WHEN length(w) > 20 THEN 10 ELSE 0 END AS base FROM e) GROUP BY w""")
def q18_grammar_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = s1(spark, sf_dir).select(F.explode(F.split("s", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    w = F.col("word")
    return words.select("word", dv.n_grammar_errors(w).alias("errors"), dv.n_uncommon_conjuncts(w).alias("uncommon"), dv.word_likelihood(w).cast("int").alias("likelihood"), "n")


LOST = "\ue000-\uf8ff□"
CORRUPTED = f"{S1}, c AS (SELECT id, replace(replace(s, 'म', chr(57344)), 'भ', chr(9633)) AS s FROM s1)"


@query(f"{CORRUPTED} SELECT id, {sql.n_of('s', LOST)} AS lost, {sql.n_of('s', LOST)} * 20 >= greatest(length(s), 20) AS saturated FROM c")
def q21_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s1(spark, sf_dir).select("id", F.replace(F.replace("s", F.lit("म"), F.lit("\ue000")), F.lit("भ"), F.lit("□")).alias("s"))
    return rows.select("id", text.n_of(F.col("s"), text.CORRUPTION).cast("long").alias("lost"), (text.corruption_score(F.col("s")) >= 1.0).alias("saturated"))


CLAUSES = "regexp_replace(regexp_replace({c}, '([।.;])\\s+', '\\1' || chr(1), 'g'), '(?i)\\s+(" + "|".join(dv.CONJUNCTION_WORDS) + ")\\s+', chr(1), 'g')"


@query(f"""{S1}, t AS (SELECT id, {sql.strip("regexp_replace(s || '। ' || raw, '\\s+', ' ', 'g')")} AS t FROM s1), p AS (SELECT id, unnest(string_split({CLAUSES.format(c='t')}, chr(1))) AS x FROM t)
SELECT id, count(*) AS n, CAST(sum(length({sql.strip('x')})) AS BIGINT) AS n_chars, count(*) FILTER (regexp_matches(x, {sql.q('|'.join(dv.LEGAL_WORDS))})) AS legal FROM p WHERE length({sql.strip('x')}) >= 3 GROUP BY id""")
def q23_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s1(spark, sf_dir).select("id", F.explode(dv.clauses(F.concat("s", F.lit("। "), "raw"))).alias("c"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("n_chars"), F.count_if(dv.clause_domain(F.col("c")) == "legal").alias("legal"))


@query(f"{S1} SELECT id, regexp_replace(s, '[^क-ह]', '', 'g') AS skeleton, regexp_replace(regexp_replace(s, '[ा-ॏॢॣंः]', '', 'g'), '[^{sql.DEVA}]', '', 'g') AS loose FROM s1")
def q24_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s1(spark, sf_dir).select("id", dv.skeleton(F.col("s")).alias("skeleton"), dv.loose_skeleton(F.col("s")).alias("loose"))


def _vocabulary() -> dict[str, str]:
    first: dict[str, str] = {}
    for d, listed in vocabulary.WORDS.items():
        for w in listed:
            first.setdefault(w, d)
    return first


VOCAB = _vocabulary()
VOCAB_LIST = "[" + ", ".join(sql.q(w) for w in VOCAB) + "]"
_LETTERS = "".join(sorted({c for w in VOCAB for c in w}))
ASCII = "".join(chr(c) for c in range(40, 40 + len(_LETTERS)))
VOCAB_SQL = f"v(w, d, o) AS (SELECT unnest({VOCAB_LIST}), unnest([{', '.join(sql.q(d) for d in VOCAB.values())}]), unnest(range(1, {len(VOCAB) + 1}))), v2 AS (SELECT w, d, o, regexp_replace(w, '[^क-ह]', '', 'g') AS k FROM v)"
ASKED_SQL = f"asked AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN w ELSE substr(w, 1, CAST(p_partkey % length(w) AS INTEGER)) || substr(w, CAST(p_partkey % length(w) AS INTEGER) + 2) END AS word FROM (SELECT p_partkey, ({VOCAB_LIST})[p_partkey % {len(VOCAB)} + 1] AS w FROM part))"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, word: vocabulary words, two of three without one of their letters."""
    words = F.array(*(F.lit(w) for w in VOCAB))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(words, (F.col("p_partkey") % len(VOCAB)).cast("int")).alias("w"))
    at = (F.col("id") % F.length("w")).cast("int")
    return rows.select("id", F.when(F.col("id") % 3 == 0, F.col("w")).otherwise(F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).alias("word"))


@query(f"WITH {VOCAB_SQL}, {ASKED_SQL} SELECT d AS domain, count(*) AS n, count(DISTINCT word) AS n_words FROM asked LEFT JOIN v ON word = w GROUP BY d")
def q25_known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocabulary.known(asked(spark, sf_dir), vocabulary.vocabulary(spark))
    return found.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("word").alias("n_words"))


def _code(c: str) -> str:
    return f"translate({c}, {sql.q(_LETTERS)}, {sql.q(ASCII)})"


@query(f"""WITH {VOCAB_SQL}, {ASKED_SQL}, a AS (SELECT DISTINCT word, regexp_replace(word, '[^क-ह]', '', 'g') AS k FROM asked),
m AS (SELECT word, w, d, levenshtein({_code('word')}, {_code('w')}) AS dist, a.k = v2.k AS same FROM a JOIN v2 ON v2.k <> '' AND (a.k = v2.k OR (length(a.k) >= 2 AND levenshtein({_code('a.k')}, {_code('v2.k')}) <= 1))),
n AS (SELECT *, bool_or(same) OVER (PARTITION BY word) AS any_same FROM m WHERE dist <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, w) AS k FROM n WHERE same OR NOT any_same)
SELECT word, w AS candidate, CAST(dist AS INTEGER) AS distance, d AS domain, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 5""")
def q26_fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.closest_words(asked(spark, sf_dir), vocabulary.vocabulary(spark))


def _same_or_other(c: str) -> str:
    """The code of a word any of whose letters may be unknown to the vocabulary; these are all alike, as none of them meets one."""
    return _code(f"regexp_replace({c}, {sql.q('[^' + _LETTERS + ']')}, '~', 'g')")


@query(f"""{S1}, {VOCAB_SQL}, c AS (SELECT id, nfc_normalize({sql.strip(f"replace(s, 'म', chr(57344)) || ' ' || replace(({VOCAB_LIST})[id % {len(VOCAB)} + 1], 'र', chr(57344)) || '।'")}) AS t FROM s1),
p AS (SELECT id, unnest(ms) AS piece, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT id, regexp_extract_all(t, '\\s+|[।.،,;:!?]+|[^\\s।.،,;:!?]+') AS ms FROM c)),
m AS (SELECT *, replace(piece, chr(57344), '') AS bare, contains(piece, chr(57344)) AS damaged FROM p),
a AS (SELECT DISTINCT bare AS word, regexp_replace(bare, '[^क-ह]', '', 'g') AS k FROM m WHERE damaged AND length(bare) >= 3 AND regexp_matches(bare, '[ऀ-ॿ]') AND NOT regexp_matches(bare, '^[२०-९।./-]+$')),
n AS (SELECT word, w, levenshtein({_same_or_other('word')}, {_code('w')}) AS dist, a.k = v2.k AS same FROM a JOIN v2 ON v2.k <> '' AND (a.k = v2.k OR (length(a.k) >= 2 AND levenshtein({_same_or_other('a.k')}, {_code('v2.k')}) <= 1))),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY NOT same, dist, w) AS place FROM n WHERE dist <= 2),
x AS (SELECT id, m.k, coalesce(v.w, r.w, CASE WHEN damaged THEN bare ELSE piece END) AS piece FROM m LEFT JOIN a ON damaged AND a.word = bare LEFT JOIN v ON v.w = a.word LEFT JOIN r ON r.word = a.word AND place = 1)
SELECT id, {sql.strip("regexp_replace(coalesce(string_agg(piece, '' ORDER BY k), ''), '\\s+', ' ', 'g')")} AS text FROM c LEFT JOIN x USING (id) GROUP BY id""")
def q22_corruption_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with lost glyphs, by the vocabulary; all other words stay. Each text ends in a vocabulary word, many of them damaged."""
    lost = lambda c, letter: F.replace(c, F.lit(letter), F.lit("\ue000"))
    last = F.get(F.array(*(F.lit(w) for w in VOCAB)), (F.col("id") % len(VOCAB)).cast("int"))
    rows = s1(spark, sf_dir).select("id", F.concat(lost(F.col("s"), "म"), F.lit(" "), lost(last, "र"), F.lit("।")).alias("text"))
    return repaired_corruption(rows, vocabulary.vocabulary(spark), ["id"])


STATEMENTS = (
    "Rs. 1,500.50 and रु 9,999,999,999,999,999,999", "Date 2080/13/05 and 2081-01-40, 1999/99/99", "growth of 120% and 15 % and 300.5प्रतिशत", "दफा 1. text दफा ५: more दफा 9 and दफा १२", "value १२34 and 56७८ and 1२ and 9९",
    "यो एक परीक्षण हो mixed text here for you आज", "nothing to see", "2080/01/15 ok",
    "से अधिक 5% 120%", "से अधिक 300% or 300%", "से अधिक text of more than twenty characters 150%",
)


ISSUES_SQL = f"""WITH t AS (SELECT id, t FROM (VALUES {", ".join(f"({i}, {sql.q(x)})" for i, x in enumerate(STATEMENTS))}) v(id, t) UNION ALL SELECT 100 + doc_id, text FROM documents),
a AS (SELECT id, unnest(regexp_extract_all(t, '(?:रु\\.?|Rs\\.?|NRs\\.?)\\s*([0-9,]+(?:\\.[0-9]+)?)', 1)) AS x FROM t),
d AS (SELECT id, unnest(regexp_extract_all(t, '([0-9]{{4}})[./\\-]([0-9]{{1,2}})[./\\-]([0-9]{{1,2}})', 1)) AS y, unnest(regexp_extract_all(t, '([0-9]{{4}})[./\\-]([0-9]{{1,2}})[./\\-]([0-9]{{1,2}})', 2)) AS m, unnest(regexp_extract_all(t, '([0-9]{{4}})[./\\-]([0-9]{{1,2}})[./\\-]([0-9]{{1,2}})', 3)) AS n FROM t),
pm AS (SELECT id, t, regexp_extract_all(t, '[0-9.]+\\s*(?:%|प्रतिशत)') AS ms, string_split_regex(t, '[0-9.]+\\s*(?:%|प्रतिशत)') AS parts FROM t),
p AS (SELECT id, regexp_extract(ms[k], '^[0-9.]+') AS x, right(array_to_string(list_transform(range(1, k), lambda j: parts[j] || ms[j]), '') || parts[k], 20) AS before FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM pm)),
g AS (SELECT id, unnest(string_split(t, chr(10) || chr(10))) AS x FROM t),
s AS (SELECT id, regexp_extract_all(t, 'दफा\\s*([0-9०-९]+)\\s*[.:]', 1) AS def, regexp_extract_all(t, 'दफा\\s*([0-9०-९]+)', 1) AS ref FROM t),
i AS (SELECT id, 'warning' AS severity, 'amount' AS category FROM a WHERE try_cast(replace(x, ',', '') AS DOUBLE) > 1e15
 UNION ALL SELECT id, 'error', 'date' FROM d WHERE CAST(y AS INTEGER) BETWEEN 2000 AND 2120 AND CAST(m AS INTEGER) NOT BETWEEN 1 AND 12
 UNION ALL SELECT id, 'error', 'date' FROM d WHERE CAST(y AS INTEGER) BETWEEN 2000 AND 2120 AND CAST(n AS INTEGER) NOT BETWEEN 1 AND 32
 UNION ALL SELECT id, 'warning', 'amount' FROM p WHERE try_cast(x AS DOUBLE) > 100 AND NOT contains(before, 'से अधिक')
 UNION ALL SELECT id, 'warning', 'language' FROM g WHERE length({sql.strip('x')}) >= 20 AND {sql.deva('x')} BETWEEN 0.3 AND 0.7 AND {sql.latin('x')} BETWEEN 0.3 AND 0.7
 UNION ALL SELECT id, 'warning', 'number' FROM (SELECT id, unnest(regexp_extract_all(t, '[०-९]+[0-9]+|[0-9]+[०-९]+')[1:3]) AS x FROM t)
 UNION ALL SELECT id, 'info', 'reference' FROM (SELECT id, unnest(list_filter(list_distinct(ref), lambda r: NOT list_contains(def, r))) FROM s WHERE len(def) > 0))"""


@query(ISSUES_SQL + " SELECT id, severity, category, count(*) AS n FROM i GROUP BY ALL")
def q29_semantic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame(list(enumerate(STATEMENTS)), "id long, t string")
    rows = wide(read(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("t"))).union(samples)
    each = rows.select("id", F.explode(semantics.all_issues(F.col("t"), F.lit("legal"))).alias("i"))
    return each.groupBy("id", "i.severity", "i.category").agg(F.count("*").alias("n"))


@query(ISSUES_SQL + """, v AS (SELECT t.id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM t LEFT JOIN i ON i.id = t.id WHERE t.id >= 100 GROUP BY t.id)
SELECT e = 0 AS is_valid, CAST(-10 * e - 3 * w AS INTEGER) AS adjustment, count(*) AS n FROM v GROUP BY ALL""")
def q30_semantic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", semantics.verdict(semantics.all_issues(F.col("text"))).alias("v"))
    return rows.groupBy("v.is_valid", "v.adjustment").agg(F.count("*").alias("n"))


@query(f"""SELECT s_suppkey AS id, levenshtein(replace(s_name, '0', 'o'), s_name) AS distance, levenshtein(replace(s_name, '0', 'o'), s_name) / length(s_name) AS rate FROM supplier""")
def q50_character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.replace("s_name", F.lit("0"), F.lit("o"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.levenshtein(wrong, F.col("s_name")).cast("long").alias("distance"), text.character_error_rate(wrong, F.col("s_name")).alias("rate"))


EVENTS_SQL = """ev AS (SELECT event_id, epoch_us(ts) AS seen_at, CASE WHEN user_id % 3 = 0 THEN 'abc' || CAST(user_id % 7 AS VARCHAR) ELSE 'word' || CAST(user_id % 11 AS VARCHAR) END AS original,
  CASE WHEN event_id % 5 = 0 THEN 'abd' || CAST(user_id % 7 AS VARCHAR) ELSE 'ward' || CAST(user_id % 11 AS VARCHAR) END AS corrected,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE 'font' || CAST(user_id % 4 AS VARCHAR) END AS font, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS domain, 50 + event_id % 50 AS confidence FROM events)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    n = lambda word, k: F.concat(F.lit(word), (F.col("user_id") % k).cast("string"))
    return e.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_at"), F.when(F.col("user_id") % 3 == 0, n("abc", 7)).otherwise(n("word", 11)).alias("original"),
        F.when(F.col("event_id") % 5 == 0, n("abd", 7)).otherwise(n("ward", 11)).alias("corrected"), F.when(F.col("user_id") % 4 == 0, "").otherwise(n("font", 4)).alias("font"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("domain"), (50 + F.col("event_id") % 50).alias("confidence"),
    )


STORE_SQL = "st AS (SELECT original, font, domain, arg_min(corrected, event_id) AS corrected, count(*) AS n, max(confidence) AS confidence, max(seen_at) AS last_seen FROM ev GROUP BY ALL)"


@query(f"WITH {EVENTS_SQL}, {STORE_SQL} SELECT * FROM st")
def q52_correction_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.store(edits(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT unnest(string_split(original, '')) AS wrong, unnest(string_split(corrected, '')) AS meant FROM ev WHERE length(original) = length(corrected))
SELECT wrong, meant, count(*) AS n FROM c WHERE wrong <> meant GROUP BY ALL ORDER BY n DESC, wrong, meant LIMIT 20""")
def q53_common_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.common_confusions(edits(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL}, {STORE_SQL}, mp AS (SELECT font, original, arg_max(corrected, event_id) AS corrected FROM ev WHERE font <> '' GROUP BY ALL), k AS (SELECT DISTINCT original, font, domain FROM ev)
SELECT k.original, k.font, k.domain,
  CASE WHEN a.n >= 2 AND a.confidence >= 60 THEN a.corrected WHEN b.n >= 3 THEN b.corrected WHEN m.corrected IS NOT NULL THEN m.corrected WHEN d.n >= 5 THEN d.corrected END AS suggestion,
  CAST(CASE WHEN a.n >= 2 AND a.confidence >= 60 THEN least(95, a.confidence + 2 * a.n) WHEN b.n >= 3 THEN least(90, b.confidence) WHEN m.corrected IS NOT NULL THEN 80 WHEN d.n >= 5 THEN least(85, d.confidence) END AS DOUBLE) AS confidence
FROM k LEFT JOIN st a ON a.original = k.original AND a.font = k.font AND a.domain = k.domain LEFT JOIN st b ON b.original = k.original AND b.font = k.font AND b.domain = ''
LEFT JOIN mp m ON m.original = k.original AND m.font = k.font LEFT JOIN st d ON d.original = k.original AND d.font = '' AND d.domain = ''""")
def q54_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edits(spark, sf_dir)
    return corrections.suggested(e, corrections.store(e), corrections.font_maps(e))


MODES = ("forensic", "as-is", "ASSISTED", "clean", "ocr_max", "smart", "bogus", "")


@query(f"""SELECT name, mode, mode = 'assisted' AS allow_lexicon, mode = 'assisted' AS allow_cross_page, mode <> 'forensic' AS allow_matra, mode <> 'forensic' AS allow_placeholders,
  CAST(CASE WHEN mode = 'assisted' THEN 0.05 WHEN mode IN ('balanced', 'ocr_max') THEN 0.15 ELSE 1.1 END AS DOUBLE) AS least_corruption
FROM (SELECT name, CASE WHEN name = '' THEN 'forensic' {" ".join(f"WHEN lower(name) IN ({', '.join(sql.q(a) for a in names_)}) THEN '{m}'" for m, names_ in fidelity.ALIASES.items())} END AS mode
FROM (VALUES {", ".join(f"({sql.q(m)})" for m in MODES)}) v(name))""")
def q57_fidelity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in MODES], "name string").select("name", fidelity.mode_of(F.col("name")).alias("mode"))
    return rows.select("name", "mode", *(v.alias(k) for k, v in fidelity.settings_of(F.col("mode")).items()))
