"""Queries on words and blocks with places, pages, documents, admission and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes, legacy, quality
from ..functions.text import stripped
from ..operators import admission, blocks, crosspage, documents, layout
from ..sources.stored import folder as stored_folder
from ..streaming import queries as streams
from . import sql
from .texts import FONTS, read, wide

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


WIDTH, HEIGHT = 600.0, 800.0
# Texts of made-up page elements.
SAMPLES = ("1. first item", "(a) nested item", "Figure 3 a view", "Page 7", "x = y + z", "- dash item", "2.1. second level", "A heading without stop", "Plain text that ends.")
KINDS = ("paragraph", "table", "figure", "image", "heading", "stamp", "list", "caption", "chart", "signature", "qr_code", "formula")

ELEMENTS = f"""e AS (SELECT p_brand AS doc_id, p_size % 3 + 1 AS page, p_partkey AS element_id, p_partkey AS place,
  CAST(CASE WHEN p_partkey % 7 = 0 OR p_partkey % 2 = 0 THEN 40 ELSE 320 END AS DOUBLE) AS x0,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN 540 WHEN p_partkey % 2 = 0 THEN 260 ELSE 540 END AS DOUBLE) AS x1,
  CAST((p_partkey * 37) % 780 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 780 + 10 + p_partkey % 5 * 2 AS DOUBLE) AS y1,
  CAST(8 + p_partkey % 6 * 2 AS DOUBLE) AS size, p_partkey % 4 = 0 AS bold,
  ([{", ".join(sql.q(s) for s in SAMPLES)}])[p_partkey % {len(SAMPLES)} + 1] || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_name ELSE '' END AS text,
  ([{", ".join(sql.q(k) for k in KINDS)}])[p_partkey % {len(KINDS)} + 1] AS kind, CAST(50 + p_partkey % 45 AS DOUBLE) AS confidence FROM part)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up elements of pages: two columns, wide elements, sizes, texts and kinds, a function of the part's key."""
    k = F.col("p_partkey")
    listed = lambda xs: F.get(F.array(*(F.lit(x) for x in xs)), (k % len(xs)).cast("int"))
    wide_one, even = k % 7 == 0, k % 2 == 0
    y0 = ((k * 37) % 780).cast("double")
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), (F.col("p_size") % 3 + 1).alias("page"), k.alias("element_id"), k.alias("place"),
        F.when(wide_one | even, 40.0).otherwise(320.0).alias("x0"), F.when(wide_one, 540.0).when(even, 260.0).otherwise(540.0).alias("x1"), y0.alias("y0"), (y0 + 10 + k % 5 * 2).alias("y1"),
        (8 + k % 6 * 2).cast("double").alias("size"), (k % 4 == 0).alias("bold"), F.concat(listed(SAMPLES), F.when(k % 5 == 0, F.concat(F.lit(" "), "p_name")).otherwise("")).alias("text"),
        listed(KINDS).alias("kind"), (50 + k % 45).cast("double").alias("confidence"),
    )


VOLUMES = "(SELECT * REPLACE (source || '-' || CAST(doc_id // 300 AS VARCHAR) AS source) FROM documents) d"


def volumes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents as pages of volumes of their source: doc_id, page, the columns, and id, a document's own. A volume has 300 pages at most, however large the table."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 300).cast("string")).alias("doc_id"), *columns)
    return docs.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")))


@query(f"""WITH g AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, string_split(text, chr(10)) AS ls FROM {VOLUMES}),
z AS (SELECT source, page, 'header' AS zone, ls[1] AS line FROM g UNION ALL SELECT source, page, 'footer', ls[-1] FROM g),
n AS (SELECT source, count(*) AS pages FROM g GROUP BY source),
m AS (SELECT source, zone, trim(regexp_replace(regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM z WHERE regexp_matches(line, '\\S')),
c AS (SELECT source, zone, line, count(*) AS n_pages FROM m WHERE line <> '' GROUP BY ALL)
SELECT source AS doc_id, zone, line, n_pages FROM c JOIN n USING (source) WHERE pages >= 3 AND n_pages >= greatest(2, floor(pages * 0.02))""")
def q28_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines of texts that come back on 2 % of a volume's pages."""
    docs = volumes(spark, sf_dir, "text")
    ls = F.split("text", "\n")
    lines = docs.select("doc_id", "page", F.explode(F.array(F.struct(F.lit("header").alias("zone"), F.get(ls, 0).alias("line")), F.struct(F.lit("footer").alias("zone"), F.get(ls, F.size(ls) - 1).alias("line")))).alias("z")).select("doc_id", "page", "z.*")
    return crosspage.running_lines(lines, share=0.02)


@query("""WITH w AS (SELECT item_id % 7 AS doc_id, item_id AS page, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 3 GROUP BY ALL),
m AS (SELECT r.doc_id, r.word, f.word AS suggested, f.n AS frequency, row_number() OVER (PARTITION BY r.doc_id, r.word ORDER BY f.n DESC, f.word) AS k
  FROM c r JOIN c f ON r.doc_id = f.doc_id AND r.n < 3 AND f.n >= 3 AND levenshtein(r.word, f.word) = 1)
SELECT DISTINCT w.doc_id, w.page, m.word AS original, m.suggested, m.frequency FROM m JOIN w ON w.doc_id = m.doc_id AND w.word = m.word WHERE k = 1""")
def q27_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "benchmark").select((F.col("item_id") % 7).alias("doc_id"), F.col("item_id").alias("page"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return crosspage.near_misses(words)


BOXES = """b AS (SELECT id, li, k, x, coalesce(sum(length(x) + 1) OVER (PARTITION BY id, li ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM (SELECT id, li, unnest(string_split(l, ' ')) AS x, unnest(range(0, len(string_split(l, ' ')))) AS k FROM (SELECT conv_id * 1000 + turn AS id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS li FROM conversations))),
w AS (SELECT id AS doc_id, x AS text, 6.0 * o + CASE WHEN k >= 3 THEN 40 ELSE 0 END AS x0, 6.0 * (o + length(x)) + CASE WHEN k >= 3 THEN 40 ELSE 0 END AS x1, 12.0 * li AS y0, 12.0 * li + 10 AS y1 FROM b WHERE x <> ''),
r AS (SELECT *, coalesce(CASE WHEN abs((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER o) >= 0.6 * lag(greatest(1, y1 - y0)) OVER o THEN 1 ELSE 0 END, 0) AS new FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY y0, x0, text)),
rows_ AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY y0, x0, text) AS row_no FROM r)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations with places as a printer with fixed pitch would set them, and a gap after each third word."""
    rows = wide(read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "l")).select("doc_id", "li", F.posexplode(F.split("l", " ")).alias("k", "text"))
    o = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id", "li").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.when(F.col("k") >= 3, 40).otherwise(0)
    placed = lines.withColumn("o", o).where("text <> ''")
    return placed.select("doc_id", "text", (6.0 * F.col("o") + shift).alias("x0"), (6.0 * (F.col("o") + F.length("text")) + shift).alias("x1"), (12.0 * F.col("li")).alias("y0"), (12.0 * F.col("li") + 10).alias("y1"))


@query(f"WITH {BOXES} SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, count(*) AS n_words, min(x0) AS x0, max(x1) AS x1 FROM rows_ GROUP BY ALL")
def q31_word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_rows(boxes(spark, sf_dir)).groupBy("doc_id", F.col("row").alias("row_no")).agg(F.count("*").alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(f"""WITH {BOXES}, g AS (SELECT *, x0 - lag(x1) OVER o AS gap, lag(greatest(1, y1 - y0)) OVER o AS h, row_number() OVER o AS k FROM rows_ WINDOW o AS (PARTITION BY doc_id, row_no ORDER BY x0, text))
SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, string_agg(CASE WHEN gap IS NULL THEN text WHEN gap > 1.5 * h THEN chr(9) || text ELSE ' ' || text END, '' ORDER BY k) AS line FROM g GROUP BY ALL""")
def q32_row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_texts(layout.with_rows(boxes(spark, sf_dir))).select("doc_id", F.col("row").alias("row_no"), "line")


@query(f"""WITH {ELEMENTS}, p AS (SELECT doc_id, page, unnest(range(greatest(0, CAST(floor(x0 / 3.0) AS BIGINT)), least(199, CAST(floor(x1 / 3.0) AS BIGINT)) + 1)) AS bin, y1 - y0 AS h FROM e),
d AS (SELECT doc_id, page, bin, sum(h) AS density FROM p GROUP BY ALL), a AS (SELECT DISTINCT doc_id, page FROM d),
z AS (SELECT doc_id, page, b FROM (SELECT doc_id, page, unnest(range(0, 200)) AS b FROM a) x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = x.doc_id AND d.page = x.page AND d.bin = x.b AND density >= 0.1)),
i AS (SELECT *, b - row_number() OVER (PARTITION BY doc_id, page ORDER BY b) AS i FROM z)
SELECT doc_id, page, min(b) AS start, max(b) + 1 AS stop FROM i GROUP BY doc_id, page, i HAVING max(b) + 1 - min(b) >= 6""")
def q33_column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gaps(layout.projection(elements(spark, sf_dir), WIDTH), least=6)


RULES_SQL = f"""WITH RECURSIVE {ELEMENTS}, u AS (SELECT doc_id, page, element_id, x0, x1, y0, CASE WHEN x1 - x0 > 400 THEN y0 + 4 ELSE y1 END AS y1 FROM e)"""


def ruled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elements whose wide ones are rules, too low to fill the gap between columns."""
    y1 = F.when(F.col("x1") - F.col("x0") > 400, F.col("y0") + 4).otherwise(F.col("y1"))
    return elements(spark, sf_dir).select("doc_id", "page", "element_id", "x0", "x1", "y0", y1.alias("y1"))


@query(f"""{RULES_SQL}, body AS (SELECT * FROM u WHERE y1 - y0 > 5 AND x1 - x0 > 30),
bin AS (SELECT DISTINCT doc_id, page, unnest(range(CAST(floor(x0 / 3) AS BIGINT), least(199, CAST(floor(x1 / 3) AS BIGINT)) + 1)) AS bin FROM body),
hole AS (SELECT doc_id, page, bin AS start, lead(bin) OVER (PARTITION BY doc_id, page ORDER BY bin) AS stop FROM bin),
cut AS (SELECT doc_id, page, list((start + 1 + stop) * 1.5 ORDER BY start) AS cuts FROM hole WHERE stop - start - 1 >= 6 AND (start + 1) * 3 >= 30 AND stop * 3 <= 570 GROUP BY ALL),
rim AS (SELECT doc_id, page, min(x0) AS lo, max(x1) AS hi FROM body GROUP BY ALL),
edge AS (SELECT rim.doc_id, rim.page, [lo] || CASE WHEN len(cuts) <= 4 THEN cuts ELSE [] END || [hi] AS xs FROM rim LEFT JOIN cut USING (doc_id, page)),
piece AS (SELECT doc_id, page, xs[i] AS c0, xs[i + 1] AS c1, len(xs) = 2 AS sole FROM (SELECT *, unnest(range(1, len(xs))) AS i FROM edge)),
held AS (SELECT p.doc_id, p.page, c0, c1, count(*) FILTER ((x0 + x1) / 2 BETWEEN c0 - 5 AND c1 + 5) AS n FROM piece p JOIN body USING (doc_id, page) WHERE c1 - c0 >= 90 OR sole GROUP BY ALL),
col AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY c0) - 1 AS col, c0, c1 FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, page) AS total FROM held) WHERE n >= greatest(1, total * 0.08) OR total = 0),
span AS (SELECT doc_id, page, max(c1) - min(c0) AS span, count(*) AS k FROM col GROUP BY ALL),
v AS (SELECT u.*, coalesce(k, 1) AS k, coalesce(k > 1 AND x1 - x0 >= span * 0.7, false) AS wide, coalesce((SELECT min(col) FROM col WHERE col.doc_id = u.doc_id AND col.page = u.page AND (x0 + x1) / 2 BETWEEN c0 - 5 AND c1 + 5), 0) AS col FROM u LEFT JOIN span USING (doc_id, page)),
f AS (SELECT v.*, (SELECT count(*) FROM v o WHERE o.wide AND o.doc_id = v.doc_id AND o.page = v.page AND (o.y0, -CAST(o.wide AS INTEGER), o.x0, o.element_id) <= (v.y0, -CAST(v.wide AS INTEGER), v.x0, v.element_id)) AS band,
  (SELECT max(o.y1) FROM v o WHERE o.wide AND o.doc_id = v.doc_id AND o.page = v.page AND (o.y0, -CAST(o.wide AS INTEGER), o.x0, o.element_id) <= (v.y0, -CAST(v.wide AS INTEGER), v.x0, v.element_id)) AS under FROM v),
g AS (SELECT *, CASE WHEN k <= 1 THEN 2 WHEN wide THEN 0 WHEN y0 < under THEN 1 ELSE 2 END AS turn FROM f)
SELECT doc_id, page, element_id, CAST(CASE WHEN k > 1 THEN col ELSE 0 END AS INTEGER) AS "column",
  CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY band, turn, CASE WHEN k > 1 AND turn = 2 THEN col ELSE 0 END, y0, x0, element_id) - 1 AS INTEGER) AS reading_order FROM g""")
def q34_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ruled_pages(spark, sf_dir)
    return layout.reading_order(e, layout.columns_of(e, WIDTH)).select("doc_id", "page", "element_id", "column", "reading_order")


@query(f"""WITH RECURSIVE {BOXES}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(y0 / 3, 0), x0, y0, x1, y1, text) AS n FROM w),
al(doc_id, n, anchor, line) AS (SELECT doc_id, n, y0, 0 FROM s WHERE n = 1
  UNION ALL SELECT s.doc_id, s.n, CASE WHEN abs(s.y0 - anchor) > 3 THEN s.y0 ELSE anchor END, line + CASE WHEN abs(s.y0 - anchor) > 3 THEN 1 ELSE 0 END FROM al JOIN s ON s.doc_id = al.doc_id AND s.n = al.n + 1),
t AS (SELECT doc_id, line, x0, x1, text, row_number() OVER o AS k, (lag(x1) OVER o + x0) / 2 AS middle, x0 - lag(x1) OVER o AS gap FROM al JOIN s USING (doc_id, n) WINDOW o AS (PARTITION BY doc_id, line ORDER BY x0, y0, x1, y1, text)),
l AS (SELECT doc_id, line, coalesce(list(middle ORDER BY k) FILTER (gap >= 24), []) AS bounds FROM t GROUP BY ALL),
tr(doc_id, line, bounds, run) AS (SELECT doc_id, line, bounds, 1 FROM l WHERE line = 0
  UNION ALL SELECT l.doc_id, l.line, CASE WHEN same THEN b ELSE l.bounds END, run + CASE WHEN same THEN 0 ELSE 1 END
  FROM (SELECT l.doc_id, l.line, l.bounds, tr.bounds AS b, run, len(l.bounds) > 0 AND len(l.bounds) = len(tr.bounds) AND len(list_filter(range(1, len(l.bounds) + 1), lambda i: abs(l.bounds[i] - tr.bounds[i]) > 12)) = 0 AS same FROM tr JOIN l ON l.doc_id = tr.doc_id AND l.line = tr.line + 1) l),
long AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM tr WHERE len(bounds) > 0) WHERE n >= 3),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS tab FROM long),
c AS (SELECT doc_id, tab, line, cell, coalesce(string_agg(text, ' ' ORDER BY k), '') AS said FROM (SELECT *, unnest(range(0, len(bounds) + 1)) AS cell FROM numbered) m
  LEFT JOIN (SELECT t.doc_id AS d, t.line AS l2, t.text, t.k, len(list_filter(q.bounds, lambda x: t.x0 >= x)) AS c FROM t JOIN numbered q ON q.doc_id = t.doc_id AND q.line = t.line) z ON d = doc_id AND l2 = line AND c = cell GROUP BY ALL)
SELECT doc_id, CAST(tab AS INTEGER) AS table_no, CAST(line AS INTEGER) AS line, string_agg(said, ' | ' ORDER BY cell) AS cells FROM c GROUP BY ALL""")
def q35_borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = boxes(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), "text", "x0", "y0", "x1", "y1")
    return layout.borderless_tables(words).select("doc_id", F.col("table").alias("table_no"), "line", F.array_join("cells", " | ").alias("cells"))


@query("""WITH r AS (SELECT n_regionkey AS region, n_name AS a, CAST(n_nationkey AS VARCHAR) AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation),
w AS (SELECT region, max(length(a)) + 2 AS wa, max(length(b)) + 2 AS wb, count(*) AS n FROM r GROUP BY region),
l AS (SELECT region, k, n, wa, wb, '│' || ' ' || a || repeat(' ', wa - length(a) - 1) || '│' || ' ' || b || repeat(' ', wb - length(b) - 1) || '│' || CASE WHEN k = 1 AND n > 1 THEN chr(10) || '├' || repeat('─', wa) || '┼' || repeat('─', wb) || '┤' ELSE '' END AS line FROM r JOIN w USING (region))
SELECT region, '┌' || repeat('─', any_value(wa)) || '┬' || repeat('─', any_value(wb)) || '┐' || chr(10) || string_agg(line, chr(10) ORDER BY k) || chr(10) || '└' || repeat('─', any_value(wa)) || '┴' || repeat('─', any_value(wb)) || '┘' AS drawn FROM l GROUP BY region""")
def q36_drawn_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    tables = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(cells.alias("rows"))
    return tables.select("region", layout.drawn_table(F.col("rows")).alias("drawn"))


_CAPTION = "(?i)^(?:Figure|Fig\\.?|Table|Chart|Graph|Diagram|Photo|Image|छवि|तालिका|चित्र|सारणी)\\s*[०-९0-9]"


@query(f"""WITH {ELEMENTS} SELECT doc_id, page, element_id, CASE WHEN (y0 + y1) / 2 <= 64 THEN 'header' WHEN (y0 + y1) / 2 >= 800 * 0.92 THEN 'footer'
  WHEN (x1 < 108 OR x0 > 492) AND x1 - x0 < 132 THEN 'margin_note' WHEN contains(text, '=') AND length(text) < 80 THEN 'formula' WHEN regexp_matches(text, {sql.q(_CAPTION)}) THEN 'caption'
  WHEN size >= 11.5 AND (bold OR size >= 13.5) AND length(text) < 200 THEN 'heading' ELSE 'paragraph' END AS block_class FROM e""")
def q37_block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes.block_class(
        F.col("x0"), F.col("x1"), (F.col("y0") + F.col("y1")) / 2, F.lit(WIDTH), F.lit(HEIGHT), equation=F.col("text").contains("="), n_chars=F.length("text"), list_share=F.lit(0.0), n_lines=F.lit(1),
        first_line=F.col("text"), max_size=F.col("size"), body_size=F.lit(10.0), bold=F.col("bold"),
    )
    return elements(spark, sf_dir).select("doc_id", "page", "element_id", c.alias("block_class"))


@query(f"""WITH {ELEMENTS}, c AS (SELECT doc_id, size AS s, count(*) AS n FROM e GROUP BY ALL), b AS (SELECT doc_id, s AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS k FROM c) WHERE k = 1),
z AS (SELECT doc_id, page, round(size * 2) / 2 AS s, sum(length(text)) AS n, min(place) AS f FROM e GROUP BY ALL), w AS (SELECT doc_id, page, s AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, f) AS k FROM z) WHERE k = 1)
SELECT w.doc_id, w.page, weighted, body_size, (SELECT count(*) FROM c WHERE c.doc_id = b.doc_id AND c.s > b.body_size + 1.5) AS n_heading_sizes FROM w JOIN b USING (doc_id)""")
def q38_body_and_heading_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return blocks.body_size(e).withColumnRenamed("body_size", "weighted").join(blocks.heading_sizes(e), "doc_id").select("doc_id", "page", "weighted", "body_size", F.size("sizes").cast("long").alias("n_heading_sizes"))


_LIST = "^\\s*(?:[क-ह][.)]\\s|\\([क-ह]\\)\\s|[०-९]+[.)]\\s|[0-9]+[.)]\\s|[a-zA-Z][.)]\\s|\\([a-zA-Z]\\)\\s|\\([0-9]+\\)\\s|[ivxIVX]+[.)]\\s|\\([ivxIVX]+\\)\\s|[-•●○▪▸►]\\s)"
_NESTED = "^\\s*(?:[0-9]+\\.[0-9]+[.)]\\s|[0-9]+\\.[0-9]+\\.[0-9]+[.)]\\s|\\([a-z]\\)\\s|\\([ivx]+\\)\\s)"
_ELEMENT_CAPTION = "(?i)^(?:(?:Figure|Fig\\.?|Table|Chart|Graph|Diagram|Map|Photo|Image)\\s*[0-9]|\\s*[०-९0-9]|(?:Source|:|Note|Reference|)\\s*:)"


_CLASS = f"""CASE WHEN text = '' THEN 'empty' WHEN size / 10 >= 1.6 THEN 'heading_1' WHEN size / 10 >= 1.3 THEN 'heading_2' WHEN size / 10 >= 1.1 AND bold THEN 'heading_3'
   WHEN bold AND length(text) < 100 AND NOT regexp_matches(text, '[.।]$') THEN 'heading_3' WHEN regexp_matches(text, {sql.q(_NESTED)}) OR regexp_matches(text, {sql.q(_LIST)}) THEN 'list_item'
   WHEN regexp_matches(text, {sql.q(_ELEMENT_CAPTION)}) THEN 'caption' WHEN regexp_matches(text, '[=<>]') AND length(regexp_replace(text, '[^=<>]', '', 'g')) / length(text) > 0.15 THEN 'equation' ELSE 'paragraph' END"""
_LEVEL = """CASE WHEN regexp_matches(text, '^[0-9]+\\.[0-9]+\\.[0-9]+') THEN 3 WHEN regexp_matches(text, '^[0-9]+\\.[0-9]+') OR regexp_matches(text, '^\\([a-z]\\)') THEN 2 ELSE 1 END"""


@query(f"""WITH {ELEMENTS} SELECT element_id, {_CLASS} AS element_class, {_LEVEL} AS list_level,
  trim(CASE WHEN regexp_matches(text, {sql.q(_LIST)}) THEN regexp_extract(text, {sql.q(_LIST)}) ELSE regexp_extract(text, {sql.q(_NESTED)}) END) AS marker FROM e""")
def q39_element_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return elements(spark, sf_dir).select("element_id", classes.element_class(t, F.col("size"), F.lit(10.0), F.col("bold")).alias("element_class"), classes.list_level(t).alias("list_level"), classes.list_marker(t).alias("marker"))


@query(f"""WITH {ELEMENTS}, y AS (SELECT element_id, text, size, (y0 + y1) / 2 / 800 AS r, regexp_matches(text, '(?i)^(page|p\\.?|pag)\\s*[0-9]+$') AS num FROM e),
p AS (SELECT element_id, CASE WHEN r < 0.08 THEN 0.7 WHEN r > 0.80 THEN 0.0 ELSE 0.05 END + CASE WHEN length(text) < 50 AND r < 0.1 THEN 0.15 ELSE 0 END + 0.2 + CASE WHEN size > 13 THEN 0.1 ELSE 0 END AS h,
  CASE WHEN r < 0.08 THEN 0.0 WHEN r > 0.92 THEN 0.6 WHEN r > 0.80 THEN 0.2 ELSE 0.05 END + CASE WHEN length(text) < 50 AND r > 0.9 THEN 0.15 ELSE 0 END AS f,
  CASE WHEN num THEN 0.1 WHEN r < 0.08 THEN 0.2 WHEN r > 0.92 THEN 0.15 WHEN r > 0.80 THEN 0.4 ELSE 0.85 END AS b, CASE WHEN num THEN 0.85 WHEN r > 0.92 THEN 0.2 ELSE 0 END AS n,
  CASE WHEN r > 0.80 AND r <= 0.92 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '^[0-9*]+[.)]\\s') THEN CASE WHEN r > 0.7 THEN 0.5 ELSE 0.3 END ELSE 0 END AS t FROM y)
SELECT CASE WHEN h >= f AND h >= b AND h >= n AND h >= t THEN 'header' WHEN f >= b AND f >= n AND f >= t THEN 'footer' WHEN b >= n AND b >= t THEN 'body' WHEN n >= t THEN 'page_number' ELSE 'footnote' END AS zone, count(*) AS n FROM p GROUP BY ALL""")
def q40_zone_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest zone of each element, the first of equals."""
    p = classes.zone_probabilities(F.col("text"), (F.col("y0") + F.col("y1")) / 2 / HEIGHT, F.col("size"))
    rows = elements(spark, sf_dir).select(p.alias("p"))
    names = ("header", "footer", "body", "page_number", "footnote")
    best = F.greatest(*(F.col(f"p.{n}") for n in names))
    zone = F.coalesce(*(F.when(F.col(f"p.{n}") >= best - 1e-12, n) for n in names))
    return rows.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"))


_BOXES = f"""WITH {ELEMENTS}, big AS (SELECT * FROM e WHERE kind IN ('table', 'figure', 'image')), small AS (SELECT * FROM e WHERE kind NOT IN ('table', 'figure', 'image')),
o AS (SELECT s.doc_id, s.page, s.element_id, max(greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) * greatest(0, least(s.y1, b.y1) - greatest(s.y0, b.y0)) / greatest((s.x1 - s.x0) * (s.y1 - s.y0), 1)) AS r
  FROM small s JOIN big b ON s.doc_id = b.doc_id AND s.page = b.page GROUP BY ALL)"""


def _big_small(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, big = elements(spark, sf_dir), F.col("kind").isin("table", "figure", "image")
    return e.where(~big), e.where(big)


@query(f"{_BOXES} SELECT doc_id, page, element_id FROM o WHERE r > 0.3")
def q41_covered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, big = _big_small(spark, sf_dir)
    return blocks.overlapping(small, big, 0.3).select("doc_id", "page", "element_id")


@query(f"{_BOXES} SELECT s.doc_id, s.page, s.element_id FROM small s LEFT JOIN o USING (doc_id, page, element_id) WHERE coalesce(r, 0) <= 0.35")
def q42_uncovered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, big = _big_small(spark, sf_dir)
    return blocks.overlapping(small, big, 0.35, "left_anti").select("doc_id", "page", "element_id")


# Classes of blocks from the one that prevails over all others.
_BEFORE = ("table", "qr_code", "barcode", "signature", "stamp", "formula", "chart", "figure", "image", "handwriting", "header", "footer", "heading", "list", "caption", "margin_note", "paragraph")


@query(f"""WITH RECURSIVE {ELEMENTS}, p AS (SELECT *, list_position([{", ".join(sql.q(k) for k in _BEFORE)}], kind) AS turn FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY turn, confidence DESC, element_id) AS n FROM p),
f(doc_id, page, n, kept) AS (SELECT doc_id, page, 0, CAST([] AS STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, turn BIGINT)[]) FROM e GROUP BY ALL
  UNION ALL SELECT doc_id, page, n, CASE WHEN len(list_filter(kept, lambda o: least(x1, o.x1) > greatest(x0, o.x0) AND least(y1, o.y1) > greatest(y0, o.y0) AND (
    (least(x1, o.x1) - greatest(x0, o.x0)) * (least(y1, o.y1) - greatest(y0, o.y0)) > 0.55 * ((x1 - x0) * (y1 - y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - (least(x1, o.x1) - greatest(x0, o.x0)) * (least(y1, o.y1) - greatest(y0, o.y0)))
    OR ((least(x1, o.x1) - greatest(x0, o.x0)) * (least(y1, o.y1) - greatest(y0, o.y0)) > 0.65 * (x1 - x0) * (y1 - y0) AND o.turn <= turn)))) > 0 THEN kept
    ELSE list_append(kept, {{'id': element_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'turn': turn}}) END
  FROM (SELECT b.*, f.kept FROM f JOIN b ON b.doc_id = f.doc_id AND b.page = f.page AND b.n = f.n + 1)),
last AS (SELECT doc_id, page, unnest(kept) AS o FROM (SELECT doc_id, page, arg_max(kept, n) AS kept FROM f GROUP BY ALL))
SELECT doc_id, page, o.id AS block_id, format('p{{:03d}}_b{{:03d}}', page, row_number() OVER (PARTITION BY doc_id, page ORDER BY o.y0, o.x0, o.id)) AS name FROM last""")
def q43_prevailing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir).withColumnRenamed("element_id", "block_id")
    return blocks.block_ids(blocks.prevailing(e)).select("doc_id", "page", "block_id", "name")


PAGES_SQL = f"""pg AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text, 1 + doc_id % 3 AS n_columns, doc_id % 5 = 0 AS unbalanced, doc_id % 4 AS tables, CASE WHEN doc_id % 4 > 1 THEN 1 ELSE 0 END AS empty_tables, CASE WHEN doc_id % 4 > 2 THEN 1 ELSE 0 END AS uneven_tables, doc_id % 6 = 0 AS has_legacy FROM {VOLUMES}),
sc AS (SELECT doc_id, page, tables, empty_tables, has_legacy, text,
  CASE WHEN NOT regexp_matches(text, '\\S') THEN 0.0 ELSE 100.0 - CASE WHEN regexp_matches(text, '(?i)undefined|NaN|\\[object|function\\s*\\(') THEN 30 ELSE 0 END - CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 20 ELSE 0 END END AS extraction,
  CASE WHEN n_columns > 1 THEN CASE WHEN unbalanced THEN 70.0 ELSE 85.0 END ELSE 95.0 END AS layout, CASE WHEN tables = 0 THEN 100.0 ELSE greatest(0.0, 80.0 - 20.0 * empty_tables - 10.0 * uneven_tables) END AS table_score,
  CASE WHEN NOT regexp_matches(text, '\\S') THEN 0.0 ELSE 100.0 - CASE WHEN has_legacy THEN 30 ELSE 0 END END AS encoding FROM pg)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of volumes with made-up columns and tables."""
    k = F.col("id")
    return volumes(spark, sf_dir, "text").select(
        "doc_id", "page", "text", (1 + k % 3).alias("n_columns"), (k % 5 == 0).alias("unbalanced"), (k % 4).alias("tables"),
        F.when(k % 4 > 1, 1).otherwise(0).alias("empty_tables"), F.when(k % 4 > 2, 1).otherwise(0).alias("uneven_tables"), (k % 6 == 0).alias("has_legacy"),
    )


@query(f'WITH {PAGES_SQL} SELECT doc_id, page, CAST(extraction AS DOUBLE) AS extraction, CAST(layout AS DOUBLE) AS layout, CAST(table_score AS DOUBLE) AS table_score, CAST(encoding AS DOUBLE) AS encoding FROM sc')
def q44_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.page_scores(pages(spark, sf_dir)).select("doc_id", "page", "extraction", "layout", F.col("table").alias("table_score"), "encoding")


@query(f"""WITH {PAGES_SQL}, o AS (SELECT doc_id, page, CAST(round(100 * (0.35 * extraction + 0.25 * layout + 0.25 * encoding + 0.15 * table_score)) AS BIGINT) AS c FROM sc)
SELECT doc_id, count(*) AS n_pages, CAST(sum(c) AS BIGINT) AS overall_hundredths, CAST(min(c) AS BIGINT) AS least_hundredths, count(*) FILTER (c < 6000) AS n_low FROM o GROUP BY doc_id""")
def q45_document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = documents.page_scores(pages(spark, sf_dir))
    hundredths = F.round(F.col("overall") * 100).cast("long")
    return scores.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(hundredths).alias("overall_hundredths"), F.min(hundredths).alias("least_hundredths"), F.count_if(hundredths < 6000).alias("n_low"))


@query(f"""WITH {PAGES_SQL}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 5) AS empty_pages, sum({sql.visible('text')}) AS chars, bool_or(has_legacy) AS legacy, sum(empty_tables) AS et FROM sc GROUP BY doc_id)
SELECT doc_id, n >= n + length(doc_id) % 2 AS page_count, empty_pages = 0 AS empty_pages_ok, 100 - CASE WHEN legacy AND chars > 0 THEN 20 ELSE 0 END AS quality, et = 0 AS table_quality, chars / (n + length(doc_id) % 2) >= 50 AS text_density FROM s""")
def q46_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    scored = p.join(documents.page_scores(p).select("doc_id", "page", "overall"), ["doc_id", "page"])
    expected = p.groupBy("doc_id").agg((F.count("*") + F.length("doc_id") % 2).alias("expected_pages"))
    report = documents.validation_report(scored, expected)
    return report.select("doc_id", "page_count", F.col("no_empty_pages").alias("empty_pages_ok"), "quality", "table_quality", "text_density")


CANDIDATES_SQL = f"""WITH cd AS (SELECT doc_id, 1 AS page, 'raw' AS source, 0 AS place, text, CAST(doc_id % 101 AS DOUBLE) AS score FROM documents
 UNION ALL SELECT doc_id, 1, 'upper', 1, upper(text), CAST((doc_id * 7) % 103 AS DOUBLE) FROM documents UNION ALL SELECT doc_id, 1, 'head', 2, substr(text, 1, 40), CAST((doc_id * 13) % 97 AS DOUBLE) FROM documents)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as read by three engines, with made-up scores."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    one = lambda name, place, t, score: d.select("doc_id", F.lit(1).alias("page"), F.lit(name).alias("source"), F.lit(place).alias("place"), t.alias("text"), score.cast("double").alias("score"))
    return one("raw", 0, F.col("text"), k % 101).union(one("upper", 1, F.upper("text"), k * 7 % 103)).union(one("head", 2, F.substring("text", 1, 40), k * 13 % 97))


@query(f"{CANDIDATES_SQL} SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM cd) WHERE k = 1")
def q47_best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.best_candidates(candidates(spark, sf_dir)).select("doc_id", "source", "score")


@query(f"""{CANDIDATES_SQL}, w AS (SELECT doc_id, place, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM cd),
m AS (SELECT a.doc_id, max(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))) AS r FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.place < b.place WHERE len(a.w) > 0 AND len(b.w) > 0 GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(r >= 0.8, false) AS agreed FROM documents d LEFT JOIN m USING (doc_id)""")
def q48_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.consensus(candidates(spark, sf_dir)).select("doc_id", "agreed")


@query(f"""{CANDIDATES_SQL} SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN score >= 75 THEN 0 ELSE 1 END, CASE WHEN score >= 75 THEN place ELSE -score END, place) AS k FROM cd) WHERE k = 1""")
def q49_repair_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.first_good(candidates(spark, sf_dir)).select("doc_id", "source", "score")


@query(f"""WITH g AS (SELECT source, doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM {VOLUMES})
SELECT source AS doc_id, length(regexp_replace(regexp_replace(string_agg(repeat('═', 60) || chr(10) || '  PAGE ' || k || ' / ' || n || chr(10) || repeat('═', 60) || chr(10) || chr(10) || t || chr(10), chr(10) ORDER BY k), '^\\s+|\\s+$', '', 'g'), chr(10) || '{{4,}}', chr(10) || chr(10) || chr(10), 'g')) + 1 AS n_chars, max(n) AS n_pages FROM g GROUP BY source""")
def q51_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes as text files with a banner for each page: how long they are."""
    p = volumes(spark, sf_dir, "text").select("doc_id", "page", "text", F.lit(90.0).alias("confidence"))
    files = documents.joined_pages(p)
    return documents.text_files(files).join(files.select("doc_id", "n_pages"), "doc_id").select("doc_id", F.length("content").cast("long").alias("n_chars"), "n_pages")


@query("""WITH RECURSIVE rq AS (SELECT user_id AS client, event_id AS request_id, epoch_us(ts) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
f AS (SELECT client, request_id, k, [seen] AS live, true AS ok FROM rq WHERE k = 1
 UNION ALL SELECT r.client, r.request_id, r.k, CASE WHEN len(list_filter(f.live, lambda t: r.seen - t <= 36000000000)) < 5 THEN list_append(list_filter(f.live, lambda t: r.seen - t <= 36000000000), r.seen) ELSE list_filter(f.live, lambda t: r.seen - t <= 36000000000) END,
  len(list_filter(f.live, lambda t: r.seen - t <= 36000000000)) < 5 FROM f JOIN rq r ON r.client = f.client AND r.k = f.k + 1)
SELECT client, request_id, ok AS admitted FROM f""")
def q55_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: five within ten hours, so that the limit bites."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return admission.admitted(e, 5, 36_000_000_000).select("client", "request_id", "admitted")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q56_stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, counted by the hour; the stream ends when all files are read."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streams.windowed_counts(stream, window="1 hour", late="36500 days")
    folder = stored_folder(spark)
    # The counts so far replace those before; nothing comes to the driver.
    q = counts.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(folder)).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(folder).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"""WITH {ELEMENTS}, t AS (SELECT doc_id, page, element_id, y0, y1, CAST(element_id % 3 + 1 AS INTEGER) AS nc FROM e)
SELECT a.doc_id, a.page, a.element_id AS table_id, b.element_id AS next_table_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.page = a.page + 1 AND a.nc = b.nc WHERE a.y1 >= 560 AND b.y0 <= 160""")
def q58_table_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = elements(spark, sf_dir).select("doc_id", "page", F.col("element_id").alias("table_id"), "y0", "y1", (F.col("element_id") % 3 + 1).cast("int").alias("n_columns"))
    return crosspage.continued_tables(t, HEIGHT)


@query(f"""WITH {ELEMENTS} SELECT DISTINCT t.doc_id, t.page, t.element_id FROM e t JOIN e f ON t.doc_id = f.doc_id AND t.page = f.page AND f.kind IN ('figure', 'image', 'chart')
WHERE regexp_matches(t.text, {sql.q(_CAPTION)}) AND t.y0 >= f.y1 - 5 AND t.y0 < f.y1 + 80 AND greatest(0, least(t.x1, f.x1) - greatest(t.x0, f.x0)) / greatest(least(t.x1 - t.x0, f.x1 - f.x0), 1) > 0.3""")
def q59_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return blocks.captions(e, e.where(F.col("kind").isin("figure", "image", "chart"))).select("doc_id", "page", "element_id")


@query(f"""WITH {ELEMENTS}, r AS (SELECT element_id, kind, element_id % 2 = 0 AS ct, element_id % 3 = 0 AS ci, (['unicode', 'legacy', 'mixed', 'unknown'])[element_id % 4 + 1] AS enc, element_id % 5 = 0 AS hl,
  regexp_matches(lower(([{", ".join(sql.q(f) for f in FONTS)}])[element_id % {len(FONTS)} + 1]), {sql.q('|'.join(legacy.LEGACY_FONTS))}) AS lf FROM e)
SELECT CASE WHEN kind = 'signature' THEN 'placeholder_signature' WHEN kind = 'qr_code' THEN 'qr_decode' WHEN kind = 'figure' THEN 'placeholder_figure' WHEN kind = 'chart' THEN 'placeholder_chart' WHEN kind = 'formula' THEN 'skipped'
  WHEN enc = 'mixed' THEN 'pdf_extraction' WHEN ct AND NOT ci AND (enc = 'unicode' OR (NOT lf AND NOT hl)) THEN 'pdf_extraction' WHEN hl OR lf THEN 'legacy_conversion'
  WHEN ci AND NOT ct AND kind <> 'stamp' THEN 'ocr' WHEN kind = 'table' THEN 'table_extraction' WHEN kind = 'stamp' THEN 'placeholder_stamp' WHEN kind = 'image' THEN 'placeholder_image' WHEN ct THEN 'pdf_extraction' ELSE 'skipped' END AS route, count(*) AS n FROM r GROUP BY ALL""")
def q60_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("element_id")
    font = F.get(F.array(*(F.lit(f) for f in FONTS)), (k % len(FONTS)).cast("int"))
    encoding = F.get(F.array(*(F.lit(x) for x in ("unicode", "legacy", "mixed", "unknown"))), (k % 4).cast("int"))
    r = classes.route(F.col("kind"), contains_text=k % 2 == 0, contains_image=k % 3 == 0, contains_table=F.lit(False), encoding=encoding, mixed=F.lit(False), has_legacy=k % 5 == 0, has_unicode=F.lit(False), legacy_font=legacy.is_legacy_font(font))
    return elements(spark, sf_dir).groupBy(r.alias("route")).agg(F.count("*").alias("n"))


@query(f"""WITH pg AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, CASE doc_id % 3 WHEN 0 THEN 'direct_unicode' WHEN 1 THEN 'direct_legacy' ELSE 'no_text' END AS m, n_chars FROM {VOLUMES})
SELECT doc_id, CAST((page - 1) // 50 + 1 AS BIGINT) AS batch, count(*) AS n_pages, count(*) FILTER (m = 'direct_unicode') AS direct_unicode, count(*) FILTER (m = 'direct_legacy') AS direct_legacy, count(*) FILTER (m = 'no_text') AS no_text, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM pg GROUP BY ALL""")
def q61_page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    p = volumes(spark, sf_dir, "n_chars").select("doc_id", "page", F.when(k == 0, "direct_unicode").when(k == 1, "direct_legacy").otherwise("no_text").alias("method"), F.col("n_chars").alias("char_count"))
    return documents.method_counts(p)


@query("""SELECT doc_id, CAST(CASE WHEN NOT regexp_matches(text, '\\S') THEN 0 ELSE floor(least(30, length(text) / 100) * 1000) END AS BIGINT) AS length_part, length(text) > 0 AS has_text FROM documents""")
def q62_engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", quality.engine_score(F.col("text")).alias("s"))
    return rows.select("doc_id", F.when(stripped(F.col("text")) == "", 0).otherwise(F.floor(F.least(F.lit(30.0), F.length("text") / 100) * 1000)).alias("length_part"), (F.col("s").isNotNull() & (F.length("text") > 0)).alias("has_text"))


@query(f"""WITH {ELEMENTS}, c AS (SELECT doc_id, page, (x0 + x1) / 2 - lag((x0 + x1) / 2) OVER (PARTITION BY doc_id, page ORDER BY (x0 + x1) / 2) AS gap, x0, x1, y0, y1 FROM e)
SELECT doc_id, page, CAST(CASE WHEN count(*) < 3 THEN 1 ELSE least(3, count(*) FILTER (gap > 108) + 1) END AS INTEGER) AS columns_, min(x0) AS left_, max(x1) AS right_, min(y0) AS top_, max(y1) AS bottom_ FROM c GROUP BY ALL""")
def q63_columns_and_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    both = blocks.column_count(e, WIDTH).join(blocks.margins(e), ["doc_id", "page"])
    return both.select("doc_id", "page", F.col("columns").cast("int").alias("columns_"), F.col("left").alias("left_"), F.col("right").alias("right_"), F.col("top").alias("top_"), F.col("bottom").alias("bottom_"))


@query(f"""WITH {ELEMENTS}, c AS (SELECT *, {_CLASS} AS class, {_LEVEL} AS level, CASE WHEN (y0 + y1) / 2 <= 64 THEN 0 WHEN (y0 + y1) / 2 >= 736 THEN 3 ELSE 1 END AS section FROM e),
p AS (SELECT *, CASE WHEN section = 0 THEN '[HEADER] ' || text WHEN section = 3 THEN '[FOOTER] ' || text WHEN starts_with(class, 'heading_') THEN repeat('#', CAST(substr(class, 9, 1) AS INTEGER)) || ' ' || text
  WHEN class = 'list_item' THEN repeat('  ', level - 1) || text ELSE text END AS piece FROM c WHERE regexp_matches(text, '\\S'))
SELECT doc_id, page, string_agg(piece, chr(10) ORDER BY section, y0, piece) AS text FROM p GROUP BY ALL""")
def q64_serialized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    zone = classes.zone((F.col("y0") + F.col("y1")) / 2, F.lit(HEIGHT))
    kind = classes.element_class(F.col("text"), F.col("size"), F.lit(10.0), F.col("bold"))
    rows = e.select("doc_id", "page", zone.alias("section"), F.col("y0").alias("place"), kind.alias("kind"), classes.list_level(F.col("text")).alias("level"), "text")
    return documents.serialized(rows)
