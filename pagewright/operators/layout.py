"""Words and spans with places: rows, columns, reading order, and tables without rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEVANAGARI, stripped


def is_noise(text: Column, conf: Column, least: float = 45.0) -> Column:
    """Whether a recognised word is a stray mark; Devanagari words may be less certain."""
    deva = text.rlike(f"[{DEVANAGARI}]")
    bound = F.when(deva, F.greatest(F.lit(28.0), F.lit(least - 15.0))).otherwise(F.lit(least))
    return (text == "") | text.rlike(r"\A[_|\[\]\\/=\-]+\z") | ((conf < bound) & (F.length(text) < 3)) | (~deva & (conf < 60) & text.rlike(r"\A[a-zA-Z&@#]+\z") & (F.length(text) < 4))


def words_of(tsv: DataFrame, least: float = 45.0) -> DataFrame:
    """doc_id, place, text, conf, x0, y0, x1, y1 of recognition's parallel arrays, without noise."""
    z = F.arrays_zip("text", "conf", "left", "top", "width", "height")
    each = tsv.select("doc_id", F.posexplode(z).alias("place", "w")).select("doc_id", "place", F.trim("w.text").alias("text"), F.col("w.conf").cast("double").alias("conf"), F.col("w.left").cast("double").alias("x0"), F.col("w.top").cast("double").alias("y0"), (F.col("w.left") + F.col("w.width")).cast("double").alias("x1"), (F.col("w.top") + F.col("w.height")).cast("double").alias("y1"))
    return each.where(~is_noise(F.col("text"), F.col("conf"), least))


def with_rows(words: DataFrame, ratio: float = 0.6) -> DataFrame:
    """words with row: a new one where the middle moves by ratio of the word before's height."""
    w = Window.partitionBy("doc_id").orderBy("y0", "x0", "text")
    middle, height = (F.col("y0") + F.col("y1")) / 2, F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    new = F.coalesce((F.abs(middle - F.lag(middle).over(w)) >= F.lag(height).over(w) * ratio).cast("int"), F.lit(0))
    return words.withColumn("_new", new).withColumn("row", F.sum("_new").over(w)).drop("_new")


def row_texts(words: DataFrame, ratio: float = 1.5) -> DataFrame:
    """doc_id, row, line: words of a row from left to right, a tab where the gap is over ratio of the height before."""
    w = Window.partitionBy("doc_id", "row").orderBy("x0", "text")
    gap = F.col("x0") - F.lag("x1").over(w)
    height = F.lag(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).over(w)
    piece = F.when(gap.isNull(), F.col("text")).when(gap > height * ratio, F.concat(F.lit("\t"), "text")).otherwise(F.concat(F.lit(" "), "text"))
    placed = words.withColumn("_piece", piece).withColumn("_k", F.row_number().over(w))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_piece"))), lambda x: x["_piece"]), "")
    return placed.groupBy("doc_id", "row").agg(line.alias("line"))


def layout_text(words: DataFrame) -> DataFrame:
    """doc_id, text of words with places."""
    rows = row_texts(with_rows(words))
    return rows.groupBy("doc_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")).alias("text"))


def ruled_tables(words: DataFrame, rulings: DataFrame, thin: float = 3.0) -> DataFrame:
    """doc_id, page, row, column, text: the cells between a page's ruling lines that hold words (doc_id, page, text, x0, y0, x1, y1).

    rulings: (doc_id, page, x0, y0, x1, y1); those up to thin wide are upright,
    those up to thin high level. Lines nearer than thin are one. A page needs
    two of either for a table; a word belongs where its middle is.
    """
    upright, level = F.col("x1") - F.col("x0") <= thin, F.col("y1") - F.col("y0") <= thin
    none = F.array().cast("array<double>")
    apart = lambda xs: F.aggregate(xs, none, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= thin), F.concat(kept, F.array(x))).otherwise(kept))
    ends = lambda hit, c: apart(F.array_sort(F.collect_set(F.when(hit, F.col(c)))))
    grid = rulings.groupBy("doc_id", "page").agg(ends(upright, "x0").alias("xs"), ends(level & ~upright, "y0").alias("ys")).where((F.size("xs") > 1) & (F.size("ys") > 1))
    place = lambda ends_, middle: F.size(F.filter(ends_, lambda e: e <= middle))
    placed = words.join(grid, ["doc_id", "page"]).withColumn("row", place("ys", (F.col("y0") + F.col("y1")) / 2)).withColumn("column", place("xs", (F.col("x0") + F.col("x1")) / 2))
    inside = placed.where((F.col("row") >= 1) & (F.col("row") < F.size("ys")) & (F.col("column") >= 1) & (F.col("column") < F.size("xs")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ")
    return inside.groupBy("doc_id", "page", "row", "column").agg(text.alias("text"))


def joined_spans(spans: DataFrame, tab: float = 50.0, space: float = 5.0, from_start: bool = False) -> DataFrame:
    """doc_id, page, block, line, text: a line's spans joined by their gaps, to a tab, a space or nothing.

    The gap is counted from the end of the span before, or from its start
    where from_start says so, as text of single blocks is joined.
    """
    w = Window.partitionBy("doc_id", "page", "block", "line").orderBy("span")
    gap = F.col("x0") - F.lag("x0" if from_start else "x1").over(w)
    piece = F.when(gap > tab, F.concat(F.lit("\t"), "text")).when(gap > space, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "piece"))), lambda x: x["piece"]), "")
    return spans.withColumn("piece", piece).groupBy("doc_id", "page", "block", "line").agg(text.alias("text"))


def characters_text(characters: DataFrame) -> DataFrame:
    """doc_id, page, text: characters (doc_id, page, block, line, place, c) put together by line, lines trimmed, empty ones dropped."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]), "")
    lines = characters.where("c <> ''").groupBy("doc_id", "page", "block", "line").agg(stripped(joined).alias("text")).where("text <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("doc_id", "page").agg(text.alias("text"))


def projection(elements: DataFrame, width: float, bins: int = 200) -> DataFrame:
    """doc_id, page, bin, density: heights summed over the bins that elements cover."""
    step = width / bins
    first, last = F.greatest(F.lit(0), F.floor(F.col("x0") / step)), F.least(F.lit(bins - 1), F.floor(F.col("x1") / step))
    return elements.where(first <= last).select("doc_id", "page", F.explode(F.sequence(first, last)).alias("bin"), (F.col("y1") - F.col("y0")).alias("h")).groupBy("doc_id", "page", "bin").agg(F.sum("h").alias("density"))


def gaps(profile: DataFrame, bins: int = 200, least: int = 3) -> DataFrame:
    """doc_id, page, start, stop: runs of at least that many empty bins."""
    pages = profile.select("doc_id", "page").distinct()
    all_bins = pages.select("doc_id", "page", F.explode(F.expr(f"sequence(0L, {bins - 1}L)")).alias("bin"))
    empty = all_bins.join(profile.where("density >= 0.1"), ["doc_id", "page", "bin"], "left_anti")
    island = empty.withColumn("i", F.col("bin") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("bin")))
    return island.groupBy("doc_id", "page", "i").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("stop")).where(F.col("stop") - F.col("start") >= least).select("doc_id", "page", "start", "stop")


def columns_of(elements: DataFrame, width: float, bins: int = 200) -> DataFrame:
    """doc_id, page, column, x0, x1: text columns between wide gaps that aren't margins; one column if there are none or too many.

    A column is at least 15 % of the width and holds 8 % of the elements.
    """
    body = elements.where((F.col("y1") - F.col("y0") > 5) & (F.col("x1") - F.col("x0") > width * 0.05))
    step = width / bins
    least = max(2, int(width * 0.03 / step))
    wide = gaps(projection(body, width, bins), bins, least).where((F.col("start") * step >= width * 0.05) & (F.col("stop") * step <= width * 0.95) & ((F.col("stop") - F.col("start")) * step >= width * 0.03))
    cuts = wide.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list((F.col("start") + F.col("stop")) * step / 2)).alias("cuts"))
    ends = body.groupBy("doc_id", "page").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi")).join(cuts, ["doc_id", "page"], "left")
    none = F.array().cast("array<double>")
    inner = F.when(F.size("cuts").between(1, 4), F.col("cuts")).otherwise(none)
    ends = ends.withColumn("edges", F.concat(F.array(F.col("lo").cast("double")), inner, F.array(F.col("hi").cast("double"))))
    pieces = ends.select("doc_id", "page", "lo", "hi", F.explode(F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: F.struct(F.get("edges", i).alias("x0"), F.get("edges", i + 1).alias("x1"), (F.size("edges") == 2).alias("only")))).alias("c")).select("doc_id", "page", "lo", "hi", "c.*").where((F.col("x1") - F.col("x0") >= width * 0.15) | F.col("only"))
    centres = body.select("doc_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"))
    held = pieces.join(centres, ["doc_id", "page"]).groupBy("doc_id", "page", "lo", "hi", "x0", "x1").agg(F.count_if(F.col("cx").between(F.col("x0") - 5, F.col("x1") + 5)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id", "page"))
    kept = held.withColumn("total", total).where((F.col("n") >= F.greatest(F.lit(1.0), F.col("total") * 0.08)) | (F.col("total") == 0))
    return kept.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("x0")) - 1).alias("column"), "x0", "x1")


def reading_order(elements: DataFrame, columns: DataFrame) -> DataFrame:
    """elements with column and reading_order from 0.

    Elements as wide as 70 % of all columns part the page into bands. In a
    band columns are read one after the other; what begins beside a wide
    element comes right after it, from the top.
    """
    span = columns.groupBy("doc_id", "page").agg((F.max("x1") - F.min("x0")).alias("span"), F.count("*").alias("k"))
    e = elements.join(span, ["doc_id", "page"], "left").withColumn("wide", (F.col("k") > 1) & (F.col("x1") - F.col("x0") >= F.col("span") * 0.7))
    centre = (F.col("x0") + F.col("x1")) / 2
    cols = columns.select("doc_id", "page", "column", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    inside = e.join(cols, ["doc_id", "page"], "left").withColumn("hit", F.when(centre.between(F.col("c0") - 5, F.col("c1") + 5), F.col("column")))
    keys = elements.columns
    e = inside.groupBy(*keys, "k", "wide").agg(F.coalesce(F.min("hit"), F.lit(0)).alias("column"))
    w = Window.partitionBy("doc_id", "page").orderBy("y0", F.col("wide").cast("int").desc(), "x0", "element_id")
    e = e.withColumn("band", F.count_if("wide").over(w)).withColumn("under", F.max(F.when(F.col("wide"), F.col("y1"))).over(w))
    beside = ~F.col("wide") & (F.col("k") > 1) & F.coalesce(F.col("y0") < F.col("under"), F.lit(False))
    rank = F.when(F.coalesce("k", F.lit(1)) <= 1, 2).when(F.col("wide"), 0).when(beside, 1).otherwise(2)
    column = F.when((F.coalesce("k", F.lit(1)) > 1) & (rank == 2), F.col("column")).otherwise(0)
    order = Window.partitionBy("doc_id", "page").orderBy("band", rank, column, "y0", "x0", "element_id")
    return e.select(*keys, F.when(F.coalesce("k", F.lit(1)) > 1, F.col("column")).otherwise(0).alias("column"), (F.row_number().over(order) - 1).alias("reading_order"))


def anchored_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page, line, words: a line holds what starts within tolerance of its first word's top.

    That depends on the line's first word, not on the word before, so a
    page's sorted words are folded once; pages are bounded by what they show.
    """
    word = F.struct(F.bround(F.col("y0") / tolerance).alias("k"), F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), "text")
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    kind = "struct<anchor:double,line:int,out:array<struct<line:int,x0:double,y0:double,x1:double,y1:double,text:string>>>"

    def step(acc, w):
        new = acc["anchor"].isNull() | (F.abs(w["y0"] - acc["anchor"]) > tolerance)
        line = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        item = F.struct(line.alias("line"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["text"].alias("text"))
        return F.struct(F.when(new, w["y0"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(item)).alias("out"))

    start = F.expr(f"cast(named_struct('anchor', null, 'line', -1, 'out', array()) as {kind})")
    folded = pages.select("doc_id", "page", F.explode(F.aggregate("ws", start, step)["out"]).alias("w")).select("doc_id", "page", "w.*")
    return folded.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text"))).alias("words"))


def column_bounds(words: Column, least: float = 24.0) -> Column:
    """Middles of the gaps of at least that width between the words of a line."""
    pairs = F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("a"), F.slice(words, 2, F.size(words)).alias("b"))
    wide = F.filter(pairs, lambda p: p["b"]["x0"] - p["a"]["x1"] >= least)
    return F.when(F.size(words) > 1, F.transform(wide, lambda p: (p["a"]["x1"] + p["b"]["x0"]) / 2)).otherwise(F.array().cast("array<double>"))


def cells(words: Column, bounds: Column) -> Column:
    """The words of a line in the cells that the bounds make."""
    at = lambda w: F.size(F.filter(bounds, lambda b: w["x0"] >= b))
    return F.transform(F.sequence(F.lit(0), F.size(bounds)), lambda i: F.array_join(F.transform(F.filter(words, lambda w: at(w) == i), lambda w: w["text"]), " "))


def borderless_tables(words: DataFrame, tolerance: float = 12.0, least: int = 3) -> DataFrame:
    """doc_id, page, table, line, cells: runs of least lines or more whose gaps agree with those of the run's first line."""
    lines = anchored_lines(words).withColumn("bounds", column_bounds(F.col("words")))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "bounds"))).alias("ls"))
    kind = "struct<run:int,bounds:array<double>,out:array<struct<line:int,run:int,bounds:array<double>>>>"

    def step(acc, x):
        has = F.size(x["bounds"]) > 0
        agrees = has & (F.size(acc["bounds"]) == F.size(x["bounds"])) & F.forall(F.arrays_zip(acc["bounds"].alias("a"), x["bounds"].alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= tolerance)
        run = F.when(agrees, acc["run"]).otherwise(acc["run"] + 1)
        bounds = F.when(agrees, acc["bounds"]).otherwise(x["bounds"])
        item = F.array(F.struct(x["line"].alias("line"), run.alias("run"), bounds.alias("bounds")))
        return F.struct(run.alias("run"), bounds.alias("bounds"), F.when(has, F.concat(acc["out"], item)).otherwise(acc["out"]).alias("out"))

    start = F.expr(f"cast(named_struct('run', 0, 'bounds', array(), 'out', array()) as {kind})")
    runs = pages.select("doc_id", "page", F.explode(F.aggregate("ls", start, step)["out"]).alias("r")).select("doc_id", "page", "r.*")
    long = runs.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page", "run"))).where(F.col("n") >= least)
    numbered = long.withColumn("table", F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("run")) - 1)
    return numbered.drop("n").join(lines.select("doc_id", "page", "line", "words"), ["doc_id", "page", "line"]).select("doc_id", "page", "table", "line", cells(F.col("words"), F.col("bounds")).alias("cells"))


def drawn_table(rows: Column, most: int | None = None, every_row: bool = False) -> Column:
    """Rows of cells as text in a frame; a Devanagari character is two wide. most bounds a column's width."""
    width = lambda c: F.length(c) + F.length(F.regexp_replace(c, f"[^{DEVANAGARI}]+", ""))
    columns = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    bounded = lambda w: w if most is None else F.greatest(F.lit(4), F.least(F.lit(most), w))
    widths = F.transform(F.sequence(F.lit(0), columns - 1), lambda i: bounded(F.array_max(F.transform(rows, lambda r: width(cell(r, i)) + 2))))
    rule = lambda left, mid, right: F.concat(F.lit(left), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("─"), w)), mid), F.lit(right))
    padded = lambda r: F.concat(F.lit("│"), F.array_join(F.transform(widths, lambda w, i: F.concat(F.lit(" "), cell(r, i), F.repeat(F.lit(" "), F.greatest(F.lit(0), w - width(cell(r, i)) - 1)))), "│"), F.lit("│"))
    lines = F.transform(rows, lambda r, i: F.when((F.size(rows) > 1) & ((i == 0) | (F.lit(every_row) & (i < F.size(rows) - 1))), F.concat(padded(r), F.lit("\n"), rule("├", "┼", "┤"))).otherwise(padded(r)))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(F.concat(rule("┌", "┬", "┐"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"), rule("└", "┴", "┘")))
