"""HTML extraction with wrappers inferred for each host.

A page's tags and texts form a token stream: an open tag with its telling
attributes, a close tag, and a text slot "#". Adjacent repeats of a group are
folded to "( group )+". A host's wrapper is a union-free regular expression:
streams are aligned one after another, what doesn't meet becomes an optional
group "( ... )?", and a group that repeats in one stream and stands alone in
the other becomes a repeated one. Equal streams are counted, not aligned, and
large hosts are aligned in bounded shares whose wrappers are aligned again.

The wrapper's text slots are then bound to the host's texts. A block that
stands in the same slot on every page of a host is template, and the others
fill the slots. From the wrapper's root the way leads down to the element that
holds most of the filling text; that is the host's main element. Each page is
read inside it, without its template blocks and without menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments.
Names of elements and class words tell the latter, as these vary from page to
page like the main text does, and which of two nested elements with the same
text is the main one.
"""

from __future__ import annotations

import difflib
import html
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written
from .urls import host_of

#: Streams of a host that one alignment task takes.
SHARE = 200
#: Pages that a host needs for its constant blocks to be template.
LEAST_PAGES = 3
#: Share of an element's filling text that a part of it must hold to be gone into, and that an element without a telling name must hold of the page's.
MOST, NEARLY_ALL = 0.5, 0.9
#: Longest group that is folded when it repeats.
GROUP = 24

# Element names.
RAW = ("script", "style", "template", "noscript", "textarea", "iframe", "svg", "title")
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select option label dialog menu head object audio video canvas".split())
# Elements whose start tag ends open ones that have no end tag, and what that doesn't reach beyond.
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
CELLS = frozenset("table caption td th".split())
HEAD = frozenset("meta link base title style script noscript template".split())
_ROWS, _CELL = frozenset(("thead", "tbody", "tfoot")), frozenset(("td", "th"))
IMPLIED = {
    "li": [(frozenset(("li",)), frozenset("ul ol menu table td th".split()))],
    **dict.fromkeys(("dt", "dd"), [(frozenset(("dt", "dd")), frozenset("dl table td th".split()))]),
    **dict.fromkeys(("td", "th"), [(_CELL, frozenset(("tr", "table")))]),
    "tr": [(frozenset(("tr",)), frozenset(("table",)))],
    **dict.fromkeys(_ROWS, [(_ROWS, frozenset(("table",)))]),
    "option": [(frozenset(("option",)), frozenset(("select",)))],
}
# Words of a class, id or role that tell what isn't main text.
SIDE = frozenset("ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs footer masthead sidebar notice notices alert cookie cookies consent popup modal overlay comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe signup pagination pager toolbar complementary contentinfo search".split())
MAIN_WORDS = frozenset("content article post entry main story body-text maincontent main-content article-body post-content entry-content".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_DIGITS = re.compile(r"\d+")
_TELLING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _telling(rest: str) -> list[str]:
    """The words of a tag's class, id and role; numbers in them, which often differ from page to page, as 0."""
    return [_DIGITS.sub("0", w.lower()) for m in _TELLING.finditer(rest) for w in (m[1] or m[2] or m[3] or "").split()] if rest else []


def _is_side(name: str, words: list[str], in_main: bool, whole: bool = False) -> bool:
    """Whether an element is dropped; whole: by whole words only. A word with a part that tells the main text, as in content-with-sidebar, counts as a whole only."""
    if name in DROPPED or name == "header" and not in_main:
        return True
    if whole:
        return any(w in SIDE for w in words)
    return any(w in SIDE or w not in MAIN_WORDS and not SIDE.isdisjoint(parts) and MAIN_WORDS.isdisjoint(parts) for w in words for parts in [re.split(r"[-_]", w)])


def _tag(name: str, words: list[str]) -> str:
    return ".".join([name, *sorted(words)])


def _stream(tokens: list) -> list[str]:
    out: list[str] = []
    for text, name, words, _ in tokens:
        if name:
            out.append(f"</{name}>" if words is None else f"<{_tag(name, words)}>")
        elif not text.isspace() and (not out or out[-1] != "#"):
            out.append("#")
    return out


def stream(page: str) -> list[str]:
    return _stream(list(_walk(page)))


class Blocks:
    """Gathers texts into blocks, each with the way of open block elements to it."""

    def __init__(self):
        self.found: list[tuple[str, str]] = []
        self.path: list[str] = []
        self.now: list[str] = []
        self.at = ""

    def go(self, level: int, name: str, words: list[str] | None) -> None:
        """A tag, or a text with an empty name, that stands at this level."""
        del self.path[level:]
        if words is not None and name not in VOID:
            self.path.append(_tag(name, words) if name in BLOCKS else "")

    def text(self, text: str) -> None:
        if not self.at and not text.isspace():
            self.at = "/" + "/".join(filter(None, self.path))
        self.now.append(text)

    def close(self) -> None:
        if self.now:
            text = " ".join(html.unescape("".join(self.now)).split())
            if text:
                self.found.append((self.at, text))
            self.now, self.at = [], ""


def _number(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) >> 1


def _outline(tokens: list) -> list[tuple[str, str]]:
    """All blocks of a page, side parts included."""
    out = Blocks()
    for text, name, words, level in tokens:
        if name in BLOCKS:
            out.close()
        out.go(level, name, words)
        if text:
            out.text(text)
        elif name == "br":
            out.text(" ")
    out.close()
    return out.found


def folded(tokens: list[str]) -> list[str]:
    """tokens with adjacent repeats of groups folded, short groups first."""
    for size in range(1, GROUP + 1):
        out, i = [], 0
        while i < len(tokens):
            j = i
            while tokens[j] == tokens[j + size] if j + size < len(tokens) else False:
                if tokens[j : j + size] != tokens[j + size : j + 2 * size]:
                    break
                j += size
            if j > i:
                out.append("( " + " ".join(tokens[i : i + size]) + " )+" if size > 1 or not tokens[i].endswith(")+") else tokens[i])
                i = j + size
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


def _optional(tokens: list[str]) -> list[str]:
    return [t if t.endswith(")?") else f"( {t} )?" for t in tokens]


def _repeated(tokens: list[str], other: list[str]) -> list[str]:
    """tokens with each group that repeats in other, and stands alone here, as the repeated one."""
    for r in dict.fromkeys(t for t in other if t.endswith(")+") and t not in tokens):
        body, out, i = r[2:-3], [], 0
        while i < len(tokens):
            size = next((m for m in range(1, min(GROUP, len(tokens) - i) + 1) if " ".join(tokens[i : i + m]) == body), 0)
            out.append(r if size else tokens[i])
            i += size or 1
        tokens = out
    return tokens


def aligned(a: list[str], b: list[str]) -> list[str]:
    """A wrapper that covers both: what repeats in one does so in both, what doesn't meet is optional."""
    a, b = _repeated(a, b), _repeated(b, a)
    out: list[str] = []
    for op, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        out += a[i:j] if op == "equal" else _optional(a[i:j]) + _optional(b[k:n])
    return out


def slots(wrapper: list[str]) -> list[str]:
    """The ways of open block elements to the wrapper's text slots, in their order."""
    page = []
    for t in (x for w in wrapper for x in w.split(" ")):
        if t.startswith("</"):
            page.append(t)
        elif t.startswith("<"):
            name, *words = t[1:-1].split(".")
            page.append(f'<{name} class="{" ".join(words)}">')
        elif t == "#":
            page.append("#")
    return list(dict.fromkeys(path for path, _ in _outline(list(_walk("".join(page))))))


def _name_and_words(tag: str) -> tuple[str, list[str]]:
    name, *words = tag.split(".")
    return name, words


def main_element(filling: dict[str, int]) -> str:
    """The main element's tag by the amount of text that fills each slot; empty for the whole page."""
    amounts: Counter = Counter()
    for path, n in filling.items():
        tags = path.split("/")[1:]
        if not any(_is_side(*_name_and_words(t), False, True) for t in tags):
            for k in range(len(tags) + 1):
                amounts["/".join(["", *tags[:k]])] += n
    children: dict[str, list[str]] = {}
    for path in amounts:
        if path:
            children.setdefault(path.rpartition("/")[0], []).append(path)
    way, here = [], ""
    while below := children.get(here):
        best = max(below, key=lambda p: (amounts[p], p))
        if amounts[best] <= MOST * amounts[here]:
            break
        way.append(best)
        here = best
    tags = [p.rpartition("/")[2] for p in way]
    for wanted in ("article", "main"):
        if any(t.split(".")[0] == wanted for t in tags):
            return wanted
    for t in tags:
        name, words = _name_and_words(t)
        if name in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words):
            return t
    held = [t for p, t in zip(way, tags, strict=True) if amounts[p] >= NEARLY_ALL * amounts[""] and "." in t and t.split(".")[0] in ("div", "section", "td")]
    return held[-1] if held else ""


def bound(wrapper: list[str], texts: dict[str, int], constants: list[tuple[int, str, int]], n_pages: int) -> tuple[str, list[int]]:
    """The main element's tag, and the numbers of template blocks, of a wrapper whose slots have these amounts of text on n_pages pages.

    constants: number, slot and length of each block that all pages have.
    They are template if there are LEAST_PAGES pages and if more text differs
    between these than is the same: pages that are copies of each other have no
    template.
    """
    filling = {path: texts.get(path, 0) for path in slots(wrapper)}
    same = Counter()
    for _, path, n in constants:
        same[path] += n * n_pages
    total = sum(filling.values())
    if n_pages < LEAST_PAGES or 2 * sum(same.values()) >= total:
        return main_element(filling), []
    return main_element({path: max(0, n - same[path]) for path, n in filling.items()}), sorted(c[0] for c in constants)


def main_text(page: str, element: str, template: frozenset[int] = frozenset()) -> str:
    """The texts of the blocks inside the element (the whole page if it is empty or absent) that aren't template, joined by line ends."""
    for inside in dict.fromkeys((element, "")):
        blocks, found = _read(page, inside)
        if found:
            break
    return "\n".join([text for path, text in blocks if not template or _number(path, text) not in template])


def _closed_by(stack: list[str], count: Counter, names: frozenset[str], bounds: frozenset[str]) -> None:
    """Ends the innermost open element of these names, and all in it, unless one of bounds is met first."""
    if not any(count[n] for n in names):
        return
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] in names:
            count.subtract(stack[k:])
            del stack[k:]
            return
        if stack[k] in bounds:
            return


def _walk(page: str):
    """text, name, words (None for an end tag), level for the page's texts and tags: level counts the elements that stay open before a start tag and after an end tag, end tags that may be left out included."""
    stack: list[str] = []
    count: Counter = Counter()
    for m in _TOKEN.finditer(page):
        if m["text"]:
            yield m["text"], "", None, len(stack)
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                _closed_by(stack, count, frozenset((name,)), CELLS - {name} if name in BLOCKS and name not in TABLE else frozenset(("table",)) - {name} if name in TABLE else BLOCKS)
                yield "", name, None, len(stack)
                continue
            if stack and stack[-1] == "head" and name not in HEAD:
                _closed_by(stack, count, frozenset(("head",)), frozenset())
            if name in BLOCKS:
                _closed_by(stack, count, frozenset("p"), CELLS)
            for names, bounds in IMPLIED.get(name, ()):
                _closed_by(stack, count, names, bounds)
            level = len(stack)
            if name not in VOID and not m["rest"].endswith("/"):
                stack.append(name)
                count[name] += 1
            yield "", name, _telling(m["rest"]), level


def _around(tokens: list, wanted) -> set[int]:
    """Where in tokens the wanted elements that are in no other one start, and those that hold the first of them; others, such as lists of related articles, may be side parts."""
    path: list[int] = []
    found: set[int] = set()
    inside: set[int] = set()
    for k, (text, name, words, level) in enumerate(tokens):
        del path[level:]
        if words is not None and name not in VOID:
            path.append(k)
            if wanted(name, words) and not _is_side(name, words, False, True) and inside.isdisjoint(path):
                found.update(path if not inside else path[-1:])
                inside.add(k)
    return found


def _read(page: str, element: str) -> tuple[list[tuple[str, str]], bool]:
    name_wanted, *words_wanted = element.split(".")
    wanted = lambda name, words: name == name_wanted and (not words_wanted or sorted(words) == words_wanted)
    main_like = lambda name, words: name in ("article", "main") or not MAIN_WORDS.isdisjoint(words)
    tokens = list(_walk(page))
    around = _around(tokens, wanted if element else main_like)
    blocks = Blocks()
    found = not element
    main = side = None  # the levels of the open main element and side part
    for k, (text, name, words, level) in enumerate(tokens):
        if side is not None and level <= side:
            side = None
        if main is not None and level <= main:
            blocks.close()
            main = None
        if side is None and name in BLOCKS:
            blocks.close()
        blocks.go(level, name, words)
        if side is not None:
            continue
        if text:
            if main is not None or not element:
                blocks.text(text)
            continue
        if name == "br":
            blocks.text(" ")
        if words is None or name in VOID:
            continue
        if name not in ("html", "body") and _is_side(name, words, main is not None, k in around):
            side = level
        elif main is None and element and wanted(name, words):
            main, found = level, True
    blocks.close()
    return blocks.found, found


def _looked_at(pages: DataFrame) -> DataFrame:
    """host, stream, n, and once for each host of a batch of pages: its pages there, the amount of text by slot, and the blocks that all of them have."""
    schema = "host string, stream string, n long, pages long, paths array<string>, amounts array<long>, numbers array<long>, number_paths array<string>, number_sizes array<int>"

    def start():
        def run(batch):
            streams: dict[str, Counter] = {}
            amounts: dict[str, Counter] = {}
            same: dict[str, dict] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tokens = list(_walk(page or ""))
                streams.setdefault(host, Counter())["\n".join(folded(_stream(tokens)))] += 1
                blocks = _outline(tokens)
                of_host = amounts.setdefault(host, Counter())
                for path, text in blocks:
                    of_host[path] += len(text)
                known = same.get(host)
                if known is None:
                    same[host] = {_number(path, text): (path, len(text)) for path, text in blocks}
                elif known:
                    here = {_number(path, text) for path, text in blocks}
                    same[host] = {n: v for n, v in known.items() if n in here}
            out = {c.split()[0]: [] for c in schema.split(", ")}
            for host, found in streams.items():
                for k, (s, n) in enumerate(found.items()):
                    blocks = list(same[host].items())
                    more = (sum(found.values()), list(amounts[host]), list(amounts[host].values()), [b[0] for b in blocks], [b[1][0] for b in blocks], [b[1][1] for b in blocks]) if k == 0 else (None,) * 6
                    for column, v in zip(out, (host, s, n, *more), strict=True):
                        out[column].append(v)
            text, long = pa.string(), pa.int64()
            kinds = (text, text, long, long, pa.list_(text), pa.list_(long), pa.list_(long), pa.list_(text), pa.list_(pa.int32()))
            return {c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)}

        return run

    return map_arrow(pages, start, schema)


def _aligned_streams(streams: DataFrame) -> DataFrame:
    """host, wrapper, n_pages of rows (host, stream, n). A host is dealt into shares by its own number of streams alone."""

    def align(frame):
        frame = frame.sort_values(["n", "stream"], ascending=[False, True])
        wrapper: list[str] = []
        for k, s in enumerate(frame.stream):
            tokens = s.split("\n")
            wrapper = tokens if k == 0 else aligned(wrapper, tokens)
        return pd.DataFrame({"host": [frame.host.iloc[0]], "stream": ["\n".join(wrapper)], "n": [int(frame.n.sum())]})

    schema = "host string, stream string, n long"
    while True:
        sized = streams.groupBy("host").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
        if not (sized.agg(F.max("shares")).first()[0] or 0) > 1:
            break
        dealt = streams.join(sized, "host").withColumn("share", F.pmod(F.xxhash64("stream"), F.col("shares")))
        streams = written(dealt.groupBy("host", "share").applyInPandas(lambda key, frame: align(frame), schema))
    return streams.groupBy("host").applyInPandas(lambda key, frame: align(frame), schema).withColumnsRenamed({"stream": "wrapper", "n": "n_pages"})


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, n_pages: one union-free expression for each host of the pages (page_id, url, html)."""
    return _aligned_streams(written(_looked_at(_with_host(pages)).groupBy("host", "stream").agg(F.sum("n").alias("n"))))


def bindings(pages: DataFrame) -> DataFrame:
    """host, element, template (numbers of blocks) for each host of the pages, from its wrapper and the texts in the slots."""
    looked = written(_looked_at(_with_host(pages)))
    found = _aligned_streams(written(looked.groupBy("host", "stream").agg(F.sum("n").alias("n"))))
    each = looked.where("pages is not null")
    texts = each.select("host", F.inline(F.arrays_zip("paths", "amounts"))).groupBy("host", "paths").agg(F.sum("amounts").alias("amount"))
    texts = texts.groupBy("host").agg(F.collect_list(F.struct("paths", "amount")).alias("texts"))
    batches = each.groupBy("host").agg(F.count("*").alias("batches"))
    same = each.select("host", F.inline(F.arrays_zip("numbers", "number_paths", "number_sizes"))).groupBy("host", "numbers").agg(F.count("*").alias("k"), F.first("number_paths").alias("path"), F.first("number_sizes").alias("size"))
    same = same.join(batches, "host").where("k = batches").groupBy("host").agg(F.collect_list(F.struct("numbers", "path", "size")).alias("constants"))
    rows = found.join(texts, "host", "left").join(same, "host", "left").select("host", "wrapper", "n_pages", "texts", "constants")

    def start():
        def run(batch):
            out = [
                bound(w.split("\n"), {t["paths"]: t["amount"] for t in ts or ()}, [(c["numbers"], c["path"], c["size"]) for c in cs or ()], n)
                for w, n, ts, cs in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "n_pages", "texts", "constants")), strict=True)
            ]
            return {"host": batch.column("host"), "element": pa.array([o[0] for o in out], pa.string()), "template": pa.array([o[1] for o in out], pa.list_(pa.int64()))}

        return run

    return map_arrow(rows, start, "host string, element string, template array<long>")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty pages, and pages without main text, give an empty text. A
    null URL, or one without "://", belongs to the empty host. Pages that
    break off are read to their end; repeated rows are read each; other
    columns are ignored. What a host's pages give depends on its own pages
    alone. A block that all pages of a host of at least LEAST_PAGES have in
    the same place is template and goes.
    """
    elements = written(bindings(pages)).withColumnRenamed("host", "of_host")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    joined = rows.withColumn("host", host_of(F.col("url"))).join(elements, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", F.coalesce("element", F.lit("")).alias("element"), "template")

    def read():
        def run(batch):
            out = []
            for page, element, template in zip(*(batch.column(c).to_pylist() for c in ("html", "element", "template")), strict=True):
                out.append(main_text(page or "", element, frozenset(template or ())))
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())}

        return run

    return map_arrow(joined, read, "page_id long, url string, text string, n_chars long")
