"""Filters and extraction on small fixtures: URLs, benchmark items, quality, licences, pages, fingerprints, pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import common, decontamination, fingerprints, licenses, neardup, quality, queries, urls, webpages


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def judge(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("literal", [True, False])
def test_urls(spark, monkeypatch, literal):
    if not literal:
        monkeypatch.setattr(urls, "LITERAL_BLOCKS", 0)
    given = ["http://www.Example.com/en/x", "https://a.example.com/en/", "http://example.com/en", "http://x.net/es/a?q", "http://x.net/es", "ftp://com/", "http://notcom/", "no scheme", None, "", "http://", "a://B.COM#x", "x://y://z.com/", "http://net/es/../", "http://EXAMPLE.com/EN/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, listed).collect()}
    assert got == {i: judge(u) for i, u in enumerate(given)}
    assert {r.verdict for r in urls.judged(pages, listed.where("false")).collect()} == {"allow"} and urls.judged(pages.where("false"), listed).count() == 0


def test_bloom_filter_misses_nothing(spark):
    listed = spark.createDataFrame([(f"h{i}.org", "/", "block") for i in range(500)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x", "") for i in range(1000)], "page_id long, url string, html string")
    assert urls.judged(pages, listed).where("verdict = 'block'").agg(F.count("*"), F.max("page_id")).first() == (500, 499)


ITEM = "If Alice buys 3 kg of apples for 12 euros then how many euros does Bob pay for 6 kg of the same apples in the market today?"


def test_decontamination(spark):
    r = random.Random(1)
    clean = [" ".join(r.choice("alpha beta gamma delta 1 2 3 Rome Paris kg".split()) for _ in range(80)) for _ in range(20)]
    swapped = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "5").replace("12", "20").replace("6", "10")
    broken = ITEM.replace("3 kg", "3 kg").replace("how many euros", "how many dollars")
    texts = [clean[0] + ". " + ITEM + " " + clean[1], swapped, "nothing here", None, "", ITEM.upper(), broken, *clean, ITEM + " " + ITEM]
    bench = spark.createDataFrame([(7, ITEM), (8, "a short item"), (9, None), (10, "five words make an item")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.reparameterised for x in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert got[(0, 7)] is False and got[(1, 7)] is True and (len(texts) - 1, 7) in got
    assert {d for d, _ in got} <= {0, 1, 5, 6, len(texts) - 1}
    assert (0, 10) not in got and decontamination.contaminated(docs_of(spark, ["a five words make an item b"]), bench).first().item_id == 10
    left = decontamination.decontaminated(docs_of(spark, texts), bench)
    assert left.columns == ["doc_id", "text", "score"] and {0, 1, len(texts) - 1}.isdisjoint(x.doc_id for x in left.collect()) and left.where("doc_id in (2, 3, 4)").count() == 3
    assert decontamination.contaminated(docs_of(spark, texts), bench.where("false")).count() == 0 and decontamination.contaminated(docs_of(spark, ["x"]).where("false"), bench).count() == 0


def test_slots_must_agree(spark):
    """The same name twice in the item must be one name twice in the document."""
    item = "we saw that today old Alice met the man near Alice and the river before dawn"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, ["x " + item.replace("Alice", "Carol"), "x " + item.replace("Alice", "Carol", 1).replace("Alice", "Dave")])
    assert [x.doc_id for x in decontamination.contaminated(docs, bench).collect()] == [0]


def test_words_under_separate_runs_are_counted(spark):
    """One changed word splits an item of 20 words into runs of 9 and 10 words that cover 19 words together."""
    words = [f"w{chr(97 + i)}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join(["other" if i == k else w for i, w in enumerate(words)]) for k in range(20)] + [" ".join(words[:12]), " ".join(words[:13])]
    got = {x.doc_id: x.n_windows for x in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert got[9] == 5 and set(got) == {0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 21}


def test_items_dense_in_numbers(spark):
    """Runs that are mostly placeholders match verbatim, or beside a run that isn't; other numbers alone are no match."""
    apples, solve, numbers = "If Tom has 3 apples, Ann has 5, Bob has 7, how many?", "Solve 3 x 4, 5 x 6, 7 x 8, 9 x 10, 11 x 12 now.", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    bench = spark.createDataFrame([(1, apples), (2, solve), (3, numbers)], "item_id long, text string")
    texts = ["It says. " + apples + " Right.", "It says. " + solve, apples.replace("3", "4").replace("Ann", "Eve").replace("7", "9"), "x " + numbers + " y", "21 22 23 24 25 26 27 28 29 30 31 32 33 34", solve.replace("x", "+"), apples.replace("5", "3")]
    got = {(x.doc_id, x.item_id, x.n_windows, x.reparameterised) for x in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 1, 6, False), (1, 2, 10, False), (2, 1, 6, True), (3, 3, 7, False)}


def test_short_items_whatever_is_before_them(spark):
    """Where a sentence starts, and letter case, hide no copy; another word in the place of an item's first one is no name."""
    planet, trip, seven = "What is the largest planet in our solar system by mass?", "Alice drove from Paris to Rome", "Where was old Henry born?"
    bench = spark.createDataFrame([(1, planet), (2, trip), (3, seven)], "item_id long, text string")
    texts = ["Question one. " + planet, "Question one " + planet, "1) " + planet, "a title\n" + planet, planet.lower(), planet.upper(), planet.title(), "so " + trip, trip.lower() + " again", "THE " + trip.upper(), "then Alice drove from Turin to Rome", "and " + seven.lower(), "so " + seven, "we saw That is the largest planet in our solar system by mass", "then Berta drove from Paris to Rome"]
    got = {(x.doc_id, x.item_id): x.reparameterised for x in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {**{(i, 1): False for i in range(7)}, (7, 2): False, (8, 2): False, (9, 2): False, (10, 2): True, (11, 3): False, (12, 3): False}


def test_items_of_few_words(spark):
    bench = spark.createDataFrame([(1, "four words are here"), (2, "Three 3 words"), (3, "single"), (4, "John Smith paid 12 USD and 15 EUR to Mary Jones on 3 May 2020 at 5 pm")], "item_id long, text string")
    texts = ["so FOUR words, are here now", "four words are there", "three 3 words", "three 4 words", "a single word", "Single!", "x John Smith paid 12 USD and 15 EUR to Mary Jones on 3 May 2020 at 5 pm"]
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 1), (2, 2), (5, 3), (6, 4)}


def template_of(word):
    core = word.strip(".,")
    return "<n>" if core.isdigit() else "<u>" if core in ("kg", "km") else core


def contaminated_by_hand(doc, item):
    """The rule for texts of plain words, numbers and units, run by run at every offset."""
    d, t = doc.split(), item.split()
    size, n = min(decontamination.WINDOW, len(t)), len(t)
    best = None
    for offset in range(-n, len(d)):
        fit = []
        for i in range(n - size + 1):
            j = i + offset
            if j < 0 or j + size > len(d):
                continue
            ours, theirs = t[i : i + size], d[j : j + size]
            if [template_of(w) for w in ours] != [template_of(w) for w in theirs]:
                continue
            slots = [(a.strip(".,"), b.strip(".,")) for a, b in zip(ours, theirs, strict=True) if template_of(a).startswith("<")]
            if [[x[0] == y[0] for y in slots] for x in slots] == [[x[1] == y[1] for y in slots] for x in slots]:
                fit.append((i, slots, 2 * len(slots) > size))
        if not any(not dense for _, _, dense in fit):
            fit = [(i, s, d) for i, s, d in fit if all(a == b for a, b in s)]
        pairs = {p for _, s, _ in fit for p in s}
        if not fit or len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
            continue
        if len({k for i, _, _ in fit for k in range(i, i + size)}) >= min(decontamination.COVER, n):
            found = (len(fit), len(pairs), all(a == b for a, b in pairs))
            best = max(best or found, found)
    return best


def test_decontamination_run_by_run(spark):
    r = random.Random(13)
    word = lambda: r.choice("wa wb wc wd we wf wg wh wi wj kg km".split() + [str(r.randint(1, 6)) for _ in range(4)])
    items = [" ".join(word() for _ in range(r.randint(5, 24))) for _ in range(12)]
    docs = []
    for _ in range(80):
        w = r.choice(items).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.4:
            swap = dict(zip("123456", r.sample("123456789", 6), strict=True))
            w = [swap.get(x, x) for x in w]
        docs.append(" ".join([word() for _ in range(r.randint(0, 9))] + w + [word() for _ in range(r.randint(0, 9))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_windows, x.n_slots, not x.reparameterised) for x in decontamination.contaminated(docs_of(spark, docs), bench).collect()}
    want = {(i, k): b for i, d in enumerate(docs) for k, t in enumerate(items) if (b := contaminated_by_hand(d, t))}
    assert got == want and len(want) > 30


def quality_rows(n=400):
    r = random.Random(9)
    rows = []
    for i in range(n):
        words = [r.choice("the cat sat on a mat with one more word for all".split()) for _ in range(r.randint(5, 60))]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else "### ".join(w.upper() for w in words) + " $$$", int(good)))
    return rows


def test_quality_on_rows_it_has_not_seen(spark):
    rows = quality_rows()
    docs, labels = docs_of(spark, [t for _, t, _ in rows]), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.trained(docs, labels, ~F.expr(queries.UNSEEN_LABEL))
    got = {x.doc_id: x for x in quality.scored(docs, *model).select("doc_id", "score", F.expr(queries.UNSEEN_LABEL).alias("held_out")).collect()}
    unseen = [(i, q) for i, _, q in rows if got[i].held_out]
    assert len(unseen) > 80 and sum((got[i].score >= 0.5) == q for i, q in unseen) / len(unseen) > 0.95
    odd = quality.scored(docs_of(spark, [None, "", "!", "word " * 20_000]), *model).collect()
    assert len(odd) == 4 and all(0 <= x.score <= 1 for x in odd)
    assert quality.accepted(docs, *model).columns == docs.columns and quality.scored(docs.where("false"), *model).count() == 0


def test_quality_without_labels(spark):
    docs, labels = docs_of(spark, ["a", "b"]), spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in quality.scored(docs, *quality.trained(docs, labels, F.lit(True))).collect()} == {0.5}


def test_quality_never_reads_labels(spark):
    """The same text scores the same, whatever its row's other columns say."""
    rows = quality_rows(60)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.trained(docs_of(spark, [t for _, t, _ in rows]), labels, F.lit(True))
    assert len({x.score for x in quality.scored(docs_of(spark, ["one text"] * 5), *model).collect()}) == 1


@pytest.mark.parametrize(
    "expression, labels, rank",
    [("mit", {"mit"}, 0), ("(gpl-2.0 or mit) and apache-2.0", {"gpl", "mit", "apache"}, 0), ("gpl-3.0-only with classpath-exception-2.0", {"gpl"}, 1), ("mit and gpl-2.0", {"mit", "gpl"}, 2), ("mit or", {"mit"}, None), ("and mit", None, None), ("(mit", None, None), ("unknown-1", None, None)],
)
def test_licence_expressions(expression, labels, rank):
    rpn = licenses.postfix(expression)
    got = licenses.evaluate(rpn) if rpn else None
    if rank is None:
        assert got is None
    else:
        assert got == (labels, rank)


def test_license_scan(spark):
    texts = ["Under the MIT License. mit license!", "GNU-General  public\nlicense CC BY", "// SPDX-License-Identifier: (MIT OR Apache-2.0)", "nothing", None, "", "permit license", "mit licenses", "ccby cc by4", "MIT éLicense"]
    got = {x.doc_id: x for x in licenses.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.encode().split()]
        at = [k for k, _ in places]
        want = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(","))) and 0 <= got[i].score <= 1
    assert got[2].labels == "apache,mit" and got[2].expressions == ["mit apache-2.0 or"] and got[3].score == 0
    assert licenses.scan(docs_of(spark, ["x"]).where("false")).count() == 0


PAGE = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li>Home</li></ul></nav><div class="ad big">Buy</div>{main}<footer>&copy; me</footer></body></html>'


def test_html(spark):
    article = "<article><h1>A &amp; B</h1><p>one<br>two <b>three</b></p><p> </p><p>four\n five<aside>side</aside></p><form>f</form><section class='comments'>c</section></article>"
    other = "<div class='post-content'><h2>Head</h2><p>Body &lt;x&gt; &amp</p></div><div class='sidebar'>s</div>"
    pages = [(1, "http://a.org/1", PAGE.format(main=article)), (2, "http://a.org/2", PAGE.format(main="<article><p>short</p></article>")), (3, "http://b.org/", PAGE.format(main=other)), (4, None, None), (5, "http://b.org/2", ""), (6, "http://c.org/", "plain <!-- note --> text"), (7, "http://a.org/cut", PAGE.format(main=article)[:-60]), (8, "http://a.org/1", PAGE.format(main=article))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("element", F.lit("clash"))
    got = {x.page_id: x.text for x in webpages.extracted(df).collect()}
    want = "A & B\none two three\nfour five"
    assert got == {1: want, 2: "short", 3: "Head\nBody <x> &", 4: "", 5: "", 6: "plain text", 7: want, 8: want}
    assert webpages.extracted(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "inside, want",
    [('<p class="ad">Buy<p>one</p><p>two</p>', "one\ntwo"), ('<ul><li class="share">s<li>one<li>two</ul><p>three', "one\ntwo\nthree"), ('<dl><dt class="ad">a<dd>b<dt>c</dl>d', "b\nc\nd"), ('<table><tr class="ad"><td>a<td>b<tr><td class="ad">c<td>d</table>e', "d\ne"), ('<section>x<div class="ad">Buy<p>more</section><p>one', "x\none"), ('<div class="ad">a<div>b</div>c</div>d', "d"), ('<p class="ad"><b>Buy<p>one</p>', "one"), ('<div class="ad">a</p>b</b>c</div>d', "d")],
)
def test_side_parts_end_without_end_tags(inside, want):
    assert webpages.main_text(f"<html><head><meta charset=x><body><article>{inside}</article><p>after", "article") == want
    assert webpages.main_text(f"<html><head><meta charset=x><body><div>{inside}</div><p>after", "") == want + "\nafter"


@pytest.mark.parametrize("article", ['<article class="post category-notice">', '<article class="has-sidebar related_posts_off">', "<article>"])
def test_parts_of_words_hide_no_main_element(article):
    page = f'<body class="x"><div class="page-with-sidebar"><div class="content-with-sidebar">{article}<h1>t</h1><p>one</p><div class="share-buttons">s</div><div class="post-content-with-ads"><p>two</p></div></article></div><div class="site-sidebar">b</div></div></body>'
    assert webpages.main_text(page, "article") == webpages.main_text(page, "") == "t\none\ntwo"
    assert webpages.main_text(f'<div class="sidebar">{article}no</article></div><p>yes</p>', "article") == "yes"
    assert webpages.main_text(f'{article}yes<div class="comments-list"><article>no</article></div></article><div class="related-posts"><article>no</article></div>', "article") == "yes"
    assert webpages.main_element({"/div.content.with-sidebar": 9, "/p": 1}) == "div.content.with-sidebar" and webpages.main_element({"/div.content.sidebar/p": 9, "/p": 1}) == ""


def test_wrappers_are_union_free():
    a = webpages.folded(webpages.stream("<div><p>x</p><p>y</p><p>z</p></div>"))
    b = webpages.folded(webpages.stream("<div><h1>t</h1><p>x</p></div>"))
    assert a == ["<div>", "( <p> # </p> )+", "</div>"]
    assert webpages.aligned(a, b) == ["<div>", "( <h1> )?", "( # )?", "( </h1> )?", "( <p> # </p> )+", "</div>"]
    joined = webpages.aligned(a, webpages.folded(webpages.stream("<div><p>x</p></div>")))
    assert joined == a
    assert webpages.slots(["<body>", "( <div.post> )?", "( <p> # </p> )+", "( </div> )?", "<p>", "#", "<li>", "#"]) == ["/body/div.post/p", "/body/p", "/body/li"]
    assert webpages.main_element({"/div.content/p": 9, "/div.ad": 90}) == "div.content" and webpages.main_element({"/div.ad": 9}) == ""
    assert webpages.main_element({"/div.x/div.y/p": 95, "/p": 5}) == "div.y" and webpages.main_element({"/div.x/p": 50, "/div.y/p": 50}) == ""


def host_pages(r, host, first, n):
    """Pages of a host, made from a template of its own, with the texts that a reader would copy out."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))
    opening, closing = r.choice([("<article class='{c}' id='post-{i}'>", "</article>"), ("<main class='{c}'>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div class='x{h} wide'>", "</div>"), ("<section class='story {c}'>", "</section>")])
    plain = r.choice(["has-comments", "no-sidebar", "news-search", "category-notice", "dark"])
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(5).split())
    top, bottom, notice = words(4), words(6), words(8)
    neutral = r.random() < 0.5
    out = []
    for i in range(first, first + n):
        blocks = [words(r.randint(20, 60)) for _ in range(r.randint(2, 6))]
        title, listed = words(5), [words(3) for _ in range(r.randint(0, 3))]
        body = f"<h1>{title}</h1>" + "".join(f"<p>{b}" + "</p>" * r.randint(0, 1) for b in blocks)
        if listed:
            body += "<ul>" + "".join(f"<li>{x}" for x in listed) + "</ul>"
        inner = "".join(r.choice(["", f"<{e} class='{c}'><p>{words(6)}</p></{e}>"]) for e, c in (("div", "comments"), ("div", "advert"), ("section", "related"), ("div", "sidebar"), ("aside", "y"), ("form", "z")))
        page = f"<html><head><title>{title}</title><script>if (a < b) c('<p>{word()}</p>')</script></head><body>"
        page += f"<div class='t'>{top}</div><ul>{menu}</ul>" if neutral else f"<header>{top}</header><nav><ul>{menu}</ul></nav>"
        page += f"<div class='ad'>{words(7)}</div>" + opening.format(c=plain, i=i, h=host[0]) + body + inner + closing
        page += f"<div>{notice}</div>" if neutral else f"<div class='notice'>{notice}</div>"
        page += f"<footer>{bottom} {word()}</footer></body></html>"
        out.append((i, f"http://{host}/{i}", page, "\n".join([title, *blocks, *listed])))
    return out


def test_html_of_made_up_hosts(spark, monkeypatch):
    """Texts come out exactly, whatever the host's template, and don't change with other hosts."""
    r = random.Random(3)
    rows = [x for k in range(24) for x in host_pages(r, f"h{k}.org", 100 * k, r.randint(4, 9))]
    pages = lambda part: spark.createDataFrame([x[:3] for x in part], "page_id long, url string, html string")
    want = {x[0]: x[3] for x in rows}
    got = {x.page_id: x.text for x in webpages.extracted(pages(rows).repartition(3)).collect()}
    assert got == want
    monkeypatch.setattr(webpages, "SHARE", 3)
    one = [x for x in rows if x[0] < 100]
    assert webpages.wrappers(pages(one)).collect() == webpages.wrappers(pages(rows)).where("host = 'h0.org'").collect()


def test_copies_of_a_page_are_no_template(spark):
    text = "<body><div><p>{}</p><p>the same words in every copy of it</p></div></body>"
    rows = [(i, "http://a.org/", text.format("x" if i else "y")) for i in range(4)] + [(9, "http://b.org/", text.format("z"))]
    got = {x.page_id: x.text for x in webpages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{w}\nthe same words in every copy of it" for i, w in ((0, "y"), (1, "x"), (2, "x"), (3, "x"), (9, "z"))}


def test_large_hosts_are_aligned_in_shares(spark, monkeypatch):
    monkeypatch.setattr(webpages, "SHARE", 4)
    rows = [(i, "http://big.org/", "<body>" + "<i>a</i>" * (i % 3) + "<h2>b</h2>" * (i % 5 > 2) + f"<article><p>t{i}</p></article></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in webpages.extracted(df).collect()} == {i: f"t{i}" for i in range(40)} and webpages.wrappers(df).count() == 1


def test_fingerprints(spark):
    r = random.Random(5)
    texts = [" ".join(f"t{int(r.paretovariate(0.7))}" for _ in range(r.randint(1, 400))) for _ in range(120)] + ["", None, "same text", "same text", "ünï çödé"]
    df = docs_of(spark, texts).repartition(3)
    got = {x.doc_id: x for x in fingerprints.compared(df, band=(0.0, 0.5)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[i].near_next == fingerprints.likeness(got[i].fingerprint, got[(i + 1) % len(texts)].fingerprint)
    n = len(texts)
    assert got[n - 3].fingerprint == got[n - 2].fingerprint and got[n - 3].near_next == 1.0 and got[n - 5].fingerprint == got[n - 4].fingerprint
    long = [x for x in got.values() if x.n_chars > 200]
    assert sum(x.near_edited for x in long) > 3 * sum(x.near_next for x in long)
    alone = fingerprints.compared(docs_of(spark, ["just one text"])).first()
    assert alone.near_next == 1.0 and fingerprints.compared(docs_of(spark, ["x"]).where("false")).count() == 0


def test_near_dedup_settles_null_and_repeated_ids(spark):
    rows = [(None, "no id", "a"), (None, "no id", "b"), (1, "one text", "z"), (1, "another text", "y"), (1, "one text", "x"), (2, "alone", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(tuple, neardup.without_near_copies(d).collect()), key=str) for d in (docs, docs.orderBy(F.desc("source")), docs.repartition(5, "source"))]
    assert got[0] == got[1] == got[2] and [r for r in got[0] if r[0] is None] == rows[:2] and [r[0] for r in got[0] if r[0]] == [1, 2] and (1, "one text", "z") not in got[0]


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(80)) for _ in range(30)]
    passage, item = " ".join(word() for _ in range(50)), " ".join(word() for _ in range(20))
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0]), (101, good[1] + " end"), (102, good[2] + " " + passage + " a"), (103, passage + " " + " ".join(word() for _ in range(60))), (104, "start " + item + " stop"), (105, None)]
    rows += [(200 + i, "$$$ ".join(word().upper() for _ in range(40))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, t in rows if i < 100 or i >= 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        kept.append({x.doc_id for x in now.select("doc_id").collect()})
    assert not any(i >= 200 for i in kept[0]) and kept[0] >= {i for i in range(30)} | {100, 101}
    assert {100, 101}.isdisjoint(kept[1]) and {0, 1, 2}.issubset(kept[1]) and kept[2] == kept[1] and 104 not in kept[3] and kept[3] == kept[2] - {104} and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_very_long_urls(spark):
    """Labels and directories beyond the list's cost nothing."""
    url = "http://" + "a." * 2000 + "example.com/en/" + "d/" * 2000
    given = [url, url.replace("/en/", "/fr/"), "http://" + "com/" * 3000]
    pages = spark.createDataFrame([(1, u) for u in given], "page_id long, url string")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert sorted((r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, listed).collect()) == sorted(judge(u) for u in given)
    with pytest.raises(ValueError):
        urls.judged(pages, spark.createDataFrame([("com", "/en", "block")], "host string, path string, verdict string"))


def spelt_out(texts, band):
    """Lexicon, subsets, fingerprints and likeness with sets and dictionaries."""
    import numpy as np
    import xxhash

    mix = lambda x: int(common.mixed(np.array([x], np.uint64))[0])
    number = lambda w: xxhash.xxh3_64_intdigest(w)
    terms = [{number(w) for w in (t or "").encode().lower().split()} for t in texts]
    seen = Counter(w for ws in terms for w in ws)
    known = {w for w, n in seen.items() if band[0] * len(texts) <= n <= band[1] * len(texts) and n > 1}
    in_subset = {}

    def members(k, rate, ws):
        seed = (k + 1) * int(common.MIX_2) % 2**64
        return [w for w in ws if in_subset.setdefault((k, w), mix(w ^ seed) % rate == 0)]

    def mark(ws):
        ws, parts = ws & known or ws, []
        for k in range(len(fingerprints.RATES) * fingerprints.SUBSETS):
            mine = members(k, fingerprints.RATES[k // fingerprints.SUBSETS], ws)
            total = sum(mix((w + int(common.MIX_1)) % 2**64) for w in mine) % 2**64
            parts.append(f"{mix(total) >> 32:08x}" if mine else None)
        return parts

    def near(a, b):
        if a == b:
            return 1.0
        best = 0.0
        for at in range(0, len(a), fingerprints.SUBSETS):
            both = [x == y for x, y in zip(a[at : at + fingerprints.SUBSETS], b[at : at + fingerprints.SUBSETS], strict=True) if x or y]
            if len(both) >= fingerprints.LEAST_PARTS:
                best = max(best, sum(both) / len(both))
        return best

    out = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        edited = (t[: len(t) - k] + after[:k]).encode()
        a, b, c = mark(terms[i]), mark({number(w) for w in edited.lower().split()}), mark(terms[(i + 1) % len(texts)])
        text = lambda parts: "".join(p or "-" * 8 for p in parts)
        out.append((len(t), hashlib.sha256(edited).hexdigest(), text(a), text(b), near(a, b), near(a, c)))
    return out


@pytest.mark.parametrize("ids", ["plain", "repeated"])
def test_fingerprints_spelt_out(spark, ids):
    r = random.Random(6)
    texts = [" ".join(f"T{int(r.paretovariate(0.7))}" for _ in range(r.randint(1, 150))) for _ in range(30)] + [None, "", "same text", "same text"]
    if ids == "repeated":
        rows = sorted([(None if i < 3 else 2**60 + i // 4, t) for i, t in enumerate(texts)], key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    else:
        rows = list(enumerate(texts))
    want = Counter((i, *w) for (i, _), w in zip(rows, spelt_out([t for _, t in rows], (0.05, 0.5)), strict=True))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(4)
    assert Counter(tuple(x) for x in fingerprints.compared(df, band=(0.05, 0.5)).collect()) == want


def by_recursion(expression):
    """(labels, class) of a well-formed expression with the two sides split at its loosest operator; None if no licence is known."""
    tokens = expression.replace("(", " ( ").replace(")", " ) ").split()
    depth, loosest = 0, None
    for i, t in enumerate(tokens):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t in licenses.PRECEDENCE and (loosest is None or licenses.PRECEDENCE[t] <= licenses.PRECEDENCE[tokens[loosest]]):
            loosest = i
    if loosest is None:
        if tokens[0] == "(":
            return by_recursion(" ".join(tokens[1:-1]))
        known = licenses.family(tokens[0])
        return ({known[0]}, known[1]) if known else (set(), None)
    (a, x), (b, y) = by_recursion(" ".join(tokens[:loosest])), by_recursion(" ".join(tokens[loosest + 1 :]))
    if tokens[loosest] == "with":
        return a, None if x is None else max(0, x - 1)
    both = [c for c in (x, y) if c is not None]
    return a | b, None if not both else (min if tokens[loosest] == "or" else max)(both)


def test_license_labels_and_scores_spelt_out(spark):
    r = random.Random(14)
    names = ["mit", "gpl-2.0", "apache-2.0", "lgpl-2.1", "unknown-1", "cc-by-nc-4.0", "bsd-3-clause"]

    def expression(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(names)
        inner = f"{expression(depth - 1)} {r.choice(['or', 'and', 'with'])} {expression(depth - 1)}"
        return f"({inner})" if r.random() < 0.5 else inner

    rows, phrases = [], list(licenses.NOTICES) + list(licenses.BASE)
    for _ in range(120):
        parts = [r.choice(["some", "license", "mit", "text", "by", "public", *phrases, *phrases]) for _ in range(r.randint(0, 6))]
        found = expression(2) if r.random() < 0.6 else None
        rows.append((r.randint(1, 40) if r.random() < 0.9 else None, " ".join(parts).title(), found))
    df = spark.createDataFrame([(i, t + (f"\n# SPDX-License-Identifier: {e}\nend" if e else ""), "x") for i, t, e in rows], "doc_id long, text string, labels string")
    want = Counter()
    for i, t, e in rows:
        words = t.lower().split() + ([*("spdx license identifier").split(), *re.findall(r"[0-9a-z]+", e), "end"] if e else [])
        hits = [label for p, label in (licenses.NOTICES | licenses.BASE).items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        rated = [known[1] if (known := licenses.family(x)) else 3 if x == "reserved" else 0 for x in hits]
        labels, rank = by_recursion(e) if e else (set(), None)
        rated += [] if rank is None else [rank]
        labels = set() if rank is None else labels
        want[(i, ",".join(sorted(labels | set(hits))), licenses.CLASS_SCORE[max(rated)] if rated else 0.0)] += 1
    assert Counter((x.doc_id, x.labels, x.score) for x in licenses.scan(df).collect()) == want


def quality_by_hand(rows):
    """The score of any text after learning from rows of (id, text, label): features and updates with dictionaries."""
    import math

    import xxhash

    def vector(text):
        hashes = [xxhash.xxh3_64_intdigest(t.lower().encode()) | (1 if t.isupper() and len(t) > 1 else 0) for t in re.findall(r"\w+|[^\w\s]+", text)]
        every = hashes + [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(hashes, hashes[1:], strict=False)]
        counts = Counter((h * 0xFF51AFD7ED558CCD % 2**64) >> (64 - quality.BITS) for h in every)
        x = {k: 1 + math.log(n) for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / norm for k, v in x.items()}

    learnt = sorted(((xxhash.xxh3_64_intdigest(str(i)), i, vector(t), q) for i, t, q in rows), key=lambda x: x[:2])
    share = sum(q for *_, q in learnt) / len(learnt)
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for _, _, x, q in learnt:
            p = 1 / (1 + math.exp(-(sum(weight(k) * v for k, v in x.items()) + bias)))
            slope = (p - q) * (0.5 / share if q else 0.5 / (1 - share))
            for k, v in x.items():
                g, w = slope * v, weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w
                n[k] += g * g
            bias_n += slope * slope
            bias -= 0.1 * slope / (1 + math.sqrt(bias_n))
    return lambda t: 1 / (1 + math.exp(-((sum(weight(k) * v for k, v in vector(t).items()) if t else 0.0) + bias)))


def test_quality_spelt_out(spark):
    rows = quality_rows(60)
    score = quality_by_hand(rows)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "the cat"), (902, "x " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {(x.doc_id, x.score) for x in quality.scored(docs, *quality.trained(docs, labels, F.lit(True))).collect()}
    for i, t in [(i, t) for i, t, _ in rows] + [(900, ""), (901, ""), (None, "the cat"), (902, "x " * 3000)]:
        assert next(s for d, s in got if d == i) == pytest.approx(score(t), abs=1e-4)
