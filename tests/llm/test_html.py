import html
import re

import pytest

from episodica.llm import html_extract

from .helpers import rows_of

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ('<div class="sidebar">s</div><p>q</p>', "q"),
    ("<main><form>f</form><p>ok &amp; x<br>y</p><div id='comments'><p>c</p></div></main><p>no</p>", "ok & x y"),
    ("a < b", "a < b"),
    ('<p title="a>b">x</p>', "x"),
    ("<ul><li>1<li>2</ul>", "1\n\n2"),
    ("<article><header><h1>T</h1></header><p>x  \n y</p></article><header>site</header>", "T\n\nx y"),
    ("<p>open <b", "open"),
    ("<script>x</scr", ""),
    ("<div>t1<div>t2</div>t3</div>", "t1\n\nt2\n\nt3"),
    ("<p>caf&eacute; &#8364;&nbsp;x</p>", "caf\u00e9 \u20ac x"),
    ('<article>a<article class="comment">c</article></article><article class="related-post">r</article>', "a"),
    ('<body class="has-sidebar"><div class="layout no-sidebar"><p>kept</p></div><div class="cookie-notice">n</div>', "kept"),
    ('<p>x</p><p style="display: none">y</p><div hidden>z</div>', "x"),
    ("<!-- c --><p>a<!-- b -->c</p><style>p{}</style><noscript>n</noscript>", "ac"),
    ('<div role="navigation">m</div><section><p>s</p></section><button>b</button>', "s"),
    ("", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_blocks(page, want):
    assert html_extract.main_text(page, set()) == want


def test_all_pages_against_their_articles(spark):
    """The given pages keep their article in one element, so a plain cut of it says what to find."""
    data = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in rows_of(html_extract.op5_html_extraction(spark, data))}
    for row in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = row["html"].split("<article>")[1].split("</article>")[0]
        parts = (re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", p) for p in re.split(r"</?h1>|</?p>", inner))
        blocks = [re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts]
        assert got[row["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[row["page_id"]]["n_chars"] == len(got[row["page_id"]]["text"])


def test_the_template_decides_where_names_tell_nothing(spark):
    """The given pages with their article, advert class and menus renamed give the same text, by the slots of the template."""
    names = {"<article>": "<div>", "</article>": "</div>", 'class="ad"': 'class="k"', "<nav>": "<div id=z>", "</nav>": "</div>"}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    renamed = "html"
    for old, new in names.items():
        renamed = f"replace({renamed}, '{old}', '{new}')"
    hidden = pages.selectExpr("page_id", "url", f"{renamed} AS html")
    counted = {r["h"]: r["n"] for r in rows_of(pages.selectExpr("lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h").groupBy("h").count().withColumnRenamed("count", "n"))}
    want = {r["page_id"]: r["text"] for r in rows_of(html_extract.extract(pages))}
    got = rows_of(html_extract.extract(hidden))
    host = lambda url: re.search("://([^/?#]*)", url)[1].lower()
    many = [r for r in got if counted[host(r["url"])] >= html_extract.MIN_PAGES]
    assert len(many) > 150
    same = sum(r["text"] == want[r["page_id"]] for r in many)
    assert same >= 0.98 * len(many), (same, len(many))
    html_of = {r["page_id"]: r["html"] for r in rows_of(hidden)}
    emptied = {i: html_extract.main_text(h, set()) for i, h in html_of.items()}
    assert all(emptied[r["page_id"]] != r["text"] for r in many)  # without a template, other text
    assert sum(emptied[r["page_id"]] == want[r["page_id"]] for r in many) == 0


def test_slots_of_little_text_are_frame():
    heavy, light, article = [900.0, 900.0, 0.0], [30.0, 300.0, 0.0], [40.0, 10.0, 10.0]
    assert html_extract.chosen_slots({1: heavy, 2: light, 3: article}) == [1]
    assert html_extract.chosen_slots({1: [3600.0, 900.0, 900.0], 2: light, 3: article}) == [1, 3]
    assert html_extract.chosen_slots({}) == []


def test_a_hot_host(spark):
    """A host of a third of all rows, and copies of one page, change nothing for the others."""
    rows = [(i, f"https://hot/{i}", f"<body><div>Site</div><div><p>Text {i} {'word ' * 30}</p></div></body>") for i in range(300)]
    rows += [(1000 + i, "https://hot/x", "<body><div>Site</div><div><p>Same</p></div></body>") for i in range(300)]
    rows += [(2000 + i, f"https://h{i % 60}/{i}", f"<body><div>S</div><div><p>Own {i} {'more ' * 20}</p></div></body>") for i in range(600)]
    got = rows_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)))
    assert len(got) == 1200
    for r in got:
        k = r["page_id"]
        assert r["text"] == (f"Text {k} {'word ' * 30}" if k < 1000 else "Same" if k < 2000 else f"Own {k - 2000} {'more ' * 20}").strip()


def site(spark, n, host="h.example"):
    page = '<html><body><div>Site name</div><div class="x"><span>Home</span></div><div><p>Own text {i} of page {i}.</p><p>More {i}</p></div><div>Imprint</div></body></html>'
    rows = [(i, f"https://{host}/{i}", page.format(i=i)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_is_deduced_where_no_element_tells(spark):
    got = sorted(rows_of(html_extract.extract(site(spark, 8))), key=lambda r: r["page_id"])
    assert [r["text"] for r in got] == [f"Own text {i} of page {i}.\n\nMore {i}" for i in range(8)]


def test_few_pages_have_no_template(spark):
    got = rows_of(html_extract.extract(site(spark, 2)))
    assert all(r["text"].startswith("Site name\n\nHome\n\nOwn text") for r in got)


def test_occurrence_vectors_are_classes(spark):
    pages = site(spark, 6).selectExpr("page_id", "'h' AS host", "html")
    rows = rows_of(html_extract.occurrence_vectors(pages))
    brute = {}
    for r in pages.collect():
        for token, n in html_extract.tokens_of(r["html"]).items():
            brute.setdefault(token, {})[r["page_id"]] = n
    assert {r["token"]: r["pages"] for r in rows} == {t: len(v) for t, v in brute.items()}
    vectors = {}
    for r in rows:
        vectors.setdefault(r["vector"], set()).add(tuple(sorted(brute[r["token"]].items())))
    assert all(len(v) == 1 for v in vectors.values()) and len(vectors) == len({tuple(sorted(v.items())) for v in brute.values()})


def test_edges(spark):
    rows = [(1, None, None), (None, "https://a/x", ""), (2, "https://a/y", "<p>" + "long " * 200_000), (2, "https://a/y", "<p>t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.selectExpr("*", "'x' AS text", "'y' AS host", "1 AS template")
    got = rows_of(html_extract.extract(df))
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 999_999]
    assert rows_of(html_extract.extract(df.limit(0))) == []


def test_the_template_decides_inside_articles(spark):
    """Text that all pages share, or some, is content in an article; outside it is frame."""
    page = '<body><div>Site</div><article><p class="by">By the staff</p><p class="x">Own {i}</p>{some}</article></body>'
    some = '<p class="s">Quoted once</p><p class="s">and again</p>'
    rows = [(i, f"https://h/{i}", page.format(i=i, some=some if i % 2 else "")) for i in range(12)]
    got = sorted(rows_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))), key=lambda r: r["page_id"])
    assert [r["text"] for r in got] == [f"By the staff\n\nOwn {i}" + "\n\nQuoted once\n\nand again" * (i % 2) for i in range(12)]


def extracted(spark, pages):
    """The texts of ``pages``, each (url, html), in order."""
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    got = rows_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_articles_keep_what_pages_share(spark, element):
    page = (
        "<body><div>Site</div><ul><li><a href=/>Home</a></li></ul><{e}><h1>Report</h1><p>Methods are those of the first report.</p>"
        "<p>Own findings {i} of {i}.</p><p>All rights of {i}.</p><p>The end.</p></{e}><div>Imprint</div></body>"
    )
    want = "Report\n\nMethods are those of the first report.\n\nOwn findings {i} of {i}.\n\nAll rights of {i}.\n\nThe end."
    got = extracted(spark, [(f"https://h/{i}", page.format(e=element, i=i)) for i in range(6)])
    assert got == [want.format(i=i) for i in range(6)]


def test_shared_words_within_a_block_and_shared_links(spark):
    page = "<body><div>Site</div><div><p><b>Abstract.</b> Number {i}<i> ends.</i></p><p><a href=/>Back to the start</a></p></div></body>"
    got = extracted(spark, [(f"https://h/{i}", page.format(i=i)) for i in range(8)])
    assert got == [f"Abstract. Number {i} ends." for i in range(8)]


def test_pages_without_a_host_have_no_template(spark):
    page = "<body><div>Site</div><div><p>Own {i}</p></div></body>"
    urls = [None, "no scheme", "", "https:///path"]
    got = extracted(spark, [(urls[i % 4], page.format(i=i)) for i in range(16)])
    assert got == [f"Site\n\nOwn {i}" for i in range(16)]


def test_shapes_grow_with_the_page():
    """Classes side by side, and classes each around the next, give rows in proportion to their number."""
    names = [f"x{k}" for k in range(400)]
    for page in ("".join(f"<{n}></{n}><{n}b></{n}b>" for n in names), "".join(f"<{n}>" for n in names) + "".join(f"<{n}.>" for n in reversed(names))):
        tokens = [html_extract.token_hash(p, t) for p, t, *_ in html_extract.parse(page)]
        side = "</" in page
        places = {t: (i // 2, i % 2) if side else (min(i, 799 - i), i // 400) for i, t in enumerate(tokens)}
        assert len(places) == 800
        found = list(html_extract.shapes(page, places))
        assert len(found) == (400 if side else 799)
        assert html_extract.BROKEN not in {x for _, _, x in found}


def test_one_slot_of_one_class():
    """A class in two slots of the one around it, or in two classes, is broken; in one slot of each occurrence it is not."""
    tokens = {"a": (0, 0), "b": (0, 1), "c": (0, 2), "x": (1, 0), "y": (1, 1), "k": (2, 0), "l": (2, 1)}
    lie = lambda word: {(a, b): s for a, b, s in html_extract._shapes(list(word), tokens) if a != b}
    assert lie("axybcaxybc") == {(0, 1): 1}
    assert lie("abxycabxyc") == {(0, 1): 2}
    assert lie("axybxyc") == {(0, 1): html_extract.BROKEN}
    assert lie("axybckxyl") == {(0, 1): html_extract.BROKEN, (1, 2): html_extract.BROKEN}
    assert lie("xabcy") == {(0, 1): -1}
    assert lie("abcxy") == {}
    assert lie("axbyc") == {(0, 1): html_extract.BROKEN}


def test_classes_without_one_order_are_no_template(spark):
    """Lines found on all pages of the host, but shuffled by page, are not its frame."""
    page = "<body><div>Top</div>{lines}<div>End</div></body>"
    lines = ["<h2>one</h2>", "<h3>two</h3>", "<h4>three</h4>"]
    rows = [(i, f"https://h/{i}", page.format(lines="".join(lines[i % 3 :] + lines[: i % 3]) + f"<p>{i}</p>")) for i in range(9)]
    got = rows_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert all("one" in r["text"] and "two" in r["text"] and "three" in r["text"] for r in got)


def test_shapes():
    tokens = [html_extract.token_hash(p, t) for p, t, *_ in html_extract.parse("<a><b><i><u>")]
    outer_inner = {tokens[0]: (0, 0), tokens[3]: (0, 1), tokens[1]: (1, 0), tokens[2]: (1, 1)}
    assert [s for a, b, s in html_extract.shapes("<a><b><i><u>", outer_inner) if a != b] == [1]
    crossing = {tokens[0]: (0, 0), tokens[2]: (0, 1), tokens[1]: (1, 0), tokens[3]: (1, 1)}
    assert [s for a, b, s in html_extract.shapes("<a><b><i><u>", crossing) if a != b] == [html_extract.BROKEN]


def test_copies_add_no_support(spark):
    """Pages without an article that are copies on one host keep their text, alone and beside other pages."""
    copy = "<body><h1>A title</h1><p>The first part.</p><p>The last part.</p></body>"
    rows = [(i, "https://alone/x", copy) for i in range(5)] + [(None, "https://beside/x", copy) for _ in range(8)]
    rows += [(100 + i, f"https://beside/{i}", f"<body><h2>B</h2><div>Own {i}</div></body>") for i in range(8)]
    got = rows_of(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))
    texts = [r["text"] for r in got if r["url"].endswith("/x")]
    assert len(got) == 21 and len(texts) == 13 and set(texts) == {"A title\n\nThe first part.\n\nThe last part."}
    assert sorted(r["text"] for r in got if not r["url"].endswith("/x")) == [f"Own {i}" for i in range(8)]
