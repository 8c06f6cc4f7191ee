import time
from html.parser import HTMLParser
from zlib import crc32

import numpy as np

from setlist.llm import html_extract, langid


def test_ngrams_match_brute_force(monkeypatch):
    from collections import Counter

    text = "The cat, THE hat! été 3 x " * 7
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    want = Counter()
    for w in words:
        p = f"\x01{w}\x01"
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if n > 1 or g != "\x01":
                    code = 0
                    for c in g:
                        code = code << 21 | ord(c)
                    want[code] += 1
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(langid, "PIECE", piece)
        codes, counts = langid.ngram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == dict(want)
    assert len(langid.ngram_counts("")[0]) == len(langid.ngram_counts("12 %")[0]) == 0


def test_out_of_place_distance():
    a, b = np.array([5, 7, 9]), np.array([9, 5])
    m = langid.Model({"a": a, "b": b}, size=10)
    assert m.distances(np.array([7, 9, 11])).tolist() == [1 + 1 + 10, 10 + 1 + 10]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def grams(text):
    """The most frequent 1- to 3-grams of a text's words, ties by code points."""
    from collections import Counter

    n = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        p = f"\x01{w}\x01"
        n.update(p[i : i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i : i + k] != "\x01")
    return n


def code(gram):
    """Shorter n-grams are smaller numbers; 21 bits a code point."""
    return sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))


def test_whole_query_against_brute_force(spark, sf):
    from collections import Counter

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(7001, None, "en"), (7002, "12 %", "de"), (7003, "Straße ÉTÉ", None), (7004, "x " * 4000, "fr")], docs.schema)
    docs = docs.union(odd)
    rows = docs.collect()
    top = lambda n: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))[:300]]
    learned = {}
    for r in rows:
        if r.lang is not None and r.text is not None and crc32(str(r.doc_id).encode()) % 4 != 2:
            learned.setdefault(r.lang, Counter()).update(grams(r.text))
    ranks = {lang: {g: i for i, g in enumerate(top(n))} for lang, n in sorted(learned.items())}
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        mine = top(grams(r.text or ""))
        far = {lang: sum(abs(i - of[g]) if g in of else 300 for i, g in enumerate(mine)) for lang, of in ranks.items()}
        want = min(far, key=lambda lang: (far[lang], lang)) if mine else "und"
        score = 1 - far[want] / (300 * len(mine)) if mine else 0.0
        assert got[r.doc_id].lang_pred == want and abs(got[r.doc_id].score - score) < 1e-12, r.doc_id


def test_langid_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(None, "the house and the garden", "en", "x"), (1, None, "en", None), (3, "", None, None), (4, "123 %%", "de", None), (4, "the house and the garden", "en", None), (5, "der Hund und die Katze", "de", None)]
    got = {(r.doc_id, r.lang_pred) for r in langid.report(spark.createDataFrame(rows, schema)).collect()}
    assert {(1, "und"), (3, "und"), (4, "und"), (4, "en"), (None, "en")} <= got
    assert langid.report(spark.createDataFrame([], schema)).count() == 0
    assert {r.lang_pred for r in langid.report(spark.createDataFrame([(1, "abc", None, None)], schema)).collect()} == {"und"}
    kept = langid.reject(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "lang", "score"]


def test_main_text():
    nav = "<nav><a href=x>home</a></nav>"
    one = f"<html><head><title>t</title></head><body>{nav}<header>top</header><div class='side-bar'>s</div><article><h1>Head&amp;er</h1><p>One<br>two\n three<p><b>four</b> five<script>var a='</p>'</script><div class='comments'><p>nice</p></div></article><footer>f</footer>"
    assert html_extract.main_text(one) == "Head&er\nOne two three\nfour five"
    long = "word " * 80
    two = f"<body><div id=m>{'<a href=#>link text</a> ' * 9}</div><div><h2>Title</h2><p>{long}</p><p>{long}</p><p>short</p></div><div><form>f <input></form><a>x</a></div></body>"
    assert html_extract.main_text(two) == f"Title\n{long.strip()}\n{long.strip()}\nshort"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>a</nav>") == ""
    assert html_extract.main_text("plain &lt; text") == "plain < text"
    assert html_extract.main_text("<article>" + "<div>" * 5000 + "x" + "<a title='q") == "x<a title='q"


def test_reject_and_route(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [
        (9001, "Привет мир, это текст на другом языке", None), (9002, "xqzj wvkq zzpt qjxw kvvz xqq jzw qpz vwx zkj", "en"), (9003, "12 % 34", "en"), (9004, None, "en"), (9005, "", None), (None, "日本語の文章です", None),
    ]
    known = docs.where("lang = 'de' and n_chars > 500").limit(2).collect()
    odd += [(9010, known[0].text, None), (9011, known[1].text, "fr")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in langid.reject(rows).collect()}
    want = {r.doc_id: r for r in docs.collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert set(got) - set(want) == {9010, 9011} and got[9010].lang == got[9011].lang == "de"


class Marked(HTMLParser):
    """The text of the article element, block by block: what the generated pages hold as their main text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in html_extract.BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self.blocks.append("")
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_all_pages_match_brute_force_with_and_without_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.selectExpr("page_id", "url", "regexp_replace(html, '(</?)article', '$1div') html")
    want = {}
    for r in pages.collect():
        m = Marked()
        m.feed(r.html)
        want[r.page_id] = "\n".join(x for b in m.blocks if (x := " ".join(b.split())))
    for table in (pages, bare):
        got = html_extract.report(table).collect()
        assert len(got) == len(want) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_density_decides():
    long = "word " * 80
    # an article element that is not the densest part is no article
    assert html_extract.main_text(f"<body><article><a href=x>more</a></article><div><p>{long}</p><p>{long}</p></div></body>") == f"{long.strip()}\n{long.strip()}"
    # a heading beside the densest part, a short section and a list of links
    page = f"<body><div><h1>Title</h1><div><p>{long}</p><p>{long}</p></div><section><p>short</p></section><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></div><div><p>far</p></div></body>"
    assert html_extract.main_text(page) == f"Title\n{long.strip()}\n{long.strip()}\nshort"
    assert html_extract.main_text(f"<body><div class='related-work'><p>{long}</p></div></body>") == long.strip()
    assert html_extract.main_text(f"<body><article><p>{long}</p><p class='share-price'>up</p></article></body>") == f"{long.strip()}\nup"


def test_hostile_pages_take_linear_time():
    for unit in ("<b>", "<a x=\"", "<a x='\">", "</a", "<i><div><b></i>", "<li><b>", "<!x", "<td><b><tr>", "<script></script", "<header><b>", "<p><i>"):
        began = time.perf_counter()
        html_extract.main_text(unit * (100_000 // len(unit)))
        assert time.perf_counter() - began < 3, unit


def test_layout_names_keep_the_main_text():
    text = "word " * 60
    for name in ("content has-sidebar", "no-sidebar", "layout-with-banner", "comments-open", "page-with-menu", "sidebar-left-layout"):
        assert html_extract.main_text(f"<body><div class='{name}'><article><p>{text}</p></article></div></body>") == text.strip()
        assert html_extract.main_text(f"<body><div id={name.split()[-1]}><p>{text}</p></div></body>") == text.strip()
    for name in ("ad", "x sidebar", "sidebar-left", "ad_top", "Nav"):
        assert html_extract.main_text(f"<body><div class='{name}'><p>gone {text}</p></div><div><p>{text}</p></div></body>") == text.strip()
    # a dropped name around an article costs nothing of the article
    for name in ("widget", "related", "social share"):
        assert html_extract.main_text(f"<body><div class='{name}'><div><article><p>{text}</p><div class=ad>x</div></article></div></div></body>") == text.strip()


def test_names_never_cost_the_densest_part():
    text = "word " * 60
    body = text.strip()
    nav, foot = "<nav><a href=/>home</a> <a href=/x>x</a></nav>", "<footer><p>imprint of the site</p></footer>"
    # a page builder's layout, a page within one form, a header with the title
    assert html_extract.main_text(f"<body>{nav}<div class='widget'><h1>T</h1><p>{text}</p><p>{text}</p></div><div>Imprint</div></body>") == f"T\n{body}\n{body}"
    assert html_extract.main_text(f"<body><form id='aspnetForm'>{nav}<div><h1>T</h1><p>{text}</p><p>{text}</p><input value=v><select><option>o</option></select><button>b</button></div>{foot}</form></body>") == f"T\n{body}\n{body}"
    assert html_extract.main_text(f"<body><article><h1>T</h1><p>{text}</p><section id='social'><h2>S</h2><p>{text}</p></section></article></body>") == f"T\n{body}\nS\n{body}"
    assert html_extract.main_text(f"<html><head><title>T here - site</title></head><body><header><a href=/>home</a><h1>T here</h1></header><div><p>{text}</p><p>{text}</p></div></body>") == f"T here\n{body}\n{body}"
    # the name of the site is no heading, nor is a second h1
    assert html_extract.main_text(f"<html><head><title>T - site</title></head><body><header><h1>site</h1></header><div><h2>T</h2><p>{text}</p><p>{text}</p></div></body>") == f"T\n{body}\n{body}"
    assert html_extract.main_text(f"<title>T</title><body><header><h1>T</h1></header><div><h1>T</h1><p>{text}</p><p>{text}</p></div></body>") == f"T\n{body}\n{body}"
    # boilerplate by any word of its name
    for name in ("comment-list", "page-footer", "right-sidebar", "main-nav", "post_comments", "top-ad"):
        side = f"<div class='{name}'><p>{'other text ' * 9}</p></div>"
        assert html_extract.main_text(f"<body>{nav}<div><h1>T</h1><p>{text}</p><p>{text}</p></div>{side}</body>") == f"T\n{body}\n{body}", name
        assert html_extract.main_text(f"<body><article><h1>T</h1><p>{text}</p>{side}<p>{text}</p></article></body>") == f"T\n{body}\n{body}", name
        # and the main text under such a name stays
        assert html_extract.main_text(f"<body>{nav}<div class='{name}'><div><h1>T</h1><p>{text}</p><p>{text}</p></div></div>{foot}</body>") == f"T\n{body}\n{body}", name
    # comments are longer than the article here; a form of its own, notices and adverts go
    talk = "".join(f"<li><p>{text}</p></li>" for _ in range(5))
    assert html_extract.main_text(f"<body><article><p>{text}</p></article><ol class='comment-list'>{talk}</ol></body>") == body
    assert html_extract.main_text(f"<body><div><p>{text}</p><p>{text}</p></div><form><p>Write to us <input></p></form><div class=notice>old</div></body>") == f"{body}\n{body}"


def test_html_edges(spark):
    rows = [(1, "u", None, "old"), (1, "u", None, "old"), (None, None, "<article>x  y</article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got == [(0, "x y", 3), (1, "", 0), (1, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0
