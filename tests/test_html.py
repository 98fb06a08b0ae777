import html as stdlib_html
from html.parser import HTMLParser

from pyspark.sql import functions as F

from midyear import constants as K
from midyear.functions import html as H
from verification import views


def results(spark, docs, column):
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, html string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


TEXTS = {
    "<p>a<br>b</p>": "\n\n\n ab",
    "<p>x<p>y": "\n\n\n x\n\n\n y",
    "<h12>t</h12>": "\n\n\n t",
    "<h123>t</h123>": "",
    "<p>  </p>": "",
    "<p>l1\n\n  l2\r\n</p>": "\n\n\n l1 l2",
    "<p>l1\x0bl2 l3\x85l4</p>": "\n\n\n l1 l2 l3 l4",
    "<script>var t='</p><p>no</p>'</script><p>yes</p>": "\n\n\n yes",
    "<p>in<!-- <p>c</p> --> p</p>": "\n\n\n in p",
    "<style>p{}</style><P CLASS='k'>up</P>": "\n\n\n up",
    "<h1><div>x</div> y</h1>z": "\n\n\n x y",
    "<div><h1>x</div>y": "\n\n\n x",
    "<p>a<div>b</div>": "\n\n\n a",
    "<article><p>a</article>b": "\n\n\n a",
    "<p><b>a</b> &amp; &copy;&#233;&#x1F600; &bogus; &lt</p>": "\n\n\n a & ©é😀 &bogus; &lt",
    "<p>&nbsp;a&nbsp;</p>": "\n\n\n a",
    "<p>1 < 2 <3 <> 4 > 0</p>": "\n\n\n 1 < 2 <3 <> 4 > 0",
    "<pre>q</pre><param>r<hr>": "",
    "<p>cut <b": "\n\n\n cut",
    "<p>a</p><!-- never closed <p>b</p>": "\n\n\n a",
    "": "",
}


def test_page_texts(spark):
    got = results(spark, list(TEXTS), H.page_text(F.col("html")))
    assert dict(zip(TEXTS, got)) == TEXTS


TITLES = {
    "<title> T &lt;x&gt;\n</title>": " T <x>\n",
    "<TITLE lang=en>a</TITLE><title>b</title>": "a",
    "<!-- <title>no</title> --><title>yes</title>": "yes",
    "<script>'<title>no</title>'</script><p>": "",
    "<title></title>": "",
    "<title>open": "open",
    "<p>none": "",
}


def test_titles(spark):
    assert dict(zip(TITLES, results(spark, list(TITLES), H.title(F.col("html"))))) == TITLES
    assert results(spark, ["<p>", "<title>t</title>"], H.title_or_fallback(F.col("html"))) == ["No_title", "t"]


def test_hrefs(spark):
    page = (
        "<a href='x&amp;y'>1</a><A class=b HREF = \"/q\">2</A><a data-href='no' href=bare>3</a><a name=x>4</a>"
        "<!--<a href=c>--><a\nhref=''>e</a><a href='x&y'>again</a><abbr href=no></abbr><script><a href=s></script>"
    )
    assert results(spark, [page], H.hrefs(F.col("html"))) == [["", "/q", "bare", "x&y"]]


def test_visible_texts(spark):
    page = "<head><title>t</title><style>s</style></head><body>a<!-- c --><b>b</b> <script>x</script>&amp;"
    pages = {
        page: ["a", "b", "&"],
        "<head>loose<title>t</title></head><p>x</p>": ["x"],
        "out<div>in<br>side</div>out": ["in", "side"],
        "<html> <head><meta name=a>m<link>l</head>h<p>a<p>b</i></p>c</p>d</html>e": ["h", "a", "b", "c", "d"],
        "<p>a<div/>b<HEAD>no<b>yes</b></Head>c": ["a", "b", "yes", "c"],
        "no tags": [],
        "": [],
    }
    assert results(spark, list(pages), H.visible_texts(F.col("html"))) == list(pages.values())
    assert results(spark, [None], H.visible_texts(F.col("html"))) == [None]


class Blocks(HTMLParser):
    """Blocks by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.blocks, self.kind = [], None

    def is_block(self, tag):
        return tag == "p" or (tag[0] == "h" and tag[1:].isdigit() and len(tag) <= 3)

    def handle_starttag(self, tag, attrs):
        if self.is_block(tag):
            self.blocks.append("")
            self.kind = tag
        elif self.kind == "p" and tag in K.PARAGRAPH_CLOSERS:
            self.kind = None

    def handle_endtag(self, tag):
        if self.is_block(tag) or tag in K.CONTAINERS:
            self.kind = None

    def handle_data(self, data):
        if self.kind:
            self.blocks[-1] += data

    def handle_entityref(self, name):
        self.handle_data(stdlib_html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(stdlib_html.unescape(f"&#{name};"))


def text_by_parser(page):
    parser = Blocks()
    parser.feed(page)
    parser.close()
    text = ""
    for block in parser.blocks:
        if block.strip():
            text += "\n\n\n" + "".join(" " + line.strip() for line in block.strip().splitlines() if line.strip())
    return text


def test_page_texts_of_all_pages_match_the_parser(spark, tiny):
    rows = views.captures(spark, tiny).select("html", H.page_text(F.col("html")).alias("text")).collect()
    assert len(rows) == 50
    for row in rows:
        assert row.text == text_by_parser(row.html)


def test_long_pages_do_not_recurse(spark):
    page = "<p>" + "a < b & c <i>d</i> " * 40_000 + "</p>" + "<div><a href=x>" * 40_000
    sizes = results(spark, [page], F.struct(F.length(H.page_text(F.col("html"))), F.size(H.hrefs(F.col("html")))))
    assert tuple(sizes[0]) == (len("a < b & c d ") * 40_000 - 1 + 4, 1)


ORDINARY = [
    ("<p title='a > b'>text</p>", ["text"], []),
    ("<a title='x > y' href='/z'>k</a>", [], ["/z"]),
    ('<a class="b"href="/q">k</a>', [], ["/q"]),
    ('<a title="say href=x" href="/y">k</a>', [], ["/y"]),
    ("<a href=/x?a=\"b>k</a><a HREF = '/w'>", [], ["/w", '/x?a="b']),
    ("<p data=it's>one</p><p>it's</p>", ["one", "it's"], []),
    ("<p>&#00000065;&#x00000041;&#99999999;</p>", ["AA&#99999999;"], []),
    ('<p class="never closed>lost</p>', ["lost"], []),
]


def test_ordinary_attributes_and_references(spark):
    pages = [page for page, _, _ in ORDINARY]
    assert [list(b) for b in results(spark, pages, H.text_blocks(F.col("html")))] == [b for _, b, _ in ORDINARY]
    assert [list(h) for h in results(spark, pages, H.hrefs(F.col("html")))] == [h for _, _, h in ORDINARY]


def test_many_attributes_do_not_overflow(spark):
    page = "<p " + "a='>' " * 200_000 + ">text</p><a " + "b=c " * 200_000 + "href=/end>"
    assert list(results(spark, [page], H.text_blocks(F.col("html")))[0]) == ["text"]
    assert list(results(spark, [page], H.hrefs(F.col("html")))[0]) == ["/end"]
