from html.parser import HTMLParser

from quiverlake.llm.main_text import BLOCK, CONTAINER, FEATURES, HEADING, LABELLED, blocks, extract_main_text, grow, judge, main_text, tree

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site</h1><p>Welcome to the best site there is around here</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies to improve your experience on this site, please accept all of them now.</p></div>
<main><article><header><h1>Head &amp; line</h1><p>By somebody on some day</p></header><p>Real <b>text</b> one&nbsp;with
   caf&eacute; &#233;.<p>Short.</p><div class="ad">buy it now</div><form><p>Join our list</p><input name=x></form><p>See <a href=x>this</a> for more of it.</p><!-- <p>no</p> --></article>
<section class="comments"><h2>Comments</h2><p>I loved every single word of this great article, many thanks to the one who wrote it!</p></section></main>
<aside><p>Side words</p></aside><footer>&copy; somebody</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Head & line\nReal text one with café é.\nShort.\nSee this for more of it."


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<div></div>") == ""
    assert main_text("<article><p>One two three.</p><p>Four fi") == "One two three.\nFour fi"
    assert main_text('<article><p>One.</p><p class="x') == "One."
    assert main_text("<article><p>1 < 2 and 3 > 2</p><script>x") == "1 < 2 and 3 > 2"
    assert main_text("<article><p><b>A b<br><p>C d</p></article>") == "A b\nC d"
    assert len(main_text("<article>" + "<p>word word</p>" * 20_000)) == 20_000 * 10 - 1
    assert main_text("<article><p>" + '<a "' * 3000) is not None


def test_names_of_elements():
    keep = '<body class="with-sidebar"><article class="post no-comments"><p>Stays here.</p>'
    for drop in ('<p class="notice">x</p>', '<div class="cookie-banner"><p>x</p></div>', '<ol class="commentlist"><li>x</li></ol>', '<p hidden>x</p>', '<div style="display: none">x</div>', '<article class="comment"><p>x</p></article>', '<ul class="share-buttons"><li>x</li></ul>'):
        assert main_text(keep + drop + "<p>This too.</p></article></body>") == "Stays here.\nThis too.", drop


def test_tree_fits_its_table():
    assert sum(judge(r[:-1]) != r[-1] for r in LABELLED) <= 1


def test_pages_without_article():
    page = "<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div><p>" + "word " * 60 + "</p><p>" + "more " * 45 + "</p></div></body>"
    assert main_text(page).split("\n") == [("word " * 60).strip(), ("more " * 45).strip()]
    assert [b[1] for b in blocks(page)] == [1, 1, 60, 45]


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGE, None, None), (1, "u", PAGE, None, None), (2, None, None, "x", 1), (None, None, "", None, None)]
    got = sorted(map(tuple, extract_main_text(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "u", main_text(PAGE), len(main_text(PAGE)))] * 2 + [(2, None, "", 0), (None, None, "", 0)], key=str)
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []


LONG = "These words go on for as long as a paragraph of an article may go on, and then some more."


def test_names_that_say_it_only_alone():
    page = "<article><p>%s</p>%s<p>%s</p></article>"
    for keep in ('<p class="notice-period">%s</p>', '<p class="tags-explained">%s</p>', '<section id="related-work"><p>%s</p></section>'):
        assert main_text(page % (LONG, keep % LONG, LONG)).count(LONG) == 3, keep
        assert main_text(page % (LONG, keep % "Two words", LONG)).count("Two words") == 0, keep
    for drop in ('<p class="notice">%s</p>', '<p class="cookie-notice">%s</p>', '<div class="ad-slot"><p>%s</p></div>', '<div id="related"><p>%s</p></div>'):
        assert main_text(page % (LONG, drop % LONG, LONG)).count(LONG) == 2, drop


def test_forms_around_articles_and_foreign_elements():
    assert main_text(f"<form id=page><div><nav><a href=x>Home</a></nav><article><h1>Head line</h1><p>{LONG}</p><form><p>Mail me</p></form></article></div></form>") == f"Head line\n{LONG}"
    assert main_text(f'<article><p>One <svg class="i"/>two.</p><p>{LONG}</p><p>a <svg><text>no</text></svg>b</p></article>') == f"One two.\n{LONG}\na b"
    assert main_text("<article><p>Take <math><mi>x</mi><mo>+</mo><mn>1</mn></math> of it.</p><object data=f><p>Fall back.</p></object></article>") == "Take x+1 of it.\nFall back."


def test_neighbours_decide():
    """Without the neighbours' words and link densities the tree would judge blocks differently, in the table and on pages."""
    blind = grow(tuple((*r[:2], 0, 0.0, 0, 0.0, *r[6:]) for r in LABELLED))

    def by(tree, features):
        while len(tree) > 1:
            tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    wrong = sum(by(blind, (*r[:2], 0, 0.0, 0, 0.0, *r[6:-1])) != r[-1] for r in LABELLED)
    assert wrong >= 15 and all(judge(r[:-1]) == r[-1] for r in LABELLED)
    used = set()

    def walk(t):
        if len(t) > 1:
            used.add(FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree())
    assert {"links_before", "links_behind", "words_before", "words_behind"} <= used
    link, text = "<p><a href=x>A linked line here</a></p>", f"<p>{LONG}</p>"
    assert "linked" in main_text(f"<article>{text}{link}{text}</article>") and "linked" not in main_text(f"<article>{text}{link}{link}{link}</article>")
    assert "Label" in main_text(f"<article>{text}<p>Label</p>{text}</article>") and "Label" not in main_text(f"<article>{text}{link}<p>Label</p>{link}{text}</article>")


class Plain(HTMLParser):
    """Blocks with the standard library's parser: text, words, linked words, in an article, heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.linked, self.link, self.heading, self.raw, self.open = [], "", "", False, False, 0, []

    def close_block(self):
        words = self.parts.split()
        if words:
            self.out.append((" ".join(words), len(words), len(self.linked.split()), any(t in ("article", "main") for t in self.open), self.heading))
        self.parts = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.raw += 1
            self.close_block()
        elif tag == "a":
            self.link, self.linked = True, self.linked + " "
        elif tag == "br":
            self.parts += " "
        elif tag in BLOCK:
            self.close_block()
            self.link, self.heading = False, tag in HEADING
            if tag in CONTAINER:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.raw -= 1
        elif tag == "a":
            self.link, self.linked = False, self.linked + " "
        elif tag in BLOCK:
            self.close_block()
            self.link = self.heading = False
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.raw:
            self.parts += data
            self.linked += data if self.link else ""


def test_blocks_against_a_plain_parser(spark, sf_dir):
    pages = [r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    assert len(pages) > 20
    for page in pages:
        p = Plain()
        p.feed(page)
        p.close()
        p.close_block()
        assert [(b[0], b[1], b[2], b[4], b[5]) for b in blocks(page)] == p.out
