import html
import re

from gridloom.llm import html_extract
from gridloom.llm.html_extract import extract, main_text, op1_html_extraction, stretches, to_lines

SF = "/root/testdata/sf0.01"


def plain(page):
    """The article of the test tables' pages, read off their fixed frame."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks) if x)


def test_whole_table_matches_frame(spark):
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op1_html_extraction(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_parts_outside_the_article_go():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <div id="cookie-notice">We use cookies and need your consent for all of them, really.</div>
    <div class="content"><h1>Head &amp; line</h1><p>First&nbsp;para
       graph with &lt;b&gt; signs and enough words to surge past the line that is asked for, and more.</p><!-- no -->
    <div class="ad">Buy this now, it is the very best offer in the whole world today, hurry up!</div>
    <p>Ok.</p><script>if (a < b) document.write("<p>x</p>")</script><form><input><p>Mail</p></form><p>Last words of it that go on for long enough to count as article text too.</p></div>
    <aside>Side text</aside><section class="comments"><article class="comment"><p>I disagree with all of this, at some length.</p></article></section>
    <footer>(c)</footer></body></html>"""
    text = main_text(page)
    assert text.startswith("Head & line\nFirst para graph with <b> signs") and text.endswith("too.")
    for gone in ("cookies", "Buy", "disagree", "Side", "Home", "Site", "(c)", "Mail", "document"):
        assert gone not in text


def test_headings_of_the_article_stay():
    words = "enough words to surge past the line that is asked for, and then some more of them to be safe. " * 2
    assert main_text(f'<div class="site-header">Site</div><div class="entry-header"><h1>Own</h1><p>{words}</p></div>').startswith("Own")
    assert main_text(f'<article><div class="header"><h1>Own</h1></div><p>{words}</p><div class="post-footer">Tags</div></article>') == "Own\n" + words.strip()


def test_edges(spark):
    rows = [(1, "u", None, 5), (2, "u", "", 5), (3, None, "no markup at all", 5), (4, "u", "<p>a<p class=ad>b<p>c", 5), (4, "u", "<p>a<p class=ad>b<p>c", 5), (5, "u", "<article><p>Be.</p><p>x " + "y" * 300000 + "</p></article>", 5), (6, "u", "<!-- open <p>x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert extract(pages).count() == 7 and extract(pages.limit(0)).count() == 0
    assert [got[i].text for i in (1, 2, 3, 6)] == ["", "", "no markup at all", ""]
    assert got[4].text == "a\nc"
    assert got[5].n_chars == 300006
    assert stretches(to_lines("<div>a</div><div>b</div>")) == [(0, 4, 1)]
    assert stretches(to_lines("<div>a</div><nav>x</nav><div>bc</div>")) == [(0, 1, 1), (4, 5, 2)]


def test_headings_and_short_paragraphs_in_their_own_boxes_stay():
    words = "enough words to surge past the line that is asked for, and then some more of them to be safe. " * 2
    menu = "<div><a href=a>One link</a> <a href=b>Another link</a></div>"
    parts = f"<div class=title><h1>T</h1></div><div><p>{words}</p></div><div><p>Short.</p></div>"
    want = f"T\n{words.strip()}\nShort."
    assert main_text(f"<body>{menu}<div class=post>{parts}</div>{menu}</body>") == want
    assert main_text(f"<body>{menu}{parts}</body>") == want
    refs = "<div><a href=c>A source</a></div>"
    assert main_text(f"<body>{menu}<div>{parts}{refs}<div><p>{words}</p></div></div></body>") == f"{want}\nA source\n{words.strip()}"
    assert main_text("<div><h2>A</h2></div><div><p>Both are short.</p></div>") == "A\nBoth are short."


WORDS = "enough words to surge past the line that is asked for, and then some more of them to be safe. " * 2


def test_names_that_only_hold_such_words_stay():
    page = f'<article><h2 id="related-work">Related work</h2><p class="notice-period">Notice.</p><div class="social-history">History.</div><section id="discussion"><p>{WORDS}</p></section><pre><span class="comment">// x</span></pre></article>'
    assert main_text(page) == f"Related work\nNotice.\nHistory.\n{WORDS.strip()}\n// x"
    for gone in ("related-posts", "cookie-notice", "socialShare", "comment-list", "ad", "left-sidebar", "sponsored box"):
        assert main_text(f'<article><p>{WORDS}</p><div class="{gone}">Gone.</div></article>') == WORDS.strip()


def test_window_and_surge_decide(monkeypatch):
    page = f"<div><div><p>Slogan</p></div></div><nav><a href=x>y</a></nav><div><p>{WORDS}</p></div><nav>z</nav><div><p>Tail.</p></div>"
    cards = "".join(f"<div><p>Short card number {i} of it.</p></div>" for i in range(4))
    assert main_text(f"<div>{page}</div>") == f"Slogan\n{WORDS.strip()}\nTail."
    alone = f"<div><p>Slogan</p></div><nav>x</nav><div>{page[len('<div><div><p>Slogan</p></div></div>'):]}</div>"
    blocks = f"<div><ul><li>{cards}</li></ul></div><nav>x</nav><div><p>{'w' * 90}</p></div>"
    found = {}
    for window, surge in ((3, 86), (1, 86), (40, 86), (3, 10**9), (3, 60)):
        monkeypatch.setattr(html_extract, "WINDOW", window)
        monkeypatch.setattr(html_extract, "SURGE", surge)
        found[window, surge] = (main_text(f"<section><div>{blocks}</div></section>"), main_text(alone), main_text(f"<table><tr><td>{cards}</td></tr></table><nav>n</nav><div><p>{'v' * 70}</p></div>"))
    assert len(set(found.values())) >= 3


def test_a_page_without_article():
    title, end = "<div><div class=top-story><h1>Title</h1></div></div>", "<section><div><p>Short end.</p></div></section>"
    assert main_text(f"<body><nav>n</nav>{title}<section><p>{WORDS}</p><p>{WORDS}</p></section>{end}<footer>f</footer></body>") == f"Title\n{WORDS.strip()}\n{WORDS.strip()}\nShort end."
    items = "".join(f"<li>Entry {i} with a few words.</li>" for i in range(30))
    assert main_text(f"<body><div>Site</div><nav>n</nav><div><ul>{items}</ul></div></body>").count("Entry") == 30


def test_markup_without_end_takes_time_in_proportion():
    import time

    start = time.perf_counter()
    for piece in ("<b ", "<b '", '<a href="', "<b'", "<!-", "</", "<script>", "<!--", "<textarea></textarea ", "<a b=' c=\" "):
        main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20
    start = time.perf_counter()
    assert main_text("<b " * 333_333) == "" and time.perf_counter() - start < 2
    assert main_text('<p title="a > b">x</p><p>don\'t <b>stop</b> it\'s</p><b class=x"y>z</b>') == "x\ndon't stop it's\nz"


def test_closing_tags_that_close_nothing_take_time_in_proportion():
    import time

    took = []
    for n in (5_000, 50_000):
        page = "<div>" * n + "<p>" + "words of the text " * 20 + "</p>" + "</td>" * n
        start = time.perf_counter()
        assert "words of the text" in html_extract.main_text(page)
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0] + 0.5 and took[1] < 5
