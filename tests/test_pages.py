"""Selectors and forum pages on markup worked out by hand."""

import pytest

from caseloom.functions.selectors import Page, resolved, walk
from caseloom.operators import threads
from caseloom.operators.threads import Profile


def starts(html, selector, anchors=False):
    page = Page(html)
    return [page.html[page.tags[i].start : page.tags[i].end] for i in walk(page, selector, 0, len(page.tags), anchors)]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("div", ["<div class='a b'>", "<div data-x=\"1 2\">"]),
        ("div.b.a", ["<div class='a b'>"]),
        (".a p", ["<p id=one>", "<p lang='en-GB'>"]),
        ("section p", ["<p id=one>"]),
        (".a section > p.c, .b em", []),
        ("p[lang]", ["<p lang='en-GB'>"]),
        ("p[lang|='en']", ["<p lang='en-GB'>"]),
        ("p[lang='en']", []),
        ("[data-x~='2']", ['<div data-x="1 2">']),
        ("[id^='on'], [lang$='GB'], [data-x*='1']", ["<p id=one>", "<p lang='en-GB'>", '<div data-x="1 2">']),
        ("p:not([lang])", ["<p id=one>"]),
        ("div:not(.a):not(.z)", ['<div data-x="1 2">']),
        ("", []),
        (">", []),
    ],
)
def test_selectors(selector, want):
    html = "<!-- <div class='a'> --><div class='a b'><section><p id=one>x</p></section><p lang='en-GB'>y</p></div><br><div data-x=\"1 2\">z</div><script>'<div>'</script>"
    assert starts(html, selector) == want


def test_broken_pages():
    assert starts("<div><p>one</div><p>two", "p") == ["<p>", "<p>"]
    assert starts("<div></span></i><p>one</p></div>", "div p") == ["<p>"]
    assert starts("<p>one</p><!-- <p>two</p>", "p") == ["<p>"]
    assert starts("<p>one</p><b title=\"x><p>two</p>", "p") == ["<p>"]
    assert starts("<p>one</p><script>var a = '<p>'", "p") == ["<p>"]
    assert starts("1 < 2 and 3 > 2 <p>one</p>", "p") == ["<p>"]
    assert starts("<p", "p") == starts("", "p") == starts(None, "p") == []
    assert starts("<![CDATA[<p>]]><?php <p ?><p>", "p") == ["<p>"]
    deep = "<div>" * 20_000 + "<p>" + "</div>" * 20_000
    assert starts(deep, "div.none p, p") == ["<p>"]


def test_what_matches_hides_what_it_holds():
    html = '<div class="post" id="p1">a<div class="post" id="inner">b</div></div><div class="post" id="p2">c</div>'
    assert starts(html, "div.post") == ['<div class="post" id="p1">', '<div class="post" id="p2">']


def test_references():
    assert resolved("?a=1&amp;b=&#38;c&#x41;&QUOT;&#1114112;&copy;") == '?a=1&b=&cA"&copy;'


CARD = """<div class="Card js-post" id="js-post-{n}" data-author="Ann"><header><h4 class="name"><span class="username">Ann</span></h4><time class="u-dt">{w}</time></header>
<article class="body"><div class="bbWrapper"><blockquote class="q">Bob said: reset it</blockquote>{t}</div></article></div>"""
CARDS = Profile("div.Card.js-post", "article.body .bbWrapper", ("h4.name .username",), ("time.u-dt",), "blockquote.q", least=20)
FIRST, SECOND = "The idle was rough and a warning light flashed after a cold start.", "A new throttle body was fitted; the light is gone. Fixed!"


def pages(spark, *rows):
    return spark.createDataFrame([(i, "https://f.example/t/1", html, software, profile) for i, (html, software, profile) in enumerate(rows)], "page_id long, url string, html string, software string, profile string")


def test_posts_by_profile_and_software(spark):
    cards = CARD.format(n=1001, w="2026-05-01", t=FIRST) + CARD.format(n=1002, w="2026-05-02", t=SECOND)
    attribute = f"""<article data-role="comment" id="comment-501"><aside><a data-mentionname="Hyn" href="/profile/42/"><img src="/a.jpg"></a></aside>
      <div><time datetime="2026-04-10T08:00:00Z"></time><div class="wrap">{FIRST}</div></div></article>"""
    heads = f'<div class="head"><b>Al</b><i>May 1</i></div><div class="body">{FIRST}</div><div class="head"><b>Bo</b></div><div class="body">{SECOND}</div><div class="body">{FIRST} Again.</div>'
    entries = f'<section class="entry" data-author="Al"><div>{FIRST} {FIRST}</div></section>'
    found = threads.posts_of_pages(
        pages(spark, (cards, "xenforo", "cards"), (cards, "xenforo", None), (attribute * 2, "invision", "ips"), (heads, "generic", "heads"), (entries, "generic", "entry"), (None, "generic", "cards"), ("", None, None)),
        {
            "cards": CARDS,
            "ips": Profile("article[data-role='comment']", ".wrap", ("a[data-mentionname]",), ("time[datetime]",), least=20),
            "heads": Profile("div.body", header="div.head", author=("b",), date=("i",)),
            "entry": Profile(".entry", author=("@data-author",)),
        },
    )
    rows = [tuple(r) for r in found.orderBy("page_id", "number").collect()]
    assert rows == [
        (0, 1, "Ann", "2026-05-01", "1001", FIRST),
        (0, 2, "Ann", "2026-05-02", "1002", SECOND),
        (2, 1, "Hyn", "2026-04-10T08:00:00Z", "501", FIRST),
        (2, 2, "Hyn", "2026-04-10T08:00:00Z", "501", FIRST),
        (3, 1, "Al", "May 1", "", FIRST),
        (3, 2, "Bo", "", "", SECOND),
        (3, 3, "Bo", "", "", FIRST + " Again."),
        (4, 1, "Al", "", "", f"{FIRST} {FIRST}"),
    ]


def test_short_posts_are_left_out(spark):
    html = '<div class="msg"><div class="body">ok</div></div>' + "".join(f'<div class="msg"><div class="body">{t}</div></div>' for t in (FIRST, SECOND))
    found = threads.posts_of_pages(pages(spark, (html, "generic", "m")), {"m": Profile("div.msg", ".body", least=30)})
    assert [(r.number, r.text) for r in found.orderBy("number").collect()] == [(1, FIRST), (2, SECOND)]


BOARD = """<div class="last"><a class="lastLink topic" href="/index.php?thread/123-a/#post9"> Solved <b>injector</b> issue </a></div>
<table class="list"><tr><td><a class="groupLink topic" href="index.php?thread/456-b/&amp;x=1">ABS warning fixed</a></td></tr><tr><td><a class="groupLink topic" href="/index.php?thread/123-a/">Again</a>
<a class="groupLink topic" href="/login?thread">Sign in</a><a class="groupLink topic" href="/index.php?thread/7-c/"><img src="x"></a></td></tr></table>
<!-- <div class="list"> --><div data-t="<div class='list'><a class='groupLink' href='/poison'>x</a></div>">y</div><div class="other"><a class="groupLink topic" href="/outside">Outside</a></div>"""
TOPICS = '<div class="bg"><ul class="topics x"><li class="row sticky"><a class="topic" href="/viewtopic.php?t=1">Sticky</a></li><li class="row"><a class="topic" href="/viewtopic.php?t=2">Real</a></li><li class="row"><a class="topic" href="/viewtopic.php?p=9">Post</a></li></ul></div>'


@pytest.mark.parametrize(
    ("html", "selector", "want"),
    [
        (BOARD, ".lastLink.topic, .list a.groupLink.topic", [("https://f.example/index.php?thread/123-a/", "Solved injector issue"), ("https://f.example/t/index.php?thread/456-b/&x=1", "ABS warning fixed")]),
        (BOARD, "a[href*='?thread/']", [("https://f.example/index.php?thread/123-a/", "Solved injector issue"), ("https://f.example/t/index.php?thread/456-b/&x=1", "ABS warning fixed")]),
        (TOPICS, ".bg .topics.x li.row:not([class*='sticky']):not([class*='announce']) a.topic[href*='viewtopic.php']:not([href*='p='])", [("https://f.example/viewtopic.php?t=2", "Real")]),
        (TOPICS, "", []),
    ],
)
def test_thread_links(spark, html, selector, want):
    found = threads.thread_links(pages(spark, (html, None, None)), selector).orderBy("number").collect()
    assert [(r.link, r.title) for r in found] == want and [r.number for r in found] == list(range(1, len(want) + 1))


def test_next_pages(spark):
    pager = '<a class="next" href="/wrong">x</a><nav class="pageNav"><a class="jump jump--next" href="/forum/page-2#last">on</a></nav>'
    rows = [pager, '<a href="/a" class="btn next">x</a>', '<a rel="next" href="b?x=1&amp;y=2">x</a>', '<li class="arrow next">\n<a href="/c">x</a></li>', '<a href="/d">next</a>', None]
    asked = pages(spark, *((h, None, None) for h in rows))
    got = {r.page_id: r.next_page for r in threads.next_pages(asked, ".pageNav a.jump--next").collect()}
    assert got == {0: "https://f.example/forum/page-2", 1: "https://f.example/a", 2: "https://f.example/t/b?x=1&y=2", 3: "https://f.example/c", 4: None, 5: None}
    inside = {r.page_id: r.next_page for r in threads.next_pages(asked, "nav.pageNav").collect()}
    assert inside[0] == "https://f.example/forum/page-2"
    assert threads.next_pages(asked).where("page_id = 0").first().next_page == "https://f.example/wrong"
