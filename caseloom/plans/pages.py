"""Forum pages: posts by software and by a site's own profile, threads that a page lists, the page behind it.

The pages are built from the conversations, each in the markup of one kind of software.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import threads
from .domain import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A post in each kind of markup: {n} its number, {a} author, {w} time, {t} text.  The last kind is broken.
KINDS = (
    ("phpbb", '<div id="p{n}" class="post bg2"><p class="author">by <a class="username" href="/u">{a}</a></p><time datetime="{w}">then</time><div class="postbody"><blockquote>as <blockquote>somebody</blockquote> said before</blockquote>{t}</div></div>'),
    ("xenforo", '<article class="message js-post" data-author="{a}" data-content="post-{n}"><time datetime="{w}">then</time><div class="bbWrapper"><blockquote>quoted</blockquote>{t}</div><div class="bbWrapper">a signature</div></article><article class="message message--notice"><div class="bbWrapper">a notice that is long enough to be taken for a post, but that nobody has written at all</div></article>'),
    ("ipsCommunity elComment_", '<article id="elComment_{n}" class="cPost ipsComment"><a href="/profile/7-x/" title="{a}"></a><span itemprop="name">{a}</span><time datetime="{w}"></time><div data-role="commentContent"><p>{t}</p></div></article><article>news from elsewhere that has no comment in it and is left alone whatever its length may be</article>'),
    ("woltlab wbbThreadList", '<li data-post-id="{n}" class="wbbPost"><a class="username" href="/u">{a}</a><time datetime="{w}"></time><div class="messageText"><div class="quoteBox"><div>quoted</div></div>{t}<div></div></div><div class="footer">share it</div></li>'),
    ("vbulletin showthread.php", '<div class="posthead">{n}</div><div class="postcontent" data-author="{a}"><time datetime="{w}"></time>{t}</div>'),
    ("custom", '<div class="head"><b class="who">{a}</b><span class="on" data-time="{w}">long ago</span></div><div class="outer show" id="m-{n}"><div class="inner">{t}<div class="cite">quoted</div></div><em>below</em></div>'),
    ("xenforo", '<article class="message" data-author="{a}" data-content="post-{n}"></section><time datetime="{w}"></i><div class="bbWrapper"><b><i>{t}</div></article>'),
)
PROFILE = threads.Profile("table.none, .page div.outer.show:not([class*='ad'])", "div.inner", ("b.who",), ("span.on",), "div.cite", "div.head")
LEAST = (80, 80, 80, 30, 80, 40, 80)


def built(spark, d):
    """page_id, url, html, software and profile: a page for each conversation."""
    shown = F.col("text")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        shown = F.replace(shown, F.lit(mark), F.lit(name))
    values = {"n": F.col("turn").cast("string"), "a": F.col("role"), "w": F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0")), "t": F.coalesce(shown, F.lit(""))}

    kind = (F.col("conv_id") % len(KINDS)).cast("int")
    post, head = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, markup) in enumerate(KINDS):
        post, head = F.when(kind == k, filled(markup, values)).otherwise(post), F.when(kind == k, F.lit(name)).otherwise(head)
    posts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("post")))), lambda x: x["post"]), "").alias("posts"))
    link = F.concat(F.lit("/thread/"), F.col("conv_id").cast("string"), F.lit("-page?a=1&amp;page=2#last"))
    pager = (
        F.when(kind == 0, F.concat(F.lit('<a class="next" href="/wrong">elsewhere</a><nav class="pager"><b><a href="'), link, F.lit('">on</a></b></nav>')))
        .when(kind == 1, F.concat(F.lit('<a href="'), link, F.lit('" rel="next">on</a>')))
        .when(kind == 2, F.concat(F.lit('<ul><li class="pages-next"> <a href="'), link, F.lit('">on</a></li></ul>')))
        .when(kind == 3, F.concat(F.lit("<a href='"), link, F.lit("' class='button next'>on</a>")))
        .otherwise("")
    )
    html = F.concat(F.lit('<!DOCTYPE html><html><head><title>a <b class="post"> title</title><script>var x = "<div class=\'post\'>";</script></head><body><!-- <div class="post"> --><div class="page" data-app="'), head, F.lit('">'), F.col("posts"), F.lit("</div>"), pager, F.lit("</body></html>"))
    pages = posts.select(F.col("conv_id").alias("page_id"), F.lit("https://forum.example/threads/").alias("url"), html.alias("html"))
    return pages.withColumn("software", T.forum_software(F.col("html"))).withColumn("profile", F.when(F.col("page_id") % len(KINDS) == 5, "custom"))


def filled(markup: str, values: dict):
    """The markup with its places filled, as one concatenation."""
    parts, rest = [], markup
    while rest:
        at, key = min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=(len(rest), ""))
        if rest[:at]:
            parts.append(F.lit(rest[:at]))
        if key:
            parts.append(values[key])
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


_LINES = "array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(quote|report|share|like|reply)$')), chr(10))"


@query(
    f"""SELECT conv_id AS page_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS number, role AS author, concat('2024-01-', lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0')) AS "when",
    CASE WHEN conv_id % 7 IN (3, 4) THEN '' ELSE CAST(turn AS VARCHAR) END AS post_id, md5(CASE WHEN conv_id % 7 = 2 THEN concat(role, ' ', t) ELSE t END) AS text_md5
    FROM (SELECT *, {_LINES} AS t FROM conversations) WHERE length(CASE WHEN conv_id % 7 = 2 THEN concat(role, ' ', t) ELSE t END) >= [{', '.join(map(str, LEAST))}][conv_id % 7 + 1]"""
)
def forum_posts(spark, d):
    """Posts, authors, times and numbers of seven kinds of pages, broken ones among them."""
    found = threads.posts_of_pages(built(spark, d), {"custom": PROFILE})
    return found.select("page_id", "number", "author", "when", "post_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT DISTINCT conv_id AS page_id, CASE WHEN conv_id % 7 < 4 THEN concat('https://forum.example/thread/', CAST(conv_id AS VARCHAR), '-page?a=1&page=2') END AS next_page FROM conversations")
def next_pages(spark, d):
    return threads.next_pages(built(spark, d), "nav.pager")


@query(
    """WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS base, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]+</a>')) AS a, generate_subscripts(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]+</a>'), 1) AS pos FROM pages),
    l AS (SELECT page_id, pos, concat(base, regexp_replace(replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&'), '#.*$', '')) AS link, trim(replace(regexp_extract(a, '>([^<]+)<', 1), '&amp;', '&')) AS title FROM a),
    o AS (SELECT page_id, link, min(pos) AS pos, arg_min(title, pos) AS title FROM l WHERE title <> '' AND NOT contains(link, '/login') AND NOT contains(link, '/register') GROUP BY 1, 2)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS number, link, title FROM o"""
)
def thread_links(spark, d):
    return threads.thread_links(table(spark, d, "pages"), "nav ul li a[href], div.none a")
