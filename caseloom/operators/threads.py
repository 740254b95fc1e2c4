"""Threads and their posts: assembled to one text, parsed back, and read from pages.

A page's elements are found in Arrow batches; a page's posts come out as rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selectors import Page, resolved, walk
from ..functions.text import clean_post, html_to_text

@dataclass(frozen=True)
class Profile:
    """Where a page's posts and their parts are, as selectors.

    `author` and `date` are tried in order; one that starts with @ is an attribute, taken from the first tag of the post
    that has it.  With `header`, both are read from the last header before the post.
    """

    post: str
    content: str = ""  # all of them, or the first one only; the whole post where there is none
    author: tuple[str, ...] = ()
    date: tuple[str, ...] = ()
    quote: str = ""
    header: str = ""
    least: int = 40  # characters of a post
    ids: tuple[tuple[str, str], ...] = (("id", r"(\d+)"), ("data-content", r"(\d+)"), ("data-post-id", r"(\d+)"), ("data-id", r"(\d+)"))
    own_id: bool = True  # looked for in the post's own tag only
    instead: str = ""  # posts, where `post` finds none
    first: bool = False
    holds: str = ""  # a pattern that a post's markup must match
    lacks: str = ""  # one that it must not match


_TIME = ("@datetime of time",)
#: Posts, bodies, authors, times and numbers by forum software, and the least length of a post.
SOFTWARE = {
    "phpbb": Profile(r"div.post, div[id/='^p\d+$']", "div.postbody", ("a.username", "span.username"), _TIME, "blockquote", least=80, ids=(("id", r"^p(\d+)$"), ("id", r"^post_content(\d+)$")), own_id=False, first=True, holds="(?i)postbody"),
    "xenforo": Profile("article.message", "div.bbWrapper", ("@data-author",), _TIME, "blockquote", least=80, ids=(("data-content", r"^post-(\d+)$"), ("id", r"^(?:js-)?post-(\d+)$")), own_id=False, instead="div.message", first=True, lacks=r"(?i)\bmessage--notice\b|\balert\b"),
    "invision": Profile("article", "", ("@data-author", "a[href*='/profile/']", "span[itemprop='name']"), _TIME, "blockquote", least=80, ids=(("data-commentid", "(.+)"), ("id", "^elComment_(.+)")), own_id=False, holds="(?i)commentContent|cPost|ipsComment|data-comment"),
    "woltlab": Profile("li[data-post-id]", "div.messageText", ("@data-author", "a.username"), _TIME, "div.quoteBox, blockquote", least=30, ids=(), first=True),
    "generic": Profile(r"div[class/='\bpost(body|content|_content)\b']", "", ("@data-author", "a.username"), _TIME, "blockquote", least=80, ids=(), instead="article"),
}
#: Attributes that hold an author or a time where the element has no text.
VALUES = ("datetime", "data-mentionname", "data-author", "data-username", "data-date", "data-time", "data-timestamp", "content", "title", "aria-label", "alt")
TIMES = ("datetime", "data-time", "data-timestamp", "data-date")

_POST = "struct<post_id: string, authors: array<string>, whens: array<string>, content: string>"


def _read(page: Page, selector: str, lo: int, hi: int, end: int, time: bool) -> list[str]:
    """What the first element of a selector may say, in order: markup or values of attributes."""
    if selector.startswith("@"):
        name, _, tag = selector[1:].partition(" of ")
        return next(([t.attrs[name]] for t in page.tags[lo:hi] if t.kind != "close" and t.name == (tag or t.name) and t.attrs.get(name)), [])
    place = next(walk(page, selector, lo, hi), None)
    if place is None:
        return []
    start, stop = page.text_of(place, hi, end)
    values = [page.tags[place].attrs.get(k, "") for k in (TIMES if time else VALUES)]
    if not time:
        return [page.html[start:stop], *values]
    return [*values, *_read(page, "@datetime of time", *page.inner(place, hi), stop, time), page.html[start:stop]]


def _posts(page: Page, profile: Profile) -> list[dict]:
    """The posts of a page, their parts still as markup."""
    n, html = len(page.tags), page.html
    places = list(walk(page, profile.post, 0, n)) or list(walk(page, profile.instead, 0, n))
    headers = list(walk(page, profile.header, 0, n))
    out = []
    for place in places:
        lo, hi = page.inner(place, n)
        start, stop = page.text_of(place, n, len(html))
        markup = html[page.tags[place].start : stop]
        if profile.holds and not re.search(profile.holds, markup) or profile.lacks and re.search(profile.lacks, markup):
            continue
        parts = []
        for body in walk(page, profile.content, lo, hi):
            parts.append((*page.inner(body, hi), *page.text_of(body, hi, stop)))
            if profile.first:
                break
        bodies = []
        for first, last, at, end in parts or [(lo, hi, start, stop)]:
            kept = []
            for quote in walk(page, profile.quote, first, last):
                kept += [html[at : page.tags[quote].start], " "]
                close = page.tags[quote].close
                at = page.tags[close].end if 0 <= close < last else end
            bodies.append("".join([*kept, html[at:end]]))
        scope = (place, hi, stop)
        if profile.header:
            above = bisect_left(headers, place) - 1
            scope = (0, 0, 0) if above < 0 else (*page.inner(headers[above], n), page.text_of(headers[above], n, len(html))[1])
        tags = page.tags[place : place + 1 if profile.own_id else hi]
        numbers = (m[1] for name, pattern in profile.ids for t in tags if t.kind != "close" and (m := re.search(pattern, t.attrs.get(name, ""))))
        out.append(
            {
                "post_id": next(numbers, ""),
                "authors": [v for way in profile.author for v in _read(page, way, *scope, False)],
                "whens": [v for way in profile.date for v in _read(page, way, *scope, True)],
                "content": "\n".join(bodies),
            }
        )
    return out


def _texts(posts: Column, least: Column | int) -> Column:
    """Posts whose own text is long enough, with author, time and text out of their markup."""
    said = lambda a: F.coalesce(F.get(F.filter(F.transform(a, lambda x: html_to_text(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    plain = F.transform(posts, lambda p: F.struct(said(p["authors"]).alias("author"), said(p["whens"]).alias("when"), p["post_id"].alias("post_id"), clean_post(html_to_text(p["content"]), least).alias("text")))
    return F.filter(plain, lambda p: p["text"] != "")


def posts_of_pages(pages: DataFrame, profiles: dict[str, Profile] | None = None, least: int | None = None) -> DataFrame:
    """(page_id, number, author, when, post_id, text) of `pages` (page_id, url, html, software and, with `profiles`, profile).

    A page's own profile holds where it finds two posts or more; else its software's does, or the generic one.  Python
    finds the elements, one row per page; texts are made by built-in functions, and nothing is shuffled.  Where a site's
    post, body or quote nests in itself, the outermost counts.  Null and empty pages have no posts.
    """
    own = profiles or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mine, engines, leasts = [], [], []
            for html, software, name in zip(pdf["html"], pdf["software"], pdf["profile"], strict=True):
                page, engine, special = Page(html), SOFTWARE.get(software, SOFTWARE["generic"]), own.get(name)
                mine.append(_posts(page, special) if special else [])
                engines.append(_posts(page, engine))
                leasts.append((special.least if special else 0, engine.least))
            yield pd.DataFrame({"page_id": pdf["page_id"], "own": mine, "engine": engines, "own_least": [a for a, _ in leasts], "engine_least": [b for _, b in leasts]})

    asked = pages.select("page_id", "html", "software", "profile" if profiles else F.lit(None).cast("string").alias("profile"))
    found = asked.mapInPandas(run, f"page_id long, own array<{_POST}>, engine array<{_POST}>, own_least int, engine_least int")
    read = found.select("page_id", _texts(F.col("own"), F.col("own_least")).alias("own"), _texts(F.col("engine"), F.col("engine_least") if least is None else least).alias("engine"))
    chosen = F.when(F.size("own") >= 2, F.col("own")).when(F.size("engine") > 0, F.col("engine")).otherwise(F.col("own"))
    rows = read.select("page_id", F.posexplode(chosen).alias("pos", "post"))
    return rows.select("page_id", (F.col("pos") + 1).alias("number"), "post.author", "post.when", "post.post_id", "post.text")


def _absolute(base: str | None, href: str) -> str | None:
    """A link against its page's address without its fragment; None where there is no such address."""
    try:
        url = urldefrag(urljoin(base or "", resolved(href).strip())).url
        return url if urlsplit(url).scheme else None
    except ValueError:
        return None


def _anchors(pages: DataFrame, selector: str | None) -> DataFrame:
    """(page_id, pos, link, markup) of the anchors that match, or of all, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                page = Page(html)
                n = len(page.tags)
                places = walk(page, selector, 0, n, anchors=True) if selector is not None else (i for i, t in enumerate(page.tags) if t.name == "a" and t.kind != "close")
                hrefs = [(i, page.tags[i].attrs.get("href")) for i in places]
                for pos, (i, href) in enumerate((i, h) for i, h in hrefs if h):
                    close = page.tags[i].close
                    rows.append((page_id, pos, _absolute(url, href) if selector is not None else urljoin(url or "", resolved(href)), page.html[page.tags[i].end : page.tags[close].start] if close >= 0 else ""))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "link", "markup"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, pos int, link string, markup string")


def links_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link) of every anchor, resolved against the page's address, in order."""
    return _anchors(pages, None).drop("markup")


def thread_links(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, number, link, title) of the threads that a page lists: each address once, with its first title.

    Anchors without a title, and those to sign in or up, are left out.
    """
    titled = _anchors(pages, selector).select("page_id", "pos", "link", html_to_text(F.col("markup")).alias("title"))
    kept = titled.where(F.col("link").isNotNull() & (F.col("title") != "") & ~F.col("link").contains("/login") & ~F.col("link").contains("/register"))
    once = kept.groupBy("page_id", "link").agg(F.min(F.struct("pos", "title")).alias("first"))
    by_place = Window.partitionBy("page_id").orderBy("first.pos")
    return once.select("page_id", F.row_number().over(by_place).alias("number"), "link", "first.title")


def _next_page(page: Page, url: str | None, selector: str | None) -> str | None:
    ways = [s.strip() for s in (selector or "").split(",") if s.strip()]
    asked = ", ".join(w for s in ways for w in (s, f"{s} a"))
    for i in walk(page, asked, 0, len(page.tags), anchors=True):
        if (href := page.tags[i].attrs.get("href")) and (link := _absolute(url, href)):
            return link
    named = lambda t, key: re.search(r"\bnext\b", t.attrs.get(key, ""), re.I)
    linked = [(i, t) for i, t in enumerate(page.tags) if t.name == "a" and t.kind != "close" and t.attrs.get("href")]
    in_item = [(i, t) for i, t in linked if i and (li := page.tags[i - 1]).name == "li" and li.kind == "open" and named(li, "class") and not page.html[li.end : t.start].strip()]
    for tags in ([x for x in linked if named(x[1], "class")], [x for x in linked if x[1].attrs.get("rel", "").lower() == "next"], in_item):
        for _, t in tags[:1]:
            if link := _absolute(url, t.attrs["href"]):
                return link
    return None


def next_pages(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """(page_id, next_page): the address of the page behind each, null at the last.

    An anchor of `selector`, or one inside it; else one of class next, of rel next, or first in a list item of class next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "next_page": [_next_page(Page(h), u, selector) for u, h in zip(pdf["url"], pdf["html"], strict=True)]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, next_page string")


def assembled(posts: DataFrame, title: Column | None = None) -> DataFrame:
    """One text per thread from posts (thread_id, number, author, when, post_id, text), in order."""
    ordered = F.array_sort(F.collect_list(F.struct("number", F.col("author").alias("author"), F.col("when").alias("when"), F.col("post_id").alias("post_id"), "text")))
    t = posts.groupBy("thread_id").agg(ordered.alias("p"), *([F.first(title).alias("title")] if title is not None else []))
    owner = F.get(F.filter(F.transform("p", lambda x: x["author"]), lambda a: F.coalesce(a, F.lit("")) != ""), 0)
    t = t.withColumn("owner", owner)
    given = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))

    def block(x: Column, i: Column) -> Column:
        who = F.coalesce(F.nullif(x["author"], F.lit("")), F.lit("unknown"))
        is_owner = F.coalesce(F.lower(x["author"]) == F.lower("owner"), F.lit(False)).cast("string")
        meta = F.concat_ws(" | ", F.concat(F.lit("author: "), who), F.concat(F.lit("is_thread_author: "), is_owner), given("when: ", x["when"]), given("post_id: ", x["post_id"]))
        return F.concat(F.lit("POST "), (i + 1).cast("string"), F.lit(" | "), meta, F.lit(":\n"), F.coalesce(x["text"], F.lit("")))

    head = F.concat_ws("\n", *([given("TITLE: ", F.col("title"))] if title is not None else []), given("THREAD_AUTHOR: ", F.col("owner")))
    return t.select("thread_id", F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.array_join(F.transform("p", block), "\n\n")).alias("thread_text"))


def parsed(threads: DataFrame) -> DataFrame:
    """The inverse: (thread_id, number, author, is_thread_author, body) of each thread_text."""
    parts = F.split("thread_text", r"(?m)^(?=POST\s+\d+\s*\|)")
    rows = threads.select("thread_id", F.explode(parts).alias("part")).where(F.col("part").rlike(r"^POST\s+\d+\s*\|"))
    head, body = F.split_part("part", F.lit("\n"), F.lit(1)), F.expr("substring(part, greatest(locate('\\n', part), 1) + 1)")
    return rows.select("thread_id", F.regexp_extract(head, r"^POST\s+(\d+)", 1).cast("int").alias("number"), F.trim(F.regexp_extract(head, r"\bauthor:\s*([^|]+?)\s*(?:\||:\s*$)", 1)).alias("author"), F.regexp_extract(head, r"\bis_thread_author:\s*(true|false)", 1).cast("boolean").alias("is_thread_author"), F.regexp_replace(body, r"\s+$", "").alias("body"))


def nearest_header(marks: DataFrame) -> DataFrame:
    """As-of join by position: bodies (page_id, pos, kind='body') with the last header before them.

    `marks`: page_id, pos, kind, value.  One window over both kinds, no range join.
    """
    before = Window.partitionBy("page_id").orderBy("pos", F.col("kind") == "body").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("kind") == "header", F.struct(F.col("pos").alias("header_pos"), F.col("value").alias("header"))), ignorenulls=True).over(before)
    return marks.withColumn("h", header).where("kind = 'body'").select("page_id", "pos", "value", "h.header", "h.header_pos")
