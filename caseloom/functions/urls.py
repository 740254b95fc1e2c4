"""Addresses of threads and pages in one spelling."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query keys of sessions and campaigns, and those that point at a post of a thread.
PASSING = frozenset("sid s phpsessid session sessionid jsessionid fbclid gclid mc_cid mc_eid utm_source utm_medium utm_campaign utm_term utm_content".split())
POINTERS = frozenset(("p", "pid", "postid", "post_id"))
THREAD_PATH = re.compile(r"/(threads?|topic)/", re.IGNORECASE)
POSITION = re.compile(r"/(?:latest|unread|post-\d+|page-\d+|page/\d+)/?$", re.IGNORECASE)
UNRESERVED = "!'()*"


def traversal_url(raw: str | None) -> str:
    """Without fragment, session, campaign and, on threads, post keys; keys sorted."""
    raw = (raw or "").strip()
    try:
        parts = urlsplit(raw)
        host = parts.hostname
        port = parts.port
    except ValueError:
        return raw
    if not raw or not parts.scheme or (host is None and parts.scheme in ("http", "https", "ftp")):
        return raw
    path, query = re.sub(r"(?i);jsessionid=[^/?#]*", "", parts.path) or "/", parts.query
    path, cut, glued = path.partition("&")  # keys that lost their question mark
    query = "&".join(x for x in (query, glued if cut else "") if x)
    bare, keyed = [], []
    for segment in filter(None, query.split("&")):
        key, equals, value = segment.partition("=")
        if not equals:
            bare.append(segment)
            continue
        key, value = unquote(key.replace("+", " ")), unquote(value.replace("+", " "))
        if key.lower() not in PASSING:
            keyed.append((key, value))
    names = {k.lower() for k, _ in keyed}
    if THREAD_PATH.search(path) or names & {"t", "thread"}:
        keyed = [kv for kv in keyed if kv[0].lower() not in POINTERS]
    encoded = [f"{quote(k, safe=UNRESERVED)}={quote(v, safe=UNRESERVED)}" for k, v in sorted(keyed)]
    shown = (host or "") + (f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else "")
    return urlunsplit((parts.scheme, shown, path, "&".join([*bare, *encoded]), ""))


def thread_url(raw: str | None) -> str:
    """The thread's root: without page, post and latest positions behind it."""
    url = traversal_url(raw)
    parts = urlsplit(url)
    path = parts.path
    while parts.scheme and THREAD_PATH.search(path) and (cut := POSITION.sub("/", path)) != path:
        path = cut
    return urlunsplit(parts._replace(path=path)) if parts.scheme else url


@F.pandas_udf(StringType())
def canonical_thread(urls: pd.Series) -> pd.Series:
    return urls.map(thread_url)


@F.pandas_udf(StringType())
def canonical_page(urls: pd.Series) -> pd.Series:
    return urls.map(traversal_url)


def domain(url: Column) -> Column:
    """Host without www., null for what is no address."""
    return F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), r"^www\.", "")


#: What the address of a thread looks like, and what it doesn't.
THREAD = r"(?i)/topic/|(?:/|\?)thread/|viewtopic|showthread|/threads/|(?:/|\?)t\d|/discussion/"
NO_THREAD = r"(?i)/blogs?/|/tests?/|/news/|/articles?/|/reviews?/"
OWN_LENGTH = 2000  # of addresses that a forum's own pattern is tried on


def likely_thread(url: Column, own: str | None = None) -> Column:
    """Whether an address looks like a thread's; a forum's own pattern decides alone where it has one."""
    if own and own.strip():
        return F.coalesce((F.length(url) <= OWN_LENGTH) & url.rlike(f"(?i){own}"), F.lit(False))
    return F.coalesce(url.rlike(THREAD) & ~url.rlike(NO_THREAD), F.lit(False))
