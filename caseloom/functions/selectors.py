"""Selectors over the tags of a page, compiled once and matched in one walk.

A selector is a list of segments (tag, .class, [attribute], :not(...)) with descendants between them;
commas join alternatives.  Each open element carries, per alternative, how many segments it and its
ancestors have met in order (the outermost that fits is never a worse choice), so that a tag is tested
against one segment and no ancestor twice.  Combinators other than descent count as descent, and ids
are not looked at.

Malformed pages: a comment, section or declaration that never closes hides the rest; so does a tag
whose quotes or bracket never close, and a script, style, template, textarea or title; a closing tag
without its opening one is ignored and closes what is open inside its own; an element that never closes
reaches to the end of its scope.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title".split())
#: The named references of attributes that are resolved.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"'}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?](?:"[^"]*"|'[^']*'|[^>"'])*+(?:>|\Z)|<\s*(?P<close>/?)\s*(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*+)>|(?P<open><)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NEEDED = re.compile(r"""\[([a-zA-Z0-9_:-]+)([*^$|~/]?=)?(?:"([^"]*)"|'([^']*)')?\]""")
_TESTS = {
    "=": lambda a, v: a == v,
    "*=": lambda a, v: v in a,
    "^=": lambda a, v: a.startswith(v),
    "$=": lambda a, v: a.endswith(v),
    "~=": lambda a, v: v in a.split(),
    "|=": lambda a, v: a == v or a.startswith(v + "-"),
    "/=": lambda a, v: re.search(v, a) is not None,  # a pattern, which no style sheet has
}


@dataclass
class Tag:
    name: str
    rest: str
    start: int
    end: int
    kind: str  # open, close or alone
    close: int = -1  # the place of the tag that closes it
    _attrs: dict[str, str] | None = None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {m[1].lower(): next((g for g in m.group(2, 3, 4) if g is not None), "") for m in _ATTRIBUTE.finditer(self.rest)}
        return self._attrs


class Page:
    """A page's tags in order, opening ones with the place of their closing one."""

    def __init__(self, html: str | None):
        self.html = html or ""
        self.tags: list[Tag] = []
        opened: dict[str, list[int]] = {}
        at = 0
        while m := _TAG.search(self.html, at):
            at = m.end()
            if m["open"]:
                if self.html.find(">", at) < 0 or re.match(r"\s*/?\s*[a-zA-Z]", self.html[at : at + 64]):
                    break  # it never closes
                continue
            if not m["name"]:
                continue
            name = m["name"].lower()
            alone = name in VOID or m["rest"].rstrip().endswith("/")
            kind = "close" if m["close"] else "alone" if alone else "open"
            place = len(self.tags)
            self.tags.append(Tag(name, m["rest"], m.start(), at, kind))
            if kind == "open":
                opened.setdefault(name, []).append(place)
            elif kind == "close" and opened.get(name):
                self.tags[opened[name].pop()].close = place
            if kind == "open" and name in RAW:
                ends = re.compile(rf"</\s*{name}\s*>", re.I).search(self.html, at)
                if not ends:
                    break
                at = ends.start()

    def inner(self, place: int, stop: int) -> tuple[int, int]:
        """Places of the tags inside an element; `stop` bounds those that never close."""
        close = self.tags[place].close
        return place + 1, close if 0 <= close < stop else stop

    def text_of(self, place: int, stop: int, end: int) -> tuple[int, int]:
        """Where an element's content starts and ends; `stop` and `end` bound those that never close."""
        close = self.tags[place].close
        return self.tags[place].end, self.tags[close].start if 0 <= close < stop else end


def _plain(segment: str):
    """A test of one tag for tag.class[attribute], None if it asks for nothing."""
    bare = re.sub(r"\[[^\]]+\]", "", segment)
    tag = m[1].lower() if (m := re.match(r"\s*([a-zA-Z][\w-]*)", bare)) else None
    classes = frozenset(re.findall(r"\.([a-zA-Z0-9_-]+)", bare))
    needed = [(m[1].lower(), m[2], m[3] if m[3] is not None else m[4] or "") for m in _NEEDED.finditer(segment)]
    if not tag and not classes and not needed:
        return None

    def test(t: Tag) -> bool:
        if tag and t.name != tag:
            return False
        if classes and not classes <= set(t.attrs.get("class", "").split()):
            return False
        return all(name in t.attrs and (op is None or _TESTS[op](t.attrs[name], value)) for name, op, value in needed)

    return test


def _segment(text: str):
    unwanted = [p for p in map(_plain, re.findall(r":not\(([^()]+)\)", text)) if p]
    wanted = _plain(re.sub(r":not\([^()]+\)", "", text))
    if wanted is None and not unwanted:
        return None
    return lambda t: (wanted is None or wanted(t)) and not any(u(t) for u in unwanted)


@lru_cache(4096)
def compiled(selector: str) -> tuple[tuple, ...]:
    """The alternatives of a selector, each a list of tests from the outermost ancestor to the target."""
    out = []
    for part in (selector or "").split(","):
        tests = [_segment(s) for s in part.split()]
        if tests and tests[-1] is not None:
            out.append(tuple(t for t in tests if t is not None))
    return tuple(out)


def walk(page: Page, selector: str, lo: int, hi: int, anchors: bool = False):
    """Places of the elements in [lo, hi) that match, outermost ones only.

    With `anchors`, only anchors count, whole ones hide what they hold, and they are no ancestors.
    """
    ways = compiled(selector)
    stack: list[tuple[str, list[int]]] = [("", [0] * len(ways))]  # what is open, and how many segments it has met
    at = lo
    while at < hi and ways:
        tag = page.tags[at]
        met = stack[-1][1]
        if tag.kind == "close":
            inmost = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag.name), len(stack))
            del stack[inmost:]
        elif anchors and tag.name == "a" or not anchors and tag.kind == "open":
            found = any(n == len(way) - 1 and way[-1](tag) for way, n in zip(ways, met, strict=True))
            if found:
                yield at
            if found or anchors:
                at = tag.close if 0 <= tag.close < hi else at
            else:
                stack.append((tag.name, _below(ways, met, tag)))
        elif tag.kind == "open":
            stack.append((tag.name, _below(ways, met, tag)))
        at += 1


def _below(ways, met: list[int], tag: Tag) -> list[int]:
    return [n + (n < len(way) - 1 and way[n](tag)) for way, n in zip(ways, met, strict=True)]


def resolved(value: str) -> str:
    """References of an attribute's value."""
    for name, char in NAMED.items():
        value = re.sub(f"&{name};", char, value, flags=re.I)

    def code(m: re.Match) -> str:
        n = int(m[1], 16 if m[0][2] in "xX" else 10)
        return chr(n) if n <= 0x10FFFF else ""

    return re.sub(r"&#x([0-9a-f]+);", code, re.sub(r"&#(\d+);", code, value), flags=re.I)
