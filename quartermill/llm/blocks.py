"""A page's blocks of text with what its markup says of them: one pass over the characters, nothing is ever parsed twice.

Tags, comments and attributes end where the HTML standard ends them, broken ones included,
so that time is linear in a page's length. Open elements are kept for structure alone:
inline markup only joins words, and elements nested over DEEPEST deep only part blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

# Fixed values of the HTML standard, by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: Whose content is no markup up to their own end tag; only of the last two is it text, of a head or a form.
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
#: Whose content is never text of the page.
UNSEEN = frozenset("template svg math canvas object audio video map select button datalist".split())
#: An element's start ends an open one of these kinds, if no element of the last group lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
CLOSE_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend optgroup option".split())
#: Beyond these an end tag without its own start tag reaches nothing.
SCOPES = frozenset("table td th article main aside nav header footer form section body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What an element's name, role, class and id say of its text: content, boilerplate whatever surrounds or fills it, or boilerplate unless an article lies inside.
CONTENT_TAGS = frozenset("article main".split())
OUTER_TAGS = frozenset("nav aside footer menu dialog search".split())
SHELL_TAGS = frozenset("header form fieldset".split())
CONTENT_ROLES = frozenset("main article".split())
OUTER_ROLES = frozenset("navigation complementary contentinfo search menu menubar dialog alertdialog".split())
SHELL_ROLES = frozenset("banner form alert status toolbar".split())
CONTENT_NAMES = frozenset("article articlebody content post entry story main hentry prose".split())
OUTER_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense adbox adslot adunit sponsor sponsored promo promotion promoted sidebar nav navbar navigation menu breadcrumb breadcrumbs
    footer comment comments commentlist discussion disqus respond replies reply cookie cookies consent gdpr newsletter subscribe subscription signup login signin social share sharing sharebar
    related recommended recommendations pagination pager popup modal overlay widget widgets copyright skip""".split()
)
SHELL_NAMES = frozenset("masthead topbar toolbar banner notice notices alert alerts disclaimer search searchbox form legal tags tools utility".split())
#: Names of states and layouts, not of an element's content, begin so.
STATES = ("has-", "with-", "no-", "is-", "js-")

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(?P<end>>)|(?P<name>[^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(?:\s*+=\s*+(?:(?P<quote>["'])|(?P<bare>[^\s>"'][^\s>]*+)?))?)""")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
USED = frozenset("class id role hidden style aria-hidden".split())
DEEPEST = 512


class Block(NamedTuple):
    """text; its path of open elements' numbers; the innermost element's tag; characters inside links; what the markup around it says: outer, shell, article, content or nothing."""

    text: str
    path: tuple[int, ...]
    tag: str
    linked: int
    says: str


class _Open:
    __slots__ = ("inside", "number", "outer", "shell", "tag")

    def __init__(self, tag: str, number: int, says: str, above: _Open | None):
        self.tag, self.number = tag, number
        self.outer = says == "outer" or (above.outer if above else False)
        # an article lifts the shells around it, not those inside it
        self.inside = says if says in ("article", "content") and not (above and above.inside == "article") else above.inside if above else ""
        self.shell = says == "shell" or (above.shell if above and says not in ("article", "content") else False)

    def says(self) -> str:
        return "outer" if self.outer else "shell" if self.shell else self.inside


def names_say(value: str, inside: str) -> str:
    """What the class or id names of an element say, by the last known word of each name."""
    verdicts = set()
    for name in value.split():
        if name.lower().startswith(STATES):
            continue
        words = [w.lower() for w in WORDS.findall(name)]
        for word in reversed(words):
            if word in OUTER_NAMES:
                verdicts.add("outer")
            elif word in SHELL_NAMES:
                verdicts.add("shell")
            elif word == "header":  # an article's is its title's place
                verdicts.add("" if inside or CONTENT_NAMES & set(words) else "shell")
            elif word in CONTENT_NAMES:
                verdicts.add("content")
            else:
                continue
            break
    if "content" in verdicts:
        return "content" if verdicts <= {"content", ""} else ""
    return "outer" if "outer" in verdicts else "shell" if "shell" in verdicts else ""


def element_says(tag: str, attributes: dict[str, str], above: _Open | None) -> str:
    """outer, shell, article, content or nothing of one element."""
    if not attributes and tag not in CONTENT_TAGS and tag not in OUTER_TAGS and tag not in SHELL_TAGS:
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return "outer"
    role, inside = attributes.get("role", "").strip().lower(), above.inside if above else ""
    if tag in OUTER_TAGS or role in OUTER_ROLES:
        return "outer"
    named = names_say(f"{attributes.get('class', '')} {attributes.get('id', '')}", inside)
    if tag in CONTENT_TAGS or role in CONTENT_ROLES:
        return named if named == "outer" else "article" if "article" in (tag, role) else "content"
    if tag in ("body", "html"):
        return ""
    if tag == "header" and inside:
        return named if named == "outer" else ""
    return "shell" if tag in SHELL_TAGS or role in SHELL_ROLES else named


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that matter of a tag from its name's end, and where the tag ends; -1 if the page ends first."""
    found: dict[str, str] = {}
    if page.startswith(">", at):
        return found, at + 1
    while m := ATTRIBUTE.match(page, at):
        at = m.end()
        if m["end"]:
            return found, at
        value = m["bare"] or ""
        if m["quote"]:
            close = page.find(m["quote"], at)
            if close < 0:
                return found, -1
            value, at = page[at:close], close + 1
        if (name := m["name"].lower()) in USED:
            found.setdefault(name, unescape(value))
    return found, -1


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    found: list[Block] = []
    stack: list[_Open] = []
    pieces: list[str] = []
    open_tags: Counter = Counter()
    unseen, links, linked, count, at, size = 0, 0, 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1] if stack else None
                found.append(Block(text, tuple(e.number for e in stack), top.tag if top else "", linked, top.says() if top else ""))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if unseen or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text)

    def pop_to(k: int) -> None:
        nonlocal links
        flush()
        for e in stack[k:]:
            open_tags[e.tag] -= 1
        del stack[k:]
        links = 0  # no link reaches over the end of a block

    def nearest(tags, stops) -> int:
        if not any(open_tags[t] for t in tags):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stops:
                return -1
        return -1

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt + 4) + 1
                continue
            m = COMMENT_END.search(page, lt + 4)
            at = m.end() if m else size
            continue
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            if page.startswith(("!", "?"), lt + 1) or (closing and lt + 2 < size):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                say("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        attributes, at = _attributes(page, m.end())
        if at < 0:
            break
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in UNSEEN:
                unseen = max(0, unseen - 1)
            elif tag == "p":
                k = nearest(("p",), SCOPES)
                if k >= 0:
                    pop_to(k)
                else:
                    flush()
            elif tag in BLOCKS:
                k = nearest(HEADINGS if tag in HEADINGS else (tag,), () if tag in SCOPES else SCOPES)
                if k >= 0:
                    pop_to(k)
                else:
                    flush()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = _attributes(page, end.end())[1] if end else size
            if at < 0:
                break
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                say(" ")
            continue
        if tag in UNSEEN:
            unseen += not (tag in ("svg", "math") and page.startswith("/>", at - 2))
            continue
        if tag == "a":
            links += 1
            continue
        if tag not in BLOCKS:
            continue
        if tag in CLOSE_P and (k := nearest(("p",), SCOPES)) >= 0:
            pop_to(k)
        if tag in ENDS and (k := nearest(*ENDS[tag])) >= 0:
            while k > 0 and stack[k - 1].tag in ENDS[tag][0] and tag == "tr":
                k -= 1
            pop_to(k)
        flush()
        if tag in VOID or len(stack) >= DEEPEST:
            continue
        above = stack[-1] if stack else None
        open_tags[tag] += 1
        stack.append(_Open(tag, count, element_says(tag, attributes, above), above))
        count += 1
    flush()
    return found
