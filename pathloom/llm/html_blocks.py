"""Pages as sequences of leaf blocks: text that no block element parts, with what its ancestors and its own text say of it."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

# A tag without quotes that match is taken to its first ``>``. No part runs over a further ``<``, so no text is read again and again.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names of HTML by their content.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html ins label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Their content is text without markup, which belongs to no block; without an end it goes to the end of the page.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Left out as well, if they end.
LEFT = frozenset("audio canvas datalist map math noscript object select svg template video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that begins ends an open one of these names, not beyond those after the slash.
ENDS = {"li": "li/ul ol menu", "dt": "dt dd/dl", "dd": "dt dd/dl", "tr": "tr td th/table", "td": "td th/tr table", "th": "td th/tr table", "option": "option/select", "tbody": "tr td th thead tbody/table", "tfoot": "tr td th thead tbody/table"}
_ENDS = {k: tuple(frozenset(x.split()) for x in v.split("/")) for k, v in ENDS.items()}
_HOLDS_P = frozenset("button caption td th table".split())
_NOT_IN_P = BLOCKS - {"button", "ins", "label", "option", "optgroup", "body", "html"}
#: Ancestors by name.
NAMED = frozenset("article aside blockquote button details dialog dl figure footer form header label li main menu nav ol pre section table ul".split())
#: Ancestors by what their class, id or role says.
ABOUT = {
    "menu": r"nav|menu|crumb|toc\b|pagin|pager|skip",
    "head": r"header|masthead|banner|topbar|top-bar|logo|branding",
    "foot": r"foot|copyright|colophon|legal|contentinfo|imprint",
    "side": r"sidebar|side-|aside|widget|\brail|rail\b|related|recommend|popular|trending|complementary|more-",
    "advert": r"(?:^|[^a-z])ads?(?:[^a-z]|$)|advert|adsby|sponsor|promo|dfp|commercial|marketing",
    "notice": r"cookie|consent|gdpr|notice|notif|alert|modal|popup|overlay|paywall|disclaimer|dialog|warning|toast",
    "form": r"form|newsletter|subscri|sign-?up|log-?in|sign-?in|search|register|contact",
    "talk": r"comment|repl(?:y|ies)|respon[ds]|discuss|disqus|thread|feedback|review",
    "share": r"share|social|follow|byline|meta\b|tags?\b|author",
    "main": r"article|content|post|entry|story|text|main|body|page",
    "hidden": r"hidden|display:\s*none|sr-only|visually",
}
_ABOUT = {k: re.compile(v) for k, v in ABOUT.items()}
_SAID = re.compile(r"\b(?:cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|advertisement|sponsored|copyright|all rights reserved|reply|comments?|menu|search|share|privacy|terms|read more)\b|©", re.I)


class Place(NamedTuple):
    """A place in a page: the name of the innermost ancestor, and the features of all."""

    tag: str
    features: frozenset


class Block(NamedTuple):
    text: str
    place: Place
    parent: int
    linked: float


_ROOT = Place("", frozenset())
_places: dict[tuple, Place] = {}
#: Pages of one site share their places; the table of those seen is emptied when it has so many.
_MOST_PLACES = 20_000


def _within(above: Place, tag: str, attributes: str) -> Place:
    key = (above.tag, above.features, tag, attributes)
    found = _places.get(key)
    if found is None:
        own = {f"in:{tag}"} if tag in NAMED else set()
        said = []
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "style", "hidden", "aria-hidden", "aria-label"):
                said.append(f"{name} {a or b or c}" if name in ("hidden",) or (name == "aria-hidden" and "true" in (a, b, c)) else a or b or c)
        said = " ".join(said).lower()
        if said:
            own |= {f"at:{k}" for k, p in _ABOUT.items() if p.search(said)}
        if len(_places) >= _MOST_PLACES:
            _places.clear()
        found = _places[key] = Place(tag, above.features | own)
    return found


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order. Character references are decoded, white space becomes one space, ends are trimmed.

    Elements that are not closed end with what holds them; a tag that is not
    complete is text. Texts of scripts, styles and form values belong to no block.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place, int]] = [("", _ROOT, 0)]
    parts: list[str] = []
    link, linked, made, at = False, 0, 0, 0
    open_: Counter = Counter()
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, place, number = stack[-1]
                out.append(Block(text, place, stack[-2][2] if len(stack) > 1 else number, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            raw = page[at:end]
            parts.append(unescape(raw) if "&" in raw else raw)
            if link:
                linked += len(parts[-1].strip())

    def close(names: frozenset, stop: frozenset) -> None:
        if not any(open_[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                open_.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    while m := _TOKEN.search(page, at):
        text_to(m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if ends:
            if tag == "a":
                link = False
            elif tag == "p" or tag in BLOCKS:
                flush()
                close(frozenset((tag,)), frozenset(("table",)) if tag not in ("table", "body", "html", "div", "main", "article") else frozenset())
            continue
        if tag in RAW or tag in LEFT:
            alone = tag in LEFT and (attributes.endswith("/") or tag in endless)
            end = None if alone else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = len(page)
            elif not alone:
                endless.add(tag)
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in _NOT_IN_P:
                close(frozenset(("p",)), _HOLDS_P)
            if tag in _ENDS:
                close(*_ENDS[tag])
            if tag not in VOID:
                made += 1
                open_[tag] += 1
                stack.append((tag, _within(stack[-1][1], tag, attributes), made))
    text_to(len(page))
    flush()
    return out


_SIZES = (2, 4, 8, 16, 32, 64)


def features(blocks: list[Block]) -> list[tuple[frozenset, tuple[str, ...]]]:
    """Of each block the features of its place, and of its text, its links and of a landmark that the page has elsewhere."""
    marks = [f for f in ("in:article", "in:main") if any(f in b.place.features for b in blocks)]
    out = []
    for b in blocks:
        text, n = b.text, b.text.count(" ") + 1
        size = next((k for k, s in enumerate(_SIZES) if n < s), len(_SIZES))
        own = ["any", f"tag:{b.place.tag}", f"words:{size}", f"linked:{round(3 * b.linked)}", f"end:{text[-1] if text[-1] in '.!?:…' else ''}"]
        own += [f"out:{f}" for f in marks if f not in b.place.features]
        if size < 5 and _SAID.search(text):
            own.append("said")
        if n >= 8 and text.count(",") * 12 >= n:
            own.append("commas")
        if "|" in text or "»" in text or "·" in text:
            own.append("parted")
        out.append((b.place.features, tuple(own)))
    return out
