"""Blocks of visible text from one HTML page, in page order.

A tolerant scanner: unclosed and misnested tags, truncated pages and damaged
character references are read as browsers read them, as far as text goes.

Elements that only their class or id, or being a form, marks as furniture are not
furniture if they are or hold an article: pages wrap articles in "sidebar" and in
forms.  Navigation, asides, hidden elements, and what is named as comments, replies or
related texts are furniture whatever they hold, as a comment or teaser may well be an
``article``; an article's own class does not make it one.  A class or id counts if all of its words are furniture words, or if its
first or last word is one of a narrower list ("post-comments", "site-footer"); words
such as "has" and "no" undo that ("has-sidebar", "no-comments").

A block is boxed if a block element with a class or id stands around it, inside of
the article where there is one, and holds less than half of the text there: such
boxes are either text or furniture, which the names alone do not tell.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_SKIPPED = "script|style|noscript|template|iframe|svg|math|object|canvas|select|textarea|title|audio|video"
_TOKEN = re.compile(
    rf"<!--(?s:.*?)(?:-->|$)|<(?P<raw>{_SKIPPED})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>(?s:.*?)(?:</(?P=raw)\b[^>]*>|$)|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z0-9]+")
#: Elements whose borders end a block.
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of these kinds ends where the next block of its kind begins.
_IMPLIED = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: Elements, roles and words of class names that mark page furniture.
_FURNITURE = frozenset("nav aside footer menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal newsletter subscribe subscription share sharing social sidebar sidenav menu navbar nav navigation breadcrumb breadcrumbs comment comments commentlist disqus respond replies related recommended pagination pager widget footer masthead toolbar skip".split()
)
#: Words that name comments and teasers of other texts.
_APART = frozenset("comment comments commentlist disqus respond reply replies related".split())
#: Words that mark a compound name they begin or end, and words that undo it.
_ENDS = _APART | frozenset("ads advertisement advertising adsense sponsored cookie cookies consent gdpr newsletter subscribe sidebar sidenav navbar nav navigation breadcrumb breadcrumbs pagination footer share sharing".split())
_UNDONE = frozenset("has no not non with without hide open opened closed enabled disabled on off".split())
_OUTER = frozenset(["header"])


@dataclass
class Block:
    text: str
    main: bool
    furniture: bool
    boxed: bool = False


def _named(names: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture, and whether comments or other texts."""
    furniture = apart = False
    for name in names.split():
        parts = [p for p in _PART.findall(name) if not p.isdigit()]
        if not parts:
            continue
        whole = _WORDS.issuperset(parts)
        ends = set() if _UNDONE.intersection(parts) else {parts[0], parts[-1]}
        furniture |= whole or bool(ends & _ENDS)
        apart |= bool(ends & _APART)
    return furniture, apart


def _marks(name: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """(furniture, furniture unless it holds an article, main, boxed) of an opening tag."""
    furniture, likely, main = name in _FURNITURE, name == "form", name in ("article", "main")
    boxed = apart = False
    if "=" in attrs:
        for key, value in _ATTRIBUTE.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                boxed = True
                if name not in ("html", "body"):
                    named, other = _named(value)
                    likely |= named
                    apart |= other
            elif key == "role":
                furniture |= value in _ROLES
                likely |= value == "form"
                main |= value in ("main", "article")
            elif key == "itemprop":
                main |= value == "articlebody"
            elif key == "aria-hidden":
                furniture |= value == "true"
    if re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", attrs, re.I):
        furniture = True
    # An article that is itself called so may be the page's only one.
    furniture |= apart and not main
    main = main and not furniture
    return furniture, likely and not main, main, boxed and not main and name in _BLOCK and name != "body"


def _settled(marked: list[list], out: list[tuple[str, int]]) -> tuple[list[bool], list[bool], list[bool]]:
    """Whether each marked element lies in furniture, in an article, in a box."""
    inside, article, boxes = [False], [False], [False]
    for parent, furniture, likely, main, outer, *_ in marked[1:]:
        inside.append(inside[parent] or furniture or likely or (outer and not article[parent]))
        article.append(article[parent] or (main and not inside[-1]))
    size = [0] * len(marked)
    some = any(article[k] for _, k in out)
    for words, k in out:
        if not inside[k] and article[k] == some:
            size[k] += len(words)
    for k in range(len(marked) - 1, 0, -1):
        size[marked[k][0]] += size[k]
    for k in range(1, len(marked)):
        parent = marked[k][0]
        # A box counts from the outermost article on.
        boxes.append((marked[k][6] and 2 * size[k] < size[0]) or (boxes[parent] and article[parent] == article[k]))
    return inside, article, boxes


def blocks(page: str) -> list[Block]:
    """Non-empty blocks with white space collapsed to single spaces."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    # Marked elements: the marked element around it, its marks, whether it is a
    # header, whether it is or holds an article, whether it is a box.
    marked: list[list] = [[0, False, False, False, False, False, False]]
    # Open elements: name, and the innermost marked element.
    stack: list[tuple[str, int]] = [("", 0)]
    # How many elements of a name are open, so that an end tag without one costs nothing.
    opened: Counter[str] = Counter()

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                out.append((" ".join(words), stack[-1][1]))
            text.clear()

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text.append(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        if token["end"]:
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if stack[-1][1] != stack[k - 1][1]:
                    flush()
                opened.subtract(n for n, _ in stack[k:])
                del stack[k:]
            continue
        while len(stack) > 1 and name in _IMPLIED.get(stack[-1][0], ()):
            opened[stack.pop()[0]] -= 1
        if name in _VOID or (token["attrs"] or "").endswith("/"):
            continue
        furniture, likely, main, boxed = _marks(name, token["attrs"] or "")
        at_mark, outer = stack[-1][1], name in _OUTER and not main
        if furniture or likely or main or outer or boxed:
            flush()
            k = at_mark
            while main and k and not marked[k][1] and not marked[k][5]:
                marked[k][2], marked[k][5] = False, True
                k = marked[k][0]
            marked.append([at_mark, furniture, likely, main, outer, main, boxed])
            at_mark = len(marked) - 1
        stack.append((name, at_mark))
        opened[name] += 1
    text.append(page[at:])
    flush()
    inside, article, boxes = _settled(marked, out)
    return [Block(words, article[k], inside[k], boxes[k]) for words, k in out]
