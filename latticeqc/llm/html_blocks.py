"""Leaf blocks of an HTML page: text, and the path of tags with their class and id words."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by how they are laid out.
RAW = {"script", "style", "template", "svg", "textarea", "title", "iframe", "select"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var noscript object"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts"
    " mtable mtr mtd semantics annotation".split()
)
#: Foreign elements, which end at once where their tag ends with a slash.
FOREIGN = {"svg", "math"}
#: An opening tag ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end does not go beyond.
WALLS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "body", "form", "blockquote", "header", "footer"}


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int


def _features(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attributes:
        for kind, *values in NAMED.findall(attributes):
            value = next((v for v in values if v), "")
            out += [f"{kind[0].lower()}:{w}" for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())]
    return tuple(out)


def _below(above: tuple[str, ...], steps: tuple[str, ...]) -> tuple[str, ...]:
    """The path one element deeper. A step that comes again is left out but for the last two steps.

    So the path of deep nesting stays as long as the page has names, and neither its steps nor their first order change.
    """
    whole = above + steps
    return (*dict.fromkeys(whole[:-2]), *whole[-2:])


def blocks(page: str) -> list[Block]:
    """Blocks in page order; white space inside a block is one space, character references are decoded.

    The path of a block is that of the laid-out elements around it; inline elements are not in it.

    Scripts, styles, drawings, comments and the like have no text; formulas, ``noscript`` and ``object`` are text
    of the block around them. ``br`` is white space. Unclosed elements end where HTML
    ends them: a paragraph at the next block, a list item at the next item.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    state = {"linked": 0, "anchor": 0}

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else (), min(state["linked"], len(text))))
            parts.clear()
        state["linked"] = 0

    def pop(to: int) -> None:
        if any(t not in INLINE for t, _ in stack[to:]):
            flush()
        state["anchor"] -= sum(t == "a" for t, _ in stack[to:])
        del stack[to:]

    def say(text: str) -> None:
        parts.append(text)
        if state["anchor"]:
            state["linked"] += len(text)

    at, end = 0, len(page)
    while at < end:
        found = MARKUP.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if place is not None and (tag not in INLINE or all(t in INLINE for t, _ in stack[place:])):
                pop(place)
            elif tag in ("p", "br"):
                say(" ")
            continue
        if tag in FOREIGN and found[0].endswith("/>"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                say(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in ENDS.get(tag, ()):
                    pop(k)
                    if stack and stack[-1][0] in ENDS.get(tag, ()):
                        continue
                    break
                if stack[k][0] in WALLS:
                    break
        above = stack[-1][1] if stack else ()
        stack.append((tag, above if tag in INLINE else _below(above, _features(tag, found[3] or found[6] or ""))))
        state["anchor"] += tag == "a"
    flush()
    return out
