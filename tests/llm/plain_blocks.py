"""The page reader said plainly: every question about open elements walks the whole stack."""

import re
from html import unescape

from fleetgauge.llm.html_blocks import BLOCK, CLOSES, FOREIGN, HEADINGS, SCOPES, SKIPPED, VOID, PageBlock, _known, _tokens

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<""",
    re.S,
)


def _end_of(html: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
    return m.end() if m else len(html)


def read_blocks(html: str | None) -> list[PageBlock]:
    """Blocks of a page in order; character references are decoded and white space is one space."""
    html = html or ""
    blocks: list[PageBlock] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                outer = [t for _, names in stack[:-1] for t in names]
                inner = [f".{t}" for t in stack[-1][1]] if stack else []
                blocks.append(PageBlock(text, tuple(dict.fromkeys(outer + inner)), min(link, len(text)), any(t in HEADINGS for t, _ in stack)))
            parts.clear()
        link = 0

    at, n = 0, len(html)
    links = 0  # open <a> elements
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if links:
                    link += len(piece)
            continue
        tag = tag.lower()
        closing = m[1] or m[4]
        attributes = (m[3] if m[2] else m[6]) or ""
        if closing:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK or not any(t in BLOCK for t, _ in stack[k + 1 :]):
                        del stack[k:]
                        links = sum(t == "a" for t, _ in stack)
                    break
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("br", "option", "button", "label"):
                _close(stack, ("p",))
            if tag in CLOSES:
                _close(stack, CLOSES[tag])
            links = sum(t == "a" for t, _ in stack)
        if tag in SKIPPED:
            # A slash closes such an element only inside svg and math; elsewhere it means nothing.
            if not (attributes.rstrip().endswith("/") and any(t in FOREIGN for t, _ in stack)):
                at = _end_of(html, tag, at)
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and (tag in FOREIGN or any(t in FOREIGN for t, _ in stack)):
            continue
        stack.append((tag, _tokens(tag, attributes, _known)))
        links += tag == "a"
    flush()
    return blocks


def _close(stack: list, tags: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in tags:
            del stack[k:]
            return
        if stack[k][0] in SCOPES or stack[k][0] in BLOCK and "p" in tags:
            return
