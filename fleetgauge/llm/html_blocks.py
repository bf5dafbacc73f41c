"""Cutting a page into blocks: runs of text between block-level tags, with the path of open elements.

A tolerant reader in the manner of browsers: unclosed paragraphs and list items end where the next
begins, stray end tags are ignored, elements of raw text (scripts, styles, titles and the like) are skipped. All
other elements are opened, so what they hold (formulas, fallback texts) is judged by its path.

A page takes linear time however deeply it nests and whatever is left open: what is open is counted as it opens and
closes, and where a quote or tag has no end is found out once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from typing import NamedTuple

# Element names of the HTML standard by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript iframe title textarea".split())  # read as raw text up to their end tag
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
FOREIGN = frozenset("svg math".split())  # inside these a slash closes an element
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an element closes when it begins.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
SCOPES = frozenset("ul ol dl table select body".split())  # what such closing does not reach beyond

_DECLARED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile(r"""[>"']""")
_LONG_NUMBER = re.compile(r"&#([0-9]{4000,});?")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class PageBlock(NamedTuple):
    text: str
    path: tuple[str, ...]  # features of the open elements, the innermost marked
    link_chars: int
    heading: bool


def _tokens(tag: str, attributes: str, known: dict) -> tuple[str, ...]:
    key = (tag, attributes)
    found = known.get(key)
    if found is None:
        names = [tag]
        for m in _NAMES.finditer(attributes):
            names += [w.lower() for w in _WORDS.findall(m[1] or m[2] or m[3] or "") if len(w) > 1]
        if _HIDDEN.search(attributes) or tag in ("template", "datalist"):  # browsers don't show these
            names.append("!hidden")
        if len(known) > 50_000:
            known.clear()
        found = known[key] = tuple(dict.fromkeys(names))
    return found


_known: dict = {}


def _end_of(html: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
    return html.find(">", m.end()) + 1 or len(html) if m else len(html)


class _Tags:
    """Where the tags of a page end: at the first `>` outside quotes, or at the first one where a quote stays open."""

    def __init__(self, html: str):
        self.html = html
        self.special = [m.start() for m in _SPECIAL.finditer(html)]
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.unended: set[int] = set()  # quotes and signs outside quotes from which on no tag ends

    def end(self, at: int) -> int:
        """Place of the `>` that ends the tag whose attributes begin at `at`; one follows."""
        html, seen, here = self.html, [], at
        while True:
            k = bisect_left(self.special, here)
            if k == len(self.special) or self.special[k] in self.unended:
                break
            here = self.special[k]
            if html[here] == ">":
                return here
            seen.append(here)
            if here >= self.last[html[here]]:
                break
            here = html.index(html[here], here + 1) + 1
        self.unended.update(seen)
        return html.index(">", at)


class _Open:
    """The open elements of a page, with counts of what each question about them needs."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}  # where the elements of a name stand
        self.blocks: list[int] = []
        self.names: dict[str, int] = {}  # how many elements have a feature, in the order of the first ones
        self.headings = self.foreign = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.headings += tag in HEADINGS
        self.foreign += tag in FOREIGN
        for name in names:
            self.names[name] = self.names.get(name, 0) + 1
        self.stack.append((tag, names))

    def cut(self, k: int) -> None:
        """Closes element `k` and all within it."""
        while len(self.stack) > k:
            tag, names = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.headings -= tag in HEADINGS
            self.foreign -= tag in FOREIGN
            for name in names:
                self.names[name] -= 1
                if not self.names[name]:
                    del self.names[name]

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def path(self) -> tuple[str, ...]:
        inner = self.stack[-1][1] if self.stack else ()
        within = set(inner)
        outer = [t for t, n in self.names.items() if n > (t in within)]
        return tuple(dict.fromkeys(outer + [f".{t}" for t in inner]))

    def end(self, tag: str) -> None:
        """An end tag; one of a block closes what is open within, another none beyond a block."""
        k = self.last((tag,))
        if k >= 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] < k):
            self.cut(k)

    def begin(self, tag: str) -> None:
        """What the beginning of a block closes."""
        if tag not in ("br", "option", "button", "label") and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self.cut(self.blocks[-1])
        if tag in CLOSES:
            k = self.last(CLOSES[tag])
            if k > self.last(SCOPES):
                self.cut(k)


def _decoded(text: str) -> str:
    """Character references decoded, white space one space; numbers too long for any character stand for none."""
    text = _LONG_NUMBER.sub(lambda m: "�" if len(d := m[1].lstrip("0")) > 7 else f"&#{d or 0};", text)
    return " ".join(unescape(text).split())


def read_blocks(html: str | None) -> list[PageBlock]:
    """Blocks of a page in order; character references are decoded and white space is one space."""
    html = html or ""
    blocks: list[PageBlock] = []
    tags, opened = _Tags(html), _Open()
    links = opened.places.setdefault("a", [])
    parts: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if parts:
            if text := _decoded("".join(parts)):
                blocks.append(PageBlock(text, opened.path(), min(link, len(text)), opened.headings > 0))
            parts.clear()
        link = 0

    at, n = 0, len(html)
    while at < n:
        if html[at] != "<":
            stop = html.find("<", at)
            piece = html[at : stop if stop >= 0 else n]
        elif html.startswith(("<!", "<?"), at) and (at < tags.last[">"] or html.startswith(("<!--", "<![CDATA["), at)):
            at = _DECLARED.match(html, at).end()
            continue
        elif at < tags.last[">"] and (m := _TAG.match(html, at)):
            piece = None
        else:
            piece = "<"
        if piece is not None:
            parts.append(piece)
            if links:
                link += len(piece)
            at += len(piece)
            continue
        tag, end = m[2].lower(), tags.end(m.end())
        attributes, at = html[m.end() : end], end + 1
        if m[1]:
            if tag in BLOCK:
                flush()
            opened.end(tag)
            continue
        if tag in BLOCK:
            flush()
            opened.begin(tag)
        if tag in SKIPPED:
            # A slash closes such an element only inside svg and math; elsewhere it means nothing.
            if not (attributes.rstrip().endswith("/") and opened.foreign):
                at = _end_of(html, tag, at)
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and (tag in FOREIGN or opened.foreign):
            continue
        opened.push(tag, _tokens(tag, attributes, _known))
    flush()
    return blocks
