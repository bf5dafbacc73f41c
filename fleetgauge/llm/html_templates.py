"""Pages to learn from: page layouts by rule around texts of the sampled pages, with a label per block.

Names of classes and ids are drawn from lists of what sites commonly use; some elements get names
that mean nothing, or none, so that the labeller also learns from tags, words and neighbours.
"""

from __future__ import annotations

import random
from html import escape

# Common names of page parts.
MAIN = ["article", "content", "post", "story", "entry", "main", "body", "text", "page content", "article body", "post content", "entry content", "blog post", "rich text"]
PARTS = {
    "menu": ["nav", "menu", "navbar", "navigation", "main menu", "top nav", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc links", "tabs"],
    "header": ["header", "site header", "masthead", "banner", "logo", "brand", "top bar", "tagline", "branding"],
    "footer": ["footer", "site footer", "copyright", "legal", "bottom", "colophon", "page footer", "credits"],
    "sidebar": ["sidebar", "aside", "widget", "related", "related posts", "popular", "trending", "recommended", "more stories", "right col", "rail", "tags", "tag cloud"],
    "notice": ["cookie", "cookie notice", "consent", "gdpr", "notice", "alert", "cookie banner", "popup", "modal", "paywall", "privacy notice", "announcement"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "ad slot", "banner ad", "adsense", "affiliate"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact form", "search box", "subscription"],
    "comments": ["comments", "comment", "comment list", "comment body", "reader comments", "discussion", "replies", "responses", "disqus", "respond", "reply"],
    "share": ["share", "social", "sharing", "share buttons", "social links", "follow", "byline meta", "post meta"],
}
_TAGS = {
    "menu": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
    "notice": ["div", "section", "dialog", "aside"], "advert": ["div", "aside", "ins", "section"], "form": ["form", "div"],
    "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"],
}
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Sports", "Login", "Blog", "Shop", "Archive", "Next", "Previous"],
    "header": ["Daily News", "The Gazette", "Welcome", "Breaking", "Skip to content"],
    "footer": ["All rights reserved", "© 2024", "Privacy policy", "Terms of use", "Contact us", "Powered by"],
    "sidebar": ["Related articles", "Most read", "Popular posts", "Recent comments", "Tags", "Archives", "You may also like"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "By continuing you agree to our policy.", "Please disable your ad blocker."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save", "Limited offer", "Ad"],
    "form": ["Search", "Email address", "Subscribe", "Your name", "Submit", "Sign up for our newsletter", "Password"],
    "comments": ["Reply", "Comments", "says:", "Leave a comment", "Posted by", "2 days ago", "Great article!", "Thanks for sharing"],
    "share": ["Share", "Tweet", "Facebook", "Print", "Email this"],
}
FALLBACK = "the quick report said that many people of the town had come to see what was new and how it would work for them".split()


class PageMaker:
    def __init__(self, lines: list[str], seed: int):
        self.rng = random.Random(seed)
        self.lines = [x for x in lines if len(x.split()) >= 4]
        self.words = [w for x in lines for w in x.split()] or FALLBACK

    def some(self, low: int, high: int) -> str:
        """Running words of a sampled line, so that articles and comments speak alike."""
        r = self.rng
        n = r.randint(low, high)
        source = r.choice(self.lines).split() if self.lines and r.random() < 0.8 else self.words
        at = r.randrange(max(1, len(source) - n))
        text = " ".join(source[at : at + n]) or r.choice(FALLBACK)
        return escape(text.upper() if r.random() < 0.05 else text)

    def names(self, pool: list[str] | None) -> str:
        r = self.rng
        if pool is None or r.random() < 0.25:
            if r.random() < 0.5:
                return ""
            return f' class="{"".join(r.choice("abcdefghijkmnopqrstuvwxyz") for _ in range(r.randint(2, 7)))}"'
        name = r.choice(pool).replace(" ", r.choice(["-", "_", " ", "__"]))
        if r.random() < 0.3:
            name += r.choice(["-wrapper", "-container", "-inner", "-box", " clearfix", "-1", "-main", "-block"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def chrome(self, kind: str) -> list[str]:
        """Pieces of a page part."""
        r = self.rng
        tag = r.choice(_TAGS[kind])
        # Plain containers need a telling name, or nothing could tell them from the article.
        names = self.names(PARTS[kind]) if tag not in ("div", "section", "ol", "ul", "ins", "dialog") else ""
        while tag in ("div", "section", "ol", "ul", "ins", "dialog") and not any(w in names for p in PARTS[kind] for w in p.split()):
            names = self.names(PARTS[kind])
        out = [f"<{tag}{names}>"]
        short = lambda: r.choice(PHRASES[kind]) if r.random() < 0.5 else self.some(1, 5)
        if kind in ("menu", "share") or kind == "sidebar" and r.random() < 0.6:
            if kind == "sidebar":
                out.append(f"<h{r.randint(2, 4)}>{short()}</h3>")
            items = [f'<li><a href="/x">{short()}</a></li>' for _ in range(r.randint(2, 8))]
            out += ["<ul>", *items, "</ul>"] if tag != "ul" and r.random() < 0.8 else items
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                out.append(r.choice([f"<label>{short()}</label><input>", f"<p>{short()}</p>", f"<button>{short()}</button>", f"<select><option>{short()}<option>{short()}</select>"]))
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                inner = r.choice(["div", "li", "article"])
                out.append(f'<{inner}{self.names(PARTS[kind])}>{r.choice(["", f"<b>{self.some(1, 2)}</b><br>", f"<p>{short()}</p>"])}<p>{self.some(4, 40)}</p></{inner}>')
        else:
            for _ in range(r.randint(1, 4)):
                text = short() if r.random() < 0.6 else self.some(4, 30)
                out.append(r.choice([f"<p>{text}</p>", f"{text}<br>", f'<a href="/y">{text}</a> ', f"<div>{text}</div>", f"<span>{text}</span>"]))
        return [*out, f"</{tag}>"]

    def article(self) -> list[str]:
        r = self.rng
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        names = self.names(MAIN if tag in ("div", "section", "td") or r.random() < 0.5 else None)
        out = [f"<{tag}{names}>"]
        if r.random() < 0.8:
            head = f"<h1>{self.some(2, 10)}</h1>"
            out.append(f"<header{self.names(None)}>{head}</header>" if tag != "td" and r.random() < 0.2 else head)
        wrap = r.random() < 0.3
        if wrap:
            out.append(f"<div{self.names(MAIN)}>")
        for _ in range(r.choice([1, 2, 4, 7, 12])):
            x = r.random()
            text = self.some(1, 8) if x < 0.2 else self.some(8, 80)
            if r.random() < 0.3:
                text = f"<b>{self.some(1, 3)}</b> " + text
            if r.random() < 0.15:
                text += f' <a href="/z">{self.some(1, 4)}</a>'
            y = r.random()
            if y < 0.7:
                out.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
            elif y < 0.78:
                out.append(f"<h2>{self.some(1, 7)}</h2>")
            elif y < 0.85:
                out += ["<ul>", *(f"<li>{self.some(2, 15)}</li>" for _ in range(r.randint(2, 5))), "</ul>"]
            elif y < 0.9:
                out.append(f"<blockquote>{text}</blockquote>")
            elif y < 0.93:
                out.append(f"<div>{text}</div>")
            elif y < 0.95:
                out.append(f"<figure><figcaption>{self.some(2, 12)}</figcaption></figure>")
            elif y < 0.97:
                out.append("<table>" + "".join(f"<tr><th>{self.some(1, 3)}</th><td>{self.some(1, 6)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f"{text}<br>")
            if r.random() < 0.15:
                out.append(("mark", self.chrome(r.choice(["advert", "share", "sidebar", "form", "notice"]))))
        if wrap:
            out.append("</div>")
        return [*out, f"</{tag}>"]

    def page(self) -> list[tuple[str, int]]:
        """(piece of markup, 1 for the article) in order."""
        r = self.rng
        out: list[tuple[str, int]] = [("<html><body>", 0)]
        put = lambda kind: out.append(("".join(self.chrome(kind)), 0))
        shell = r.random() < 0.4
        if shell:
            out.append((f"<div{self.names(['page', 'wrapper', 'container', 'site', 'layout'])}>", 0))
        for kind, p in (("notice", 0.3), ("header", 0.6), ("menu", 0.8), ("advert", 0.4), ("form", 0.25), ("sidebar", 0.25)):
            if r.random() < p:
                put(kind)
        for piece in self.article() if r.random() < 0.97 else []:
            if isinstance(piece, tuple):
                out.append(("".join(piece[1]), 0))
            else:
                out.append((piece, 1))
        for kind, p in (("share", 0.3), ("advert", 0.3), ("comments", 0.5), ("sidebar", 0.5), ("form", 0.3), ("menu", 0.2), ("footer", 0.8), ("notice", 0.2)):
            if r.random() < p:
                put(kind)
        if shell:
            out.append(("</div>", 0))
        return [*out, ("</body></html>", 0)]
