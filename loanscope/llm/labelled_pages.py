"""Labelled pages for training the extraction model: layouts with marked content.

Each page is composed from a random layout; a block is (markup, is content).
The words are drawn from the given texts, so that only structure tells content
and the rest apart: comments and notices read like articles.
"""

from __future__ import annotations

import random

# Marks the content leaves in the markup; the parser keeps it as text and the labeller takes it out.
MARK = "⁣"

# Names that pages give to their parts.
MENU = "nav navbar menu main-menu navigation topnav breadcrumbs breadcrumb links site-nav pagination pager toc tabs".split()
HEADER = "header site-header masthead banner top topbar page-header branding logo hero-header".split()
FOOTER = "footer site-footer colophon bottom copyright legal foot page-footer credits".split()
SIDE = "sidebar aside side widget widgets right-column related recommended trending popular tags more-stories side-bar rail".split()
NOTICE = "cookie-notice cookie-banner notice alert consent gdpr popup modal overlay message announcement warning cookie cookies disclaimer".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense ad-slot partner-content".split()
FORM = "form newsletter subscribe login search search-form signup contact-form register".split()
COMMENT = "comments comment-list comment discussion replies responses reader-comments disqus respond comment-body user-comments reply".split()
SHARE = "share social sharing social-share follow byline-tools tools print meta-links buttons".split()
CONTENT = "content main article post entry story post-content article-body entry-content main-content text body-text story-body article-content post-body".split()
WRAP = "wrapper container page site layout row inner outer wrap grid column col main-wrapper app root box".split()
# Words in the names of parts that are no content wherever they stand, inside an article too.
APART = set("""comment comments reply replies responses discussion disqus respond ad ads advert advertisement sponsor sponsored promo promotion
adsense share social sharing newsletter subscribe signup login sidebar widget related recommended cookie consent gdpr popup modal""".split())
INSIDE = "section lead intro body quote caption figure summary highlight first last".split()


class Pages:
    def __init__(self, texts: list[str], seed: int):
        self.random = random.Random(seed)
        self.words = [w for t in texts for w in t.split()] or ["word"]

    def phrase(self, low: int, high: int, mark: bool = False) -> str:
        n, at = self.random.randint(low, high), self.random.randrange(len(self.words))
        words = (self.words[at:at + n] + self.words[:n])[:n]
        text = " ".join(words).replace("&", "&amp;").replace("<", "&lt;")
        return (MARK if mark else "") + text

    def sentences(self, mark: bool, low: int = 8, high: int = 70) -> str:
        text = self.phrase(low, high, mark)
        if self.random.random() < 0.3:
            a = self.phrase(1, 4)
            tag = self.random.choice(["b", "i", "em", "strong", "span", "a href='/x'"])
            text += f" <{tag}>{a}</{tag.split()[0]}>"
        if self.random.random() < 0.25:
            text += "<br>" + self.phrase(2, 12)
        return text + self.random.choice([".", ".", ".", "", "!", "?"])

    def named(self, names: list[str], tags: list[str]) -> tuple[str, str]:
        """Opening and closing tag of an element that carries one of the names, as class or id."""
        tag, name = self.random.choice(tags), self.random.choice(names)
        if self.random.random() < 0.15 and tag not in ("div", "section", "p", "ul", "span"):
            return f"<{tag}>", f"</{tag}>"
        other = self.random.choice(["", "", f" {self.random.choice(WRAP)}"])
        how = self.random.choice(["class", "class", "id"])
        return f'<{tag} {how}="{name}{other}">', f"</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f"<a href='/{i}'>{self.phrase(1, 5)}</a>" for i in range(self.random.randint(low, high))]
        if self.random.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.random.choice([" ", " | ", " "]).join(items)

    def boilerplate(self, kind: str) -> str:
        r = self.random
        if kind == "menu":
            a, z = self.named(MENU, ["nav", "nav", "div", "ul"])
            return a + self.links() + z
        if kind == "header":
            a, z = self.named(HEADER, ["header", "header", "div"])
            inner = r.choice([f"<h1>{self.phrase(1, 5)}</h1>", f"<a href='/'>{self.phrase(1, 4)}</a>", f"<p>{self.phrase(3, 12)}</p>", f"<div>{self.phrase(1, 6)}</div>"])
            return a + inner + r.choice(["", f"<p>{self.phrase(2, 9)}</p>", self.boilerplate("menu")]) + z
        if kind == "footer":
            a, z = self.named(FOOTER, ["footer", "footer", "div"])
            return a + r.choice([f"&copy; 2024 {self.phrase(1, 6)}", f"<p>&copy; {self.phrase(2, 10)} &middot; {self.phrase(1, 5)}</p>", self.links(), f"<p>{self.sentences(False, 5, 30)}</p>"]) + r.choice(["", self.links()]) + z
        if kind == "side":
            a, z = self.named(SIDE, ["aside", "aside", "div", "section"])
            return a + r.choice(["", f"<h3>{self.phrase(1, 4)}</h3>"]) + r.choice([self.links(), f"<p>{self.sentences(False, 6, 40)}</p>", f"<div>{self.phrase(3, 20)}</div>"]) + z
        if kind in ("notice", "advert"):
            a, z = self.named(NOTICE if kind == "notice" else ADVERT, ["div", "div", "section", "aside", "p"])
            inner = self.sentences(False, 3, 40)
            return a + (inner if a.startswith("<p") or r.random() < 0.5 else f"<p>{inner}</p>") + r.choice(["", "<button>OK</button>"]) + z
        if kind == "form":
            a, z = self.named(FORM, ["form", "form", "div"])
            return a + r.choice(["", f"<p>{self.phrase(3, 25)}</p>", f"<h3>{self.phrase(1, 6)}</h3>"]) + f"<label>{self.phrase(1, 3)}</label><input name=q><button>{self.phrase(1, 2)}</button>" + r.choice(["", f"<select><option>{self.phrase(1, 2)}<option>{self.phrase(1, 2)}</select>"]) + z
        if kind == "share":
            a, z = self.named(SHARE, ["div", "ul", "p"])
            return a + r.choice([self.links(2, 4) if not a.startswith("<p") else self.phrase(1, 4), self.phrase(1, 5)]) + z
        a, z = self.named(COMMENT, ["section", "div", "div", "ol", "ul"])
        one = lambda: f"<{t} class=\"{r.choice(['comment', 'reply', 'comment-item', 'c', 'response'])}\">" + r.choice(["", f"<h4>{self.phrase(1, 3)}</h4>", f"<b>{self.phrase(1, 2)}</b>: "]) + f"<p>{self.sentences(False, 3, 60)}</p></{t}>"
        t = "li" if a.startswith(("<ol", "<ul")) else r.choice(["div", "article", "div"])
        return a + r.choice(["", f"<h3>{self.phrase(1, 3)}</h3>"] if t != "li" else [""]) + "".join(one() for _ in range(r.randint(1, 5))) + z

    def content(self) -> str:
        r, parts = self.random, []
        heading = f"<h1>{self.phrase(2, 12, True)}</h1>"
        parts.append(r.choice([heading, heading, "", f"<header>{heading}</header>", f"<h2>{self.phrase(2, 10, True)}</h2>"]))
        for _ in range(r.choice([1, 1, 1, 2, 2, 3, 5, 8])):
            p = f"<p>{self.sentences(True)}" + r.choice(["</p>", "</p>", "</p>", ""])
            parts.append(r.choice([p, p, p, p, p, f"<p>{self.phrase(1, 4, True)}</p>", f"<h2>{self.phrase(1, 8, True)}</h2>" + p,
                                   f"<blockquote><p>{self.sentences(True)}</p></blockquote>",
                                   "<ul>" + "".join(f"<li>{self.phrase(2, 20, True)}</li>" for _ in range(3)) + "</ul>",
                                   f"<div class='{r.choice(INSIDE)}'>{p}</div>", f"<section>{p}</section>",
                                   f"<figure><img src=x><figcaption>{self.phrase(2, 12, True)}</figcaption></figure>",
                                   f"<table><tr><td>{self.phrase(1, 4, True)}<td>{self.phrase(1, 4, True)}</table>",
                                   f"<pre>{self.phrase(3, 30, True)}</pre>", f"<div>{self.sentences(True)}</div>"]))
            if r.random() < 0.06:
                parts.append(self.boilerplate(r.choice(["advert", "share", "side", "form", "notice"])))
        if r.random() < 0.3:
            parts.append(self.boilerplate(r.choice(["comment", "comment", "share", "advert", "side"])))
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.55:
            a, z = r.choice([("<article>", "</article>"), ("<article>", "</article>"), self.named(CONTENT, ["article", "main", "section"])])
        elif kind < 0.9:
            a, z = self.named(CONTENT, ["div", "main", "td"])
        else:
            a, z = "", ""
        return a + inner + z

    def page(self) -> str:
        r = self.random
        before = [k for k in ("header", "menu", "notice", "advert", "side", "form") if r.random() < (0.55 if k in ("header", "menu") else 0.3)]
        after = [k for k in ("comment", "side", "form", "advert", "notice", "share", "footer")
                 if r.random() < (0.75 if k == "footer" else 0.5 if k == "comment" else 0.3)]
        r.shuffle(before)
        body = "".join(map(self.boilerplate, before)) + self.content() + "".join(map(self.boilerplate, after))
        for _ in range(r.choice([0, 0, 1, 2])):
            name = r.choice(WRAP)
            body = r.choice([f'<div class="{name}">{body}</div>', f'<div id="{name}">{body}</div>', f"<main>{body}</main>"])
        return f"<!DOCTYPE html><html><head><title>{self.phrase(1, 6)}</title></head><body>{body}</body></html>"
