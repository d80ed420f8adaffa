"""Labelled pages to train the extractor on: common layouts, filled with random words.

A page is a list of (html, texts of main-text blocks). Layouts differ in what holds the main
text (article, main, or containers by class or id, or none), in the boilerplate around and
inside it, in naming and in how well tags are closed. Words are random strings, so only
structure and shape can be learned. Labels: headings, paragraphs, lists, quotes and tables of
the main text are 1; menus, headers, footers, sidebars, notices, adverts, forms, share bars,
related links and reader comments are 0.
"""

from __future__ import annotations

import random

_LETTERS = "abcdefghijklmnopqrstuvwxyzéèüñßо漢字"


class _Page:
    def __init__(self, rng: random.Random):
        self.r, self.main = rng, []
        self.ends = rng.choice([[".", ".", ".", ",", "!", "?"]] * 5 + [["***", "$$$", "!!", "", " |"]])

    def word(self) -> str:
        return "".join(self.r.choices(_LETTERS, k=self.r.randint(1, 9)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi))).capitalize()

    def prose(self, lo: int = 5, hi: int = 90) -> str:
        out, n = [], self.r.randint(lo, hi)
        while n > 0:
            k = min(n, self.r.randint(1, 16))
            out.append(self.words(k, k) + self.r.choice(self.ends))
            n -= k
        return " ".join(out)

    def of(self, *names: str) -> str:
        return self.r.choice(names)

    def attr(self, *names: str) -> str:
        k = self.of("class", "class", "id")
        return f'{k}="{self.of("", "", "site-", "page-", "l-")}{self.of(*names)}{self.of("", "", " box", " wrap", "-1")}"'

    def links(self, lo: int = 3, hi: int = 9) -> str:
        n = self.r.randint(lo, hi)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
        return self.of(" | ", " ", "<br>").join(f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n))

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(parts))
            t = self.of("b", "em", "i", 'a href="/x"', "span", "strong", "code")
            parts[k] = f"<{t}>{parts[k]}</{t.split()[0]}>"
        return " ".join(parts)

    def block(self) -> str:
        """One piece of the main text; its texts are noted."""
        x = self.r.random()
        if x < 0.62:
            text = self.prose(*((1, 8) if self.r.random() < 0.15 else (5, 90)))
            self.main.append(text)
            y = self.r.random()
            if y < 0.15:
                return f"<p><b>{text}<br>"
            return f"<p>{self.inline(text)}{'</p>' if y < 0.9 else ''}" if y < 0.96 else f"<div>{self.inline(text)}</div>"
        if x < 0.72:
            text = self.words(1, 9)
            self.main.append(text)
            h = self.of("h2", "h3", "h4")
            return f"<{h}>{text}</{h}>"
        if x < 0.84:
            items = [self.prose(1, 14) for _ in range(self.r.randint(2, 6))]
            self.main += items
            t = self.of("ul", "ol")
            return f"<{t}>" + "".join(f"<li>{self.inline(i)}</li>" for i in items) + f"</{t}>"
        if x < 0.92:
            text = self.prose(4, 40)
            self.main.append(text)
            return f"<blockquote>{self.of('<p>', '')}{text}</blockquote>" if self.r.random() < 0.7 else f"<pre>{text}</pre>"
        cells = [[self.words(1, 4) for _ in range(3)] for _ in range(self.r.randint(2, 4))]
        self.main += [c for row in cells for c in row]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>"

    def advert(self) -> str:
        body = self.of(self.prose(3, 30), f"<p>{self.prose(3, 30)}</p>", f'<a href="/x">{self.words(2, 8)}</a>')
        t = self.of("div", "div", "aside", "section")
        return f"<{t} {self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{body}</{t}>"

    def notice(self) -> str:
        t = self.of("div", "section", "p")
        inner = self.prose(5, 40) if t == "p" else self.of(f"<p>{self.prose(5, 40)}</p><button>{self.words(1, 2)}</button>", self.prose(5, 40))
        return f"<{t} {self.attr('cookie', 'cookies', 'cookie-notice', 'consent', 'notice', 'alert', 'gdpr', 'disclaimer', 'popup', 'modal')}>{inner}</{t}>"

    def form(self) -> str:
        t = f"<p>{self.prose(3, 20)}</p>" if self.r.random() < 0.5 else ""
        body = f"<form action='/x'>{t}<label>{self.words(1, 3)}</label><input name='q'><select><option>{self.word()}</option><option>{self.word()}</option></select><button>{self.words(1, 2)}</button></form>"
        return self.of(body, f"<div {self.attr('newsletter', 'signup', 'subscribe', 'login', 'search')}>{body}</div>", f"<div {self.attr('newsletter', 'signup', 'subscribe')}><p>{self.prose(4, 20)}</p></div>")

    def comments(self) -> str:
        one = lambda: f"<{t} {self.attr('comment', 'reply', 'comment-body')}>{self.of(f'<b>{self.words(1, 2)}</b>', f'<cite>{self.word()}</cite>', f'<h4>{self.words(1, 2)}</h4>', '')}<p>{self.prose(3, 60)}</p></{t}>"
        t = self.of("div", "li", "article")
        body = "".join(one() for _ in range(self.r.randint(1, 4)))
        body = f"<ol>{body}</ol>" if t == "li" else body
        head = f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else ""
        if self.r.random() < 0.2:
            body = "".join(f"<p>{self.prose(3, 50)}</p>" for _ in range(self.r.randint(1, 4)))
        c = self.of("section", "div", "div", "aside")
        return f"<{c} {self.attr('comments', 'comment-list', 'discussion', 'replies', 'responses', 'disqus')}>{head}{body}</{c}>"

    def sidebar(self) -> str:
        body = f"<h3>{self.words(1, 3)}</h3>" + self.of(self.links(), f"<p>{self.prose(3, 40)}</p>", self.links() + f"<p>{self.prose(3, 25)}</p>")
        if self.r.random() < 0.5:
            return f"<aside>{body}</aside>"
        return f"<div {self.attr('sidebar', 'side', 'related', 'widget', 'rail', 'aside', 'recommended', 'trending')}>{body}</div>"

    def share(self) -> str:
        return f"<div {self.attr('share', 'social', 'tags', 'breadcrumb', 'pagination')}>{self.links(2, 5)}</div>"

    def menu(self) -> str:
        return self.of(f"<nav>{self.links()}</nav>", f"<nav>{self.links()}</nav>", f"<div {self.attr('menu', 'nav', 'navbar', 'navigation', 'topbar')}>{self.links()}</div>", f'<div role="navigation">{self.links()}</div>')

    def head(self) -> str:
        body = self.of(f'<a href="/">{self.words(1, 3)}</a>', f"<h1>{self.words(1, 4)}</h1><p>{self.prose(2, 10)}</p>", f"<p>{self.prose(2, 12)}</p>") + self.of("", self.menu())
        return self.of(f"<header>{body}</header>", f"<header>{body}</header>", f"<div {self.attr('header', 'masthead', 'top')}>{body}</div>", "")

    def foot(self) -> str:
        body = self.of("", self.links()) + self.of("&copy; ", "&copy; ", "") + self.of(f"{self.word()}.example.com &middot; {self.prose(2, 20)}", f"<p>{self.prose(2, 30)}</p>")
        return self.of(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div {self.attr('footer', 'bottom', 'copyright', 'colophon')}>{body}</div>")

    def extra(self) -> str:
        return self.of(self.advert, self.advert, self.notice, self.form, self.share, self.sidebar, self.comments)()

    def article(self) -> str:
        title = self.words(2, 12)
        parts = []
        if self.r.random() < 0.85:
            self.main.append(title)
            h = f"<h1>{title}</h1>"
            parts.append(h)
        for _ in range(self.r.randint(1, 14)):
            parts.append(self.block())
            if self.r.random() < 0.06:
                parts.append(self.extra())
        if self.r.random() < 0.15:
            parts.append(self.of(self.comments, self.share, self.form)())
        body = "".join(parts)
        wrap = self.r.random()
        names = ("content", "article", "post", "entry", "story", "main", "text", "article-body", "entry-content", "post-content", "body")
        if wrap < 0.45:
            body = f"<article>{body}</article>"
        elif wrap < 0.55:
            body = f"<main>{body}</main>"
        elif wrap < 0.8:
            body = f"<div {self.attr(*names)}>{body}</div>"
        elif wrap < 0.9:
            body = f"<main><article><div {self.attr(*names)}>{body}</div></article></main>"
        return f"<div {self.attr('container', 'wrapper', 'page', 'row')}>{body}</div>" if self.r.random() < 0.25 else body

    def page(self) -> str:
        if self.r.random() < 0.06:  # a fragment: main text and nothing else
            body = "".join(self.block() for _ in range(self.r.randint(1, 8)))
            return self.of(body, f"<html><body>{body}</body></html>")
        before = [f() for f in (self.head, self.menu) if self.r.random() < 0.8]
        before += [self.extra() for _ in range(self.r.choice([0, 0, 1, 1, 2]))]
        after = [self.extra() for _ in range(self.r.choice([0, 0, 1, 1, 2, 3]))]
        after += [self.foot()] if self.r.random() < 0.9 else []
        body = "".join([*before, self.article(), *after])
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{body}{self.of('</body></html>', '')}"


def labelled_pages(n: int, seed: int = 3) -> list[tuple[str, set[str]]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = _Page(rng)
        html = p.page()
        out.append((html, {" ".join(t.split()) for t in p.main}))
    return out
