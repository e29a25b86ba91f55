"""Labelled pages to learn from: invented layouts filled with invented words, each character known to be main text or not.

No table has labelled pages, so they are made: page furniture of many kinds around and inside an article, in elements and
class names that sites use for them, some of them nameless, so that a reader must go by place and wording as well.
"""

from __future__ import annotations

import random

#: Words of class and id attributes by the part of a page that they name.
NAMES = {
    "main": "content main article post entry story body text page single article-body post-content entry-content story-body articleText main-content prose blog-post news-detail".split(),
    "nav": "nav navbar menu navigation main-menu topnav site-nav links breadcrumbs breadcrumb tabs pagination pager sitemap".split(),
    "header": "header masthead site-header topbar top branding logo site-title page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot credits imprint".split(),
    "side": "sidebar side aside rail widget widgets secondary right-column related recommended popular trending most-read teaser more-stories".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo adsbygoogle ad-slot banner-ad adbox commercial partner-offer".split(),
    "notice": "cookie cookies cookie-banner consent gdpr notice alert banner popup modal overlay message privacy-notice newsletter paywall warning-bar".split(),
    "form": "form search search-form login signup newsletter-form contact subscribe feedback-form survey".split(),
    "comment": "comments comment comment-list comment-body responses respond reply discussion user-comments reader-comments replies thread".split(),
    "share": "share social sharing follow tags meta tools actions toolbar".split(),
}
#: Words that furniture often says, in the languages of the corpus; prose and furniture share all others.
SAYS = {
    "nav": "home news sports about contact services blog shop help login start inicio accueil startseite kontakt noticias produits".split(),
    "header": "welcome the daily site official portal news magazine your source for".split(),
    "footer": "© copyright all rights reserved privacy policy terms imprint impressum datenschutz mentions légales aviso legal 2024 2023 inc".split(),
    "side": "related read more popular trending latest most viewed also like recommended mehr lesen articles similaires".split(),
    "ad": "advertisement sponsored buy now sale discount offer free shipping save % deal anzeige publicité publicidad limited".split(),
    "notice": "we use cookies accept privacy policy consent agree this site close subscribe newsletter your browser cookie acepta akzeptieren".split(),
    "form": "search email your name password submit sign up send subscribe enter address login username suche rechercher".split(),
    "comment": "comments reply says posted by user ago like report thanks great i agree you lol antworten répondre responder".split(),
    "share": "share facebook twitter tweet email print tags follow us whatsapp pin".split(),
}
FUNCTION = "the of and to in is that for on with der die und das von mit le la les de et un que el los y en del".split()
_SYLLABLES = "the an er on in re ti es or st en al la le de ra no mi co ta ung ein sch lich heit eau tion ment ción ado que bo ri sa pe lu".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.parts, self.size, self.main = rng, [], 0, []
        self.vocabulary = ["".join(rng.choices(_SYLLABLES, k=n)) for n in rng.choices([1, 2, 3], k=150)] + FUNCTION
        # Some sites name their parts as others do, some by words of their own, some not at all.
        self.naming = rng.choices(["plain", "own", "none"], [6, 1, 2])[0]
        self.semantic = rng.random() < 0.55
        # Signs of lists and tables stand between the words of some articles as well.
        self.between = rng.choices([" ", " | ", " - ", " / ", " * "], [40, 2, 1, 1, 1])[0]

    def add(self, markup: str, main: bool = False) -> None:
        if main:
            self.main.append((self.size, self.size + len(markup)))
        self.parts.append(markup)
        self.size += len(markup)

    def words(self, n: int, kind: str = "") -> str:
        rng = self.rng
        said = SAYS.get(kind)
        picked = rng.choices(self.vocabulary, k=n)
        if said:
            picked = [rng.choice(said) if rng.random() < 0.35 else w for w in picked]
        if kind in ("", "ad", "side", "comment") and n > 4:
            for i in range(rng.randrange(4, 14), n, rng.randrange(5, 16)):
                picked[i] += rng.choice([".", ",", ".", ";"])
        text = (" " if kind else self.between).join(picked)
        return text[:1].upper() + text[1:] + (rng.choice(["", ".", "."]) if n > 4 else "")

    def named(self, kind: str) -> str:
        if self.naming == "none" and kind not in ("ad", "comment", "notice") or self.rng.random() < 0.1:
            return ""
        if self.naming == "own" and self.rng.random() < 0.6:
            name = "".join(self.rng.choice(_SYLLABLES) for _ in range(2))
        else:
            name = " ".join(self.rng.sample(NAMES[kind], self.rng.choice([1, 1, 1, 2])))
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def box(self, kind: str, tags: list[str], fill, main: bool = False) -> None:
        tag = self.rng.choice(tags) if self.semantic or "div" not in tags else "div"
        self.add(f"<{tag}{self.named(kind)}>")
        fill()
        self.add(f"</{tag}>")

    def links(self, kind: str, n: int, words: int) -> None:
        rng = self.rng
        listed = rng.random() < 0.7
        self.add("<ul>" if listed else "<div>" if rng.random() < 0.5 else "<p>")
        for _ in range(n):
            label = self.words(rng.randrange(1, words + 1), kind)
            self.add(f'<li><a href="/x">{label}</a></li>' if listed else f'<a href="/x">{label}</a> {rng.choice(["|", "", "·"])} ')
        self.add("</ul>" if listed else "")

    def prose(self, kind: str, least: int, most: int) -> None:
        n = self.rng.randrange(least, most)
        bare = self.rng.random() < 0.5
        self.add(self.words(n, kind) if bare else f"<p>{self.words(n, kind)}</p>")


def _furniture(page: _Page, kind: str) -> None:
    rng = page.rng
    if kind == "nav":
        page.box("nav", ["nav", "nav", "div", "ul"], lambda: page.links("nav", rng.randrange(2, 9), 2))
    elif kind == "header":
        def fill() -> None:
            page.add(rng.choice(["<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "<a href='/'>{}</a>"]).format(page.words(rng.randrange(1, 5), "header")))
            if rng.random() < 0.4:
                page.add(f"<p>{page.words(rng.randrange(3, 9), 'header')}</p>")
            if rng.random() < 0.4:
                _furniture(page, "nav")
        page.box("header", ["header", "div"], fill)
    elif kind == "footer":
        def fill() -> None:
            if rng.random() < 0.4:
                page.links("footer", rng.randrange(2, 8), 2)
            page.prose("footer" if rng.random() < 0.6 else "", 2, 25)
            if rng.random() < 0.3:
                page.add(f"&copy; {page.words(3, 'footer')} &middot; {page.words(rng.randrange(2, 14))}")
        page.box("footer", ["footer", "footer", "div"], fill)
    elif kind == "side":
        def fill() -> None:
            for _ in range(rng.randrange(1, 4)):
                page.add(f"<h{rng.choice([2, 3, 4])}>{page.words(rng.randrange(1, 4), 'side')}</h3>")
                if rng.random() < 0.6:
                    page.links("side", rng.randrange(2, 6), 8)
                else:
                    page.prose("side" if rng.random() < 0.5 else "", 5, 40)
        page.box("side", ["aside", "aside", "div", "section"], fill)
    elif kind == "ad":
        page.box("ad", ["div", "div", "aside", "section"], lambda: page.prose("ad" if rng.random() < 0.4 else "", 1, 30))
    elif kind == "notice":
        page.box("notice", ["div", "div", "section", "dialog"], lambda: page.prose("notice" if rng.random() < 0.8 else "", 4, 35))
    elif kind == "form":
        def fill() -> None:
            for _ in range(rng.randrange(1, 4)):
                page.add(f"<label>{page.words(rng.randrange(1, 4), 'form')}</label><input type='text'>" if rng.random() < 0.5 else f"<p>{page.words(rng.randrange(2, 15), 'form')}</p>")
            page.add("<button>Go</button>")
        page.add(f"<form action='/x'{page.named('form')}>" if rng.random() < 0.9 else f"<div{page.named('form')}>")
        fill()
        page.add("</form>")
    elif kind == "comment":
        def fill() -> None:
            if rng.random() < 0.6:
                page.add(f"<h3>{page.words(rng.randrange(1, 3), 'comment')}</h3>")
            tag = rng.choice(["li", "div", "article", "p"])
            for _ in range(rng.randrange(1, 7)):
                page.add(f"<{tag}{page.named('comment') if rng.random() < 0.7 else ''}>")
                if rng.random() < 0.6:
                    page.add(f"<b>{page.words(1)}</b> {page.words(2, 'comment')}<br>")
                page.prose("comment" if rng.random() < 0.5 else "", 2, 45)
                page.add(f"</{tag}>")
        page.box("comment", ["section", "div", "div", "ol"], fill)
    elif kind == "share":
        page.box("share", ["div", "ul"], lambda: page.links("share", rng.randrange(2, 6), 1))


def _article(page: _Page) -> None:
    rng = page.rng
    junk, line = rng.random() < 0.15, page.words(rng.randrange(1, 9))

    def block() -> None:
        kind = rng.choices(["p", "h", "list", "quote", "pre", "table", "bare", "figure", "dl"], [30, 4, 2, 2, 1, 1, 2, 1, 0.5])[0]
        n = rng.choice([rng.randrange(1, 8), rng.randrange(8, 60), rng.randrange(30, 120)])
        text = page.words(n, rng.choice([*SAYS]) if rng.random() < 0.06 else "")  # an article may speak of cookies
        if junk and rng.random() < 0.4:  # articles too have lines that repeat, words that repeat, and signs
            text = rng.choice([line, " ".join([page.words(1)] * n), text.replace(" ", rng.choice(["%%% ", "### ", "&&& ", " $ "]))])
        if kind == "p" and junk and rng.random() < 0.15:
            page.add(f"<p>{rng.choice([line, page.words(1), page.words(2) + '.'])}</p>" * rng.choice([3, 8, rng.randrange(3, 60)]), True)
        elif kind == "p":
            if rng.random() < 0.2 and n > 6:
                text = text.replace(" ", " <a href='/y'>", 1).replace(" ", "</a> ", 3).replace("</a> ", " ", 1) if rng.random() < 0.5 else f"<b>{text}<br>"
            page.add(f"<p>{text}" + ("</p>" if rng.random() < 0.8 else "<p>"), True)
        elif kind == "h":
            page.add(f"<h{rng.choice([2, 3])}>{page.words(rng.randrange(1, 8))}</h2>", True)
        elif kind == "list":
            tag = rng.choice(["ul", "ol"])
            page.add(f"<{tag}>" + "".join(f"<li>{page.words(rng.randrange(1, 25))}</li>" for _ in range(rng.randrange(2, 6))) + f"</{tag}>", True)
        elif kind == "quote":
            page.add(f"<blockquote><p>{text}</p></blockquote>", True)
        elif kind == "pre":
            page.add(f"<pre>{text}</pre>", True)
        elif kind == "table":
            page.add("<table>" + "".join(f"<tr><th>{page.words(1)}</th><td>{page.words(rng.randrange(1, 6))}</td></tr>" for _ in range(rng.randrange(1, 5))) + "</table>", True)
        elif kind == "figure":
            page.add(f"<figure><img src='a'><figcaption>{page.words(rng.randrange(3, 15))}</figcaption></figure>", True)
        elif kind == "dl":
            page.add("<dl>" + "".join(f"<dt>{page.words(2)}</dt><dd>{page.words(rng.randrange(3, 20))}</dd>" for _ in range(2)) + "</dl>", True)
        else:
            page.add(f"<div>{text}</div>" if rng.random() < 0.5 else f"{text}<br><br>", True)

    if rng.random() < 0.85:
        page.add(f"<h1>{page.words(rng.randrange(1, 12))}</h1>", True)
    inner = rng.choices(["", "ad", "share", "side", "form", "notice"], [8, 2, 1, 1, 1, 1])[0]
    count = rng.choice([1, 2, rng.randrange(2, 8), rng.randrange(4, 20), rng.randrange(2, 40)])
    at = rng.randrange(count + 1)
    for i in range(count):
        if inner and i == at:
            _furniture(page, inner)
        block()


def labelled_page(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """One page, and the spans of its characters that are main text."""
    page = _Page(rng)
    page.add("<!DOCTYPE html><html><head><meta charset='utf-8'><title>x</title><script>var a='</p>';</script></head><body>")
    before = [k for k, often in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("form", 0.2), ("ad", 0.4), ("side", 0.15), ("share", 0.1)) if rng.random() < often]
    after = [k for k, often in (("share", 0.2), ("ad", 0.25), ("comment", 0.35), ("form", 0.2), ("side", 0.35), ("nav", 0.2), ("footer", 0.8), ("notice", 0.15)) if rng.random() < often]
    if rng.random() < 0.3:
        rng.shuffle(before)
    wrapped = rng.random() < 0.3
    if wrapped:
        page.add(f"<div{page.named('main')}>")
    for kind in before:
        _furniture(page, kind)
    shape = rng.choices(["article", "div", "bare", "table"], [5, 4, 1, 0.5])[0] if page.naming != "own" else "div"
    start, end = {"article": (f"<article{page.named('main') if rng.random() < 0.4 else ''}>", "</article>"), "div": (f"<div{page.named('main')}>", "</div>"), "bare": ("", ""), "table": ("<table><tr><td>", "</td></tr></table>")}[shape]
    if page.semantic and rng.random() < 0.3:
        start, end = "<main>" + start, end + "</main>"
    page.add(start)
    _article(page)
    if rng.random() < 0.12:
        _furniture(page, "comment")
    page.add(end)
    for kind in after:
        _furniture(page, kind)
    if rng.random() < 0.8:
        page.add(("</div>" if wrapped else "") + "</body></html>")
    return "".join(page.parts), page.main


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(count)]
