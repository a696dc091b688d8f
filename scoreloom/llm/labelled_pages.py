"""Labelled training pages: layouts with marked main text, filled with random words."""

from __future__ import annotations

import random
from collections.abc import Callable

from scoreloom.llm.dom import Node, read_html

#: Stands at the start of each marked text; read_html keeps it, and it is taken off when the mark is set.
MARK = ""
WORDS = "the of and to in is that for it as was with be by on not he this are at from his but an they which or had we there has one all their more will would who when so no out up into them then time some could these two may first any new only other over also after made many before must through".split()

# What parts of pages other than the article say.
PHRASES = {
    "notice": "Subscribe to our newsletter|We use cookies to improve your experience|Sign up for our newsletter and get news in your inbox|This site uses cookies|Accept all cookies|By staying here you give consent to cookies and agree to the privacy terms",
    "foot": "All rights reserved|Copyright by the publisher|Terms of use|Privacy policy|Imprint",
    "comment": "3 comments|Leave a reply|Join the discussion|Comments|12 replies",
    "related": "Related articles|You may also like these popular stories|Most popular|Recommended for you|Trending now|Related",
    "ad": "Advertisement|Sponsored|Buy now|Sponsored by our partners|Shop now and save",
    "share": "Share this|Tweet|Follow us|Share on Facebook",
    "nav": "Home|About us|Contact|News|Search|Menu|Login",
}
#: Words of class names: of what an article is called, and of what they tell about it that is not what they hint at.
NAMED = "article post story content entry main text body page".split()
TOLD = "ad-free no-sidebar has-comments with-menu header-image share-enabled footer-top no-ads top-story has-sidebar subscriber-only comment-open nav-open message info single related-to menu-page promo-free cookie-ok date-first".split()


class Writer:
    """Random prose and page parts; ``main`` marks what it writes as main text."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(WORDS) for _ in range(self.rng.randint(low, high)))

    def says(self, group: str) -> str:
        return self.rng.choice(PHRASES[group].split("|"))

    def misled(self) -> str:
        """A class name of an article with words that hint at other things."""
        a, b = self.rng.choice(NAMED), self.rng.choice(TOLD)
        return self.pick(f"{b}-{a}", f"{a} {b}", f"{a}-{b}", f"{b} {a}", f"{a}--{b}")

    def sentence(self) -> str:
        a = self.words(1, 16)
        if self.rng.random() < 0.03:
            a += " " + self.rng.choice(self.says(self.rng.choice([*PHRASES])).lower().split())
        if self.rng.random() < 0.4:
            a += ", " + self.words(2, 9)
        return a.capitalize() + self.rng.choice(".....?!")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def some(self, chance: float, make: Callable[[], str]) -> str:
        return make() if self.rng.random() < chance else ""

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and self.rng.random() < 0.4:
            i = self.rng.randrange(len(words) - 2)
            last = min(len(words) - 1, i + self.rng.choice([1, 1, 2, 4, 7]))
            words[i:last] = [" ".join(words[i:last])]
            tag = self.pick('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "{}<br>")
            words[i] = tag.format(words[i])
        return " ".join(words)

    # main text

    def main_block(self) -> str:
        kind = self.rng.random()
        p = lambda: MARK + self.inline(self.prose())
        if kind < 0.06:
            return self.pick('<p><a href="/x">{}</a></p>', '<p>{} <a href="/x">more here</a>.</p>', '<p><a href="/x"><b>{}</b></a></p>').format(MARK + self.pick(self.sentence(), self.words(3, 12)))
        if kind < 0.09:
            return self.pick("<aside><blockquote>{}</blockquote></aside>", '<aside class="pullquote"><p>{}</p></aside>', "<aside><p><q>{}</q></p></aside>", '<aside class="quote">{}</aside>').format(MARK + self.sentence())
        if kind < 0.13:
            return f'<p class="{self.pick("message", "lead", "note", "intro", "info", "single", "top", "date-line", "more")}">{p()}</p>'
        if kind < 0.66:
            return self.pick("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>").format(p())
        if kind < 0.74:
            return f"<h2>{MARK}{self.words(1, 8).capitalize()}</h2>"
        if kind < 0.88:
            tag = self.pick("ul", "ol")
            item = self.pick("<li>{}</li>", '<li><a href="/x">{}</a></li>', '<li><a href="/x">{}</a></li>')
            return f"<{tag}>" + "".join(item.format(MARK + (self.words(2, 9) if "href" in item else self.inline(self.pick(self.sentence(), self.words(2, 8))))) for _ in range(self.rng.randint(2, 5))) + f"</{tag}>"
        if kind < 0.94:
            return f"<blockquote><p>{p()}</p></blockquote>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        return f"<pre>{MARK}{self.words(4, 20)}</pre>"

    def main(self, low: int = 1, high: int = 9) -> list[str]:
        title = f"<h1>{MARK}{self.words(2, 10).capitalize()}</h1>"
        style = self.rng.random()
        if style < 0.12:  # many short paragraphs
            line = lambda: self.pick(self.words(1, 3).capitalize() + ".", self.words(1, 4), self.sentence())
            fixed = line()
            again = self.rng.random() < 0.5
            blocks = [f"<p>{MARK}{fixed if again else line()}</p>" for _ in range(self.rng.randint(10, 90))]
        elif style < 0.2:  # one very long paragraph
            blocks = [f"<p>{MARK}{self.pick(self.words(100, 400), self.prose(30, 60))}</p>"]
        elif style < 0.3:  # plain prose only
            blocks = [f"<p>{MARK}{self.prose(1, 5)}</p>" for _ in range(self.rng.randint(1, 30))]
        else:
            blocks = [self.main_block() for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.35:
            blocks[0] = f"<p><b>{MARK}{self.prose(1, 2)}<br>" + blocks[0]
        if self.rng.random() < 0.25:
            blocks.append(f"<p>{MARK}{self.words(1, 2).capitalize()}.</p>")
        title = title if self.rng.random() < 0.85 else ""
        if title and self.rng.random() < 0.15:
            title = f"<header>{title}</header>"
        return [title, *blocks]

    # everything else

    def links(self, low: int = 3, high: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.rng.randint(low, high))) + "</ul>"

    def bare_links(self) -> str:
        return self.pick(" | ", " ", " &middot; ").join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(self.rng.randint(3, 8)))

    def menu(self) -> str:
        body = self.pick(self.links(), self.bare_links())
        return self.pick("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<ul class="navbar"><li>{}</li></ul>', '<div role="navigation">{}</div>', '<nav class="breadcrumbs">{}</nav>').format(body)

    def header(self) -> str:
        inner = self.pick(self.words(1, 3), f'<a href="/">{self.words(1, 2)}</a>', f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.sentence()}</p>")
        return self.pick("<header>{}{}</header>", '<div class="header">{}{}</div>', '<div id="masthead">{}{}</div>', '<div class="top-bar">{}{}</div>').format(inner, self.some(0.5, self.menu))

    def advert(self) -> str:
        text = self.some(0.3, lambda: self.says("ad") + " ") + self.pick(self.prose(1, 3), f'<a href="/buy">{self.words(2, 8)}</a>', f"<p>{self.prose(1, 2)}</p>")
        return self.pick('<div class="ad">{}</div>', '<div class="ad">{}</div>', '<div class="advertisement">{}</div>', '<aside class="sponsored">{}</aside>', '<div id="ad-slot-1"><span>Ad</span>{}</div>', '<section class="promo">{}</section>').format(text)

    def sidebar(self) -> str:
        inner = self.pick(f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.prose(1, 3)}</p>", f"<h4>{self.words(1, 2)}</h4><p>{self.prose(1, 4)}</p>{self.links(2, 4)}")
        return self.pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar"><div class="widget">{}</div></div>', '<div class="related">{}</div>', '<section class="related-posts">{}</section>', '<div class="popular widget">{}</div>').format(inner)

    def notice(self) -> str:
        inner = self.pick(self.says("notice") + ". " + self.some(0.5, self.sentence), self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>")
        return self.pick('<div class="cookie-banner">{}<button>OK</button></div>', '<div class="notice">{}</div>', '<div id="consent" role="dialog">{}</div>', '<div class="newsletter">{}</div>', '<div class="alert">{}</div>', '<p class="disclaimer">{}</p>', '<section class="subscribe">{}</section>', '<dialog>{}</dialog>').format(inner)

    def form(self) -> str:
        return self.pick("<form>{}<input><button>Go</button></form>", '<form class="search"><label>{}</label><input></form>', '<div class="login"><form><p>{}</p><input></form></div>', "<form><fieldset><legend>{}</legend><select><option>x</option></select></fieldset></form>").format(self.pick(self.words(1, 5), self.sentence()))

    def comments(self) -> str:
        one = lambda: self.pick('<div class="comment"><p>{}</p></div>', '<li class="comment"><b>{}</b><p>{}</p></li>', '<article class="comment"><p>{}</p></article>', '<div class="comment-body">{}</div>').format(self.pick(self.prose(1, 4), self.words(1, 3)), self.prose(1, 4))
        body = "".join(one() for _ in range(self.rng.randint(1, 5)))
        return self.pick('<section class="comments"><h2>{}</h2>{}</section>', '<div id="comments"><h3>{}</h3>{}</div>', '<ol class="comment-list"><li>{}</li>{}</ol>', '<div class="discussion"><p>{}</p>{}</div>').format(self.pick(self.words(1, 3), self.says("comment")), body)

    def share(self) -> str:
        return self.pick('<div class="share">{}</div>', '<ul class="social"><li>{}</li></ul>', '<div class="post-meta tags">{}</div>').format(self.bare_links())

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.words(1, 2)} &middot; {self.sentence()}", f"<p>© {self.words(1, 4)}</p>", self.bare_links(), f"<p>{self.prose(1, 3)}</p>{self.links(2, 5)}")
        return self.pick("<footer>{}</footer>", "<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>', '<div role="contentinfo">{}</div>').format(inner)

    # parts that nothing but their place, their links and what they say tells apart

    def plain_top(self) -> str:
        return self.pick('<div><a href="/">{}</a></div>', '<p><a href="/">{}</a></p>', '<div><div><a href="/">{}</a></div></div>').format(self.words(1, 3)) + self.some(0.7, self.plain_menu)

    def plain_menu(self) -> str:
        named = self.pick(" | ", " ", " - ").join(f'<a href="#">{self.pick(self.says("nav"), self.words(1, 2))}</a>' for _ in range(self.rng.randint(3, 8)))
        return self.pick("<div>{}</div>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<div><div>{}</div></div>", "<center>{}</center>").format(self.pick(named, named, self.links()))

    def plain_notice(self) -> str:
        return self.pick("<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>", "<div><b>{}</b></div>").format(self.says("notice") + self.pick("", ".", ". " + self.sentence()))

    def plain_advert(self) -> str:
        return self.pick("<div>{} {}</div>", '<div><span>{}</span> <a href="/b">{}</a></div>', "<div><p>{}</p><p>{}</p></div>").format(self.says("ad"), self.pick(self.words(2, 8), self.sentence()))

    def plain_side(self) -> str:
        return self.pick("<div><h3>{}</h3>{}</div>", "<div><p>{}</p>{}</div>", "<div><div>{}</div>{}</div>").format(self.says("related"), self.links())

    def plain_comments(self) -> str:
        one = lambda: self.pick("<div><b>{}</b><p>{}</p></div>", "<div><div>{}</div><div>{}</div></div>", "<li><i>{}</i><p>{}</p></li>").format(self.words(1, 2), self.prose(1, 3))
        return self.pick("<div><h3>{}</h3>{}</div>", "<section><h2>{}</h2>{}</section>").format(self.says("comment"), "".join(one() for _ in range(self.rng.randint(1, 4))))

    def plain_foot(self) -> str:
        inner = self.pick(f"&copy; {self.words(1, 3)}", f"{self.says('foot')}", f"&copy; {self.words(1, 2)}. {self.says('foot')}.", f'{self.says("foot")} <a href="#">{self.says("foot")}</a> <a href="#">{self.says("nav")}</a>')
        return self.pick("<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>", "<hr><p>{}</p>", "<center>{}</center>").format(inner)

    def plain_page(self) -> str:
        """A page without classes or elements that name their use: the article bare in the body, in elements or in a table's cell."""
        body = self.main()
        for make, chance in ((self.plain_advert, 0.15), (self.plain_notice, 0.1)):
            if self.rng.random() < chance:
                body.insert(self.rng.randint(1, len(body)), make())
        inner = "".join(body)
        before = self.some(0.5, self.plain_top) + self.some(0.4, self.plain_menu) + self.some(0.15, self.plain_notice) + self.some(0.15, self.plain_advert)
        after = self.some(0.2, self.plain_notice) + self.some(0.25, self.plain_side) + self.some(0.2, self.plain_comments) + self.some(0.15, self.plain_advert)
        foot = self.some(0.55, self.plain_foot)
        shape = self.rng.random()
        if shape < 0.2:
            return f"<html><body>{inner}</body></html>" if shape < 0.1 else inner
        if shape < 0.55:
            return f"<html><body>{before}{inner}{after}{foot}</body></html>"
        if shape < 0.65:
            side = self.pick(self.plain_menu, self.plain_side)()
            cells = self.pick(f"<td>{side}</td><td>{inner}</td>", f"<td>{inner}</td><td>{side}</td>", f"<td>{inner}</td>")
            return f"<html><body>{before}<table><tr>{cells}</tr></table>{after}{foot}</body></html>"
        shell = self.pick("<div>{}</div>", "<div><div>{}</div></div>", "<center>{}</center>", '<div id="c">{}</div>', '<div id="x1"><div>{}</div></div>', "<div><section>{}</section></div>")
        return f"<html><body>{before}{shell.format(inner)}{after}{foot}</body></html>"

    def page(self) -> str:
        if self.rng.random() < 0.4:
            return self.plain_page()
        body = self.main()
        rounds = self.rng.choice([1, 1, 1, 2, 3])  # some articles are full of other things
        for make, chance in ((self.advert, 0.3), (self.share, 0.2), (self.notice, 0.2), (self.form, 0.1), (self.sidebar, 0.12)) * rounds:
            if self.rng.random() < chance:
                body.insert(self.rng.randint(1, len(body)), make())
        inner = "".join(body) + self.some(0.12, self.comments) + self.some(0.08, lambda: f"<footer>{self.bare_links()}</footer>")
        shell = self.pick("<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<div class="entry-content">{}</div>', '<div itemprop="articleBody" class="story">{}</div>', "<section>{}</section>", "<div>{}</div>", *[self.pick(f'<div class="{self.misled()}">{{}}</div>', f'<article class="{self.misled()}">{{}}</article>', f'<div id="{self.misled()}"><div>{{}}</div></div>', f'<section class="{self.misled()}">{{}}</section>') for _ in range(4)])
        before = self.some(0.5, self.header) + self.some(0.7, self.menu) + self.some(0.25, self.notice) + self.some(0.5, self.advert) + self.some(0.15, self.form)
        after = self.some(0.4, self.sidebar) + self.some(0.25, self.comments) + self.some(0.2, self.advert) + self.some(0.1, self.form)
        middle = shell.format(inner)
        if self.rng.random() < 0.3:
            middle = self.pick('<div class="wrapper">{}</div>', '<div id="page"><div class="row">{}</div></div>', "<div>{}</div>", '<div class="container">{}</div>').format(self.some(0.3, self.sidebar) + middle + self.some(0.3, self.sidebar))
        foot = self.some(0.85, self.footer) + self.some(0.1, self.notice)
        if self.rng.random() < 0.15:  # little but the article
            before, after, foot = self.some(0.3, self.menu), "", self.some(0.3, self.footer)
        named = self.some(0.2, lambda: f' class="{self.misled()}"')
        return f"<!DOCTYPE html><html><head><title>x</title></head><body{named}>{before}{middle}{after}{foot}</body></html>"


def labelled_pages(n: int, seed: int) -> list[list[Node]]:
    """``n`` pages as trees whose text runs have ``mark`` set where they are main text."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        nodes = read_html(Writer(rng).page())
        for node in nodes:
            if node.text.startswith(MARK):
                node.mark, node.text = True, node.text.replace(MARK, "")
        out.append(nodes)
    return out
