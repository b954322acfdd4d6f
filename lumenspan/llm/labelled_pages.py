"""Pages in which the main text is marked, for learning what it looks like.

``PAGES`` are written by hand; ``made`` makes any number more by a rule: layouts of a page, blocks
around and within its main text, and names that their elements bear. ``[[`` begins and ``]]`` ends
main text; both are taken out before use.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

PAGES = (
    """<html><head><title>Harbour ferries return</title></head><body><header><a href="/">Daily Quay</a><p>News since 1901</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></nav>
<article>[[<h1>Harbour ferries return after repairs</h1><p>The two ferries that were taken out of service in spring went back to work this morning.</p>
<p>A spokesperson said that the <a href="/x">new engines</a> use a third less fuel, and that the timetable stays as it was.</p>
<p>Passengers waved from the deck.</p>]]</article>
<aside><h3>Most read</h3><ul><li><a href="/1">Bridge closed</a></li><li><a href="/2">Rain ahead</a></li></ul></aside>
<footer>&copy; Daily Quay <a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></footer></body></html>""",
    """<html><body><div><a href="/">Start</a> | <a href="/blog">Blog</a> | <a href="/about">About</a></div>
<div><div>[[<h2>Baking bread at home</h2><p>Flour, water, salt and time are all that a good loaf needs.<br>Mix them in the evening and let the dough rest until the morning.</p>
<ul><li>500 g of flour</li><li>350 g of water</li><li>10 g of salt</li></ul><p>Bake it hot, with <b>steam</b>, for forty minutes, and wait before you cut it.</p>]]</div>
<div><h4>Share this</h4><a href="#">Mail</a> <a href="#">Print</a></div></div>
<form><label>Newsletter</label><input><button>Subscribe</button></form><div><a href="/1">Older</a> <a href="/2">Newer</a></div></body></html>""",
    """<html><body><table><tr><td><a href="/1">Archive</a></td><td><a href="/2">Forum</a></td><td><a href="/3">Shop</a></td></tr></table>
[[<h1>How tides are predicted</h1><p>Tide tables add up dozens of regular waves, each with the period of some motion of sun and moon.</p>
<blockquote>The sea keeps better time than the clerk.</blockquote><p>A year of readings at one place is enough to fix the height and the lag of each wave.</p>
<p>Wind and air pressure are left over; they are forecast with the weather.</p>]]
<div class="comments"><p>Comments (2)</p><p><b>Ann</b> Nice!</p><p><b>Bo</b> Thanks.</p></div><hr><p><a href="/t">Terms</a> <a href="/h">Help</a></p></body></html>""",
    """<html><body><div><img><a href="/login">Log in</a></div><div>We use cookies. <a href="#">Accept</a> <a href="#">Settings</a></div>
<main>[[<h1>Notes on a glacier</h1><p>Meltwater carves a tunnel under the ice each summer, and the tunnel closes again in winter.</p>
<p>We walked up with a drill, a tent and too much rope, and measured how fast the walls creep inwards.</p><h2>Results</h2>
<p>About two metres a month, faster near the bed than the models of the time would have it.</p><pre>depth 40 m  creep 2.1</pre>]]</main>
<div><h3>Related</h3><ul><li><a href="/1">Ice cores</a></li><li><a href="/2">Moraines</a></li><li><a href="/3">Maps</a></li></ul></div></body></html>""",
)

#: Words that name what is no main text, by the kind of block; shapes and places go with all kinds.
NAMES = {
    "ad": "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar toc",
    "side": "sidebar aside widget related recommended trending popular tags tagcloud complementary",
    "reader": "comment comments commentlist disqus respond replies reply",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog",
    "share": "share sharing social follow newsletter subscribe subscription signup login search",
    "foot": "footer masthead copyright imprint legal contentinfo",
}
SHAPES = (
    "box bar list links link item items wrapper wrap container block section area panel row col site page global main primary "
    "secondary top bottom left right inner outer header head body foot content text title form button buttons icon media unit group "
    "thread story post posts article articles stories news most us on this fixed sticky mobile desktop policy feed entry layout grid"
)
_SAID = {
    "ad": "Buy now and save on {}",
    "menu": "Home",
    "side": "Most read {}",
    "reader": "I think that {} is right and wrote so before {}",
    "notice": "We use cookies and similar means for {}",
    "share": "Share this by mail or post {}",
    "foot": "Copyright {} all rights reserved",
}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)
        sounds = [a + b for a in ("", *"bdfgklmnprstvz") for b in "aeiou"]
        self.words = ["".join(self.draw.choices(sounds, k=self.draw.randint(1, 4))) for _ in range(4000)]
        self.kinds = {k: v.split() for k, v in NAMES.items()}
        self.shapes = SHAPES.split()

    def text(self, n: int) -> str:
        return " ".join(self.draw.choices(self.words, k=n))

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def bad_name(self, kind: str) -> str:
        parts = [self.draw.choice(self.kinds[kind])]
        for _ in range(self.draw.choice((0, 0, 1, 1, 2))):
            parts.insert(self.draw.randint(0, len(parts)), self.draw.choice((*self.shapes, str(self.draw.randint(1, 300)))))
        return self.draw.choice("-_").join(parts)

    def good_name(self) -> str:
        """Names of content: shapes, words of the topic, and words of the topic beside one that names a block."""
        parts = [self.draw.choice(self.shapes if self.chance(0.5) else self.words) for _ in range(self.draw.choice((1, 1, 2)))]
        if self.chance(0.03):
            odd = self.draw.choice([w for k in self.kinds.values() for w in k])
            parts = [odd, *self.draw.choices(self.words, k=self.draw.choice((1, 2)))]
            self.draw.shuffle(parts)
        return "-".join(parts)

    def named(self, name: str, on: str, by: str) -> str:
        return f'<{name} {self.draw.choice(("class", "class", "class", "id"))}="{on}{by}">'

    def bad(self, kind: str) -> str:
        """A block that is no main text, told by a name or by an element of its own."""
        own = {"menu": "nav", "side": "aside", "foot": "footer", "share": "form"}.get(kind)
        on = self.bad_name(kind)
        extra = f" {self.draw.choice(self.shapes)}" if self.chance(0.3) else ""
        name = own if own and self.chance(0.5) else self.draw.choice(("div", "div", "section", "ul"))
        begin = f"<{name}>" if name == own and self.chance(0.6) else self.named(name, on, extra)
        said = _SAID[kind].format(*[self.text(self.draw.choice((1, 3, 9, 30)))] * 2)
        link = lambda: f'<a href="/{self.draw.choice(self.words)}">{self.text(self.draw.randint(1, 4))}</a>'
        shown = self.draw.choice((3, 5, 12))
        if kind == "menu":
            inside = "".join(f"<li>{link()}</li>" if self.chance(0.9) else link() for _ in range(shown))
            inside = f"<ul>{inside}</ul>" if name != "ul" else inside
        elif kind == "reader":
            inside = "".join(f"<{t}><p><b>{self.text(1)}</b> {said}</p></{t}>" for t in [self.draw.choice(("li", "div", "article"))] * shown)
        elif kind == "side":
            inside = f"<h3>{said}</h3><ul>" + "".join(f"<li>{link()} {self.text(self.draw.choice((0, 0, 8)))}</li>" for _ in range(shown)) + "</ul>"
        elif kind == "share":
            inside = f"<label>{said}</label><input><button>{self.text(1)}</button>" if self.chance(0.5) else f"<h4>{said}</h4>{link()} {link()}"
        else:
            inside = f"<p>{said}</p>{link()}" if self.chance(0.6) else said
        return f"{begin}{inside}</{name}>"

    def bare(self) -> str:
        """Links and short lines around the main text without any name."""
        return self.draw.choice(
            (
                "<div>" + " | ".join(f'<a href="/{k}">{self.text(1)}</a>' for k in range(self.draw.randint(2, 6))) + "</div>",
                f'<p><a href="/">{self.text(2)}</a> <a href="/t">{self.text(1)}</a></p>',
                f'<table><tr><td><a href="/1">{self.text(1)}</a><td><a href="/2">{self.text(1)}</a></table>',
                f'<div><img src="logo.png"><a href="/login">{self.text(2)}</a></div>',
            )
        )

    def paragraph(self, n: int) -> str:
        body = self.text(n)
        if self.chance(0.2):
            body += f' <a href="/x">{self.text(2)}</a> {self.text(3)}'
        if self.chance(0.2):
            body = f"<b>{self.text(1)}</b> {body}"
        if self.chance(0.1):
            body = f"{body}<br>{self.text(2)}"
        begin = self.named("p", self.good_name(), "") if self.chance(0.1) else "<p>"
        return f"{begin}{body}" + ("</p>" if self.chance(0.85) else "")

    def block(self) -> str:
        part = self.draw.choice(("div", "section"))
        n = self.draw.choice((1, 3, 8, 15, 30, 60, 120))
        return self.draw.choice(
            (
                *[self.paragraph(n)] * 8,
                f"<h2>{self.text(min(n, 6))}</h2>{self.paragraph(n)}",
                "<ul>" + "".join(f"<li>{self.text(self.draw.randint(1, 9))}" for _ in range(4)) + "</ul>",
                f"<blockquote>{self.text(n)}</blockquote>",
                f"<pre>{self.text(n)}</pre>",
                "<table>" + "".join(f"<tr><td>{self.text(1)}</td><td>{self.text(2)}</td></tr>" for _ in range(3)) + "</table>",
                f"<figure><img src='x.png'><figcaption>{self.text(5)}</figcaption></figure>",
                f"{self.named(part, self.good_name(), '')}{self.paragraph(n)}</{part}>",
            )
        )

    def page(self) -> str:
        around = lambda n: "".join(self.bad(self.draw.choice(list(self.kinds))) if self.chance(0.8) else self.bare() for _ in range(n))
        whole = self.draw.choice(("article", "article", "main", "div", "none", "td"))
        blocks = [self.block() for _ in range(self.draw.choice((1, 2, 4, 8, 16)))]
        if self.chance(0.85):
            blocks.insert(0, f"<h1>{self.text(self.draw.randint(1, 9))}</h1>")
        if whole != "article" and sum(len(b.split()) for b in blocks) < 25:
            blocks.append(self.paragraph(30))
        for _ in range(self.draw.choice((0, 0, 0, 1, 2)) if len(blocks) > 2 and whole in ("article", "main") else 0):
            blocks.insert(self.draw.randint(1, len(blocks) - 1), f"]]{self.bad(self.draw.choice(('ad', 'side', 'share', 'notice')))}[[")
        inside = "[[" + "".join(blocks) + "]]"
        if whole == "td":
            inside = f"<table><tr><td>{around(1)}</td><td>{inside}</td></tr></table>"
        elif whole != "none":
            inside = (self.named(whole, self.good_name(), "") if self.chance(0.6) else f"<{whole}>") + f"{inside}</{whole}>"
        before = around(self.draw.randint(1, 4)) + ("<header><p>" + self.text(3) + "</header>" if self.chance(0.3) else "")
        middle = before + inside + around(self.draw.randint(1, 4))
        for _ in range(self.draw.choice((0, 0, 1, 1, 2, 3))):
            name = self.bad_name(self.draw.choice([k for k in self.kinds if k != "reader"])) if self.chance(0.4) else self.good_name()
            middle = f"{self.named('div', name, '')}{middle}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.text(4)}</title><style>p{{}}</style></head><body>{middle}</body></html>"


def made(n: int, seed: int = 1) -> Iterator[str]:
    """So many labelled pages, the same for the same seed."""
    maker = _Maker(seed)
    for _ in range(n):
        yield maker.page()
