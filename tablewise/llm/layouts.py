"""Pages in many layouts, dressed from given texts, with a known label for every block."""

from __future__ import annotations

import html

import numpy as np

MAIN, OTHER = "\x0e", "\x0f"  # marks before each block's text

#: Names that sites give to the parts of a page.
CONTENT = "article content post entry story main text body page-content article-body post-content entry-content main-content".split()
FRAMES = "wrapper container page row col layout site inner outer grid".split()
PARTS = {
    "menu": "nav menu navbar navigation breadcrumb topnav links tabs dropdown".split(),
    "header": "header masthead topbar logo branding banner site-header page-header".split(),
    "footer": "footer copyright legal bottom colophon site-footer page-footer imprint".split(),
    "sidebar": "sidebar aside widget related recommended trending rail popular more-stories".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay cookie-banner privacy paywall".split(),
    "advert": "ad ads advert advertisement sponsor promo sponsored banner-ad adsbox partner".split(),
    "form": "newsletter subscribe search login signup form contact search-box".split(),
    "comments": "comments comment-list discussion replies responses disqus reader-comments comment".split(),
    "share": "share social follow tags pagination toolbar meta-links".split(),
}
ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
PHRASES = (
    "Home|About us|Contact|Privacy policy|Terms of use|Sign in|Subscribe|Read more|Share|Search|Next|Previous|Archive|Advertisement|"
    "We use cookies to improve your visit.|Accept all|Your email|Send|Comments (12)|Reply|All rights reserved.|© 2020 Example|"
    "Startseite|Impressum|Datenschutz|Wir verwenden Cookies.|Accueil|Mentions légales|Nous utilisons des cookies.|Inicio|Aviso legal|"
    "Usamos cookies.|Related stories|Most read|Follow us|Sponsored|Leave a comment|Latest news|Weather|Sport|Menu|Skip to content"
).split("|")


class Dresser:
    """Draws pages; ``prose`` and ``small`` are texts of content and of page furniture."""

    def __init__(self, prose: list[str], small: list[str], seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.prose = prose or [" ".join(PHRASES[i : i + 9]) for i in range(len(PHRASES))]
        self.small = small + PHRASES * max(1, len(small) // len(PHRASES) // 2)

    def pick(self, values):
        return values[int(self.rng.integers(len(values)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def some(self, mark: str, prose: float) -> str:
        text = self.pick(self.prose if self.chance(prose) else self.small)
        words = text.split()
        if len(words) > 60:  # sentences of any length come from anywhere in the text
            first = int(self.rng.integers(len(words) - 40))
            words = words[first : first + int(self.rng.integers(3, 60))]
        return mark + html.escape(" ".join(words))

    def box(self, element: str, names: list[str], inner: str) -> str:
        name = self.pick(names)
        style = int(self.rng.integers(4))
        mark = [f' class="{name}"', f' id="{name}"', f" class='{name} {self.pick(FRAMES)}'", f' class="{self.pick(FRAMES)}-{name}"'][style]
        return f"<{element}{mark}>{inner}</{element}>"

    def listed(self, mark: str, n: int, prose: float = 0.0) -> str:
        if self.chance(0.7):
            items = "".join(f'<li><a href="/{i}">{self.some(mark, prose)}</a></li>' for i in range(n))
            return f"<ul>{items}</ul>"
        return "".join(f'<div><a href="#">{self.some(mark, prose)}</a></div>' for _ in range(n))

    def part(self, kind: str, plain: bool = False) -> str:
        """A part that is no content: by its element, its names, or (plain) by what it holds alone."""
        n = int(self.rng.integers(1, 7))
        if plain:
            return f"<div>{self.listed(OTHER, n + 3)}</div>"
        if kind in ("menu", "share"):
            inner = self.listed(OTHER, n + 1)
        elif kind == "form":
            inner = f"<label>{self.some(OTHER, 0)}</label><input name=q><p>{self.some(OTHER, 0.3)}</p><button>{self.some(OTHER, 0)}</button>"
            if self.chance(0.3):
                inner += f"<select><option>{self.some(OTHER, 0)}<option>{self.some(OTHER, 0)}</select>"
        elif kind == "comments":
            inner = f"<h3>{self.some(OTHER, 0)}</h3>" + "".join(
                self.pick(["<div class=comment><b>Name</b><p>{}</p></div>", "<li class='comment'><p>{}</p></li>", "<article class=comment>{}</article>",
                           "<p>{}</p>"]).replace("<b>Name</b>", f"<b>{OTHER}Name</b>").format(self.some(OTHER, 0.8)) for _ in range(n))
        elif kind == "sidebar":
            inner = f"<h3>{self.some(OTHER, 0.2)}</h3>" + (self.listed(OTHER, n, 0.4) if self.chance(0.6) else f"<p>{self.some(OTHER, 0.7)}</p>")
        elif kind == "header":
            inner = self.pick(["<h1>{}</h1>", "<p>{}</p>", "<a href=/>{}</a>", "{}"]).format(self.some(OTHER, 0.2))
        else:
            inner = "".join(self.pick(["<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span> "]).format(self.some(OTHER, 0.5)) for _ in range(1 + n // 4))
            inner = inner if inner.count(OTHER) == 1 or not self.chance(0.5) else f"<p>{self.some(OTHER, 0.5)}</p>"
        known = kind in ELEMENTS and self.chance(0.6)
        if known and self.chance(0.5):
            return f"<{ELEMENTS[kind]}>{inner}</{ELEMENTS[kind]}>"
        element = ELEMENTS[kind] if known else self.pick(["div", "section"] if kind != "advert" else ["div", "aside", "section"])
        return self.box(element, PARTS[kind], inner)

    def content_block(self) -> str:
        kind = int(self.rng.integers(16))
        t = lambda prose=0.95: self.some(MAIN, prose)
        if kind < 9:
            return f"<p>{t()}</p>" if self.chance(0.9) else f"<p><b>{t()}<br>"
        if kind == 9:
            return f"<h2>{t()}</h2>"
        if kind == 10:
            return "<ul>" + "".join(f"<li>{t()}</li>" for _ in range(int(self.rng.integers(1, 5)))) + "</ul>"
        if kind == 11:
            return f"<blockquote><p>{t()}</p></blockquote>" if self.chance(0.5) else f"<blockquote>{t()}</blockquote>"
        if kind == 12:
            return "<table>" + "".join(f"<tr><td>{t()}</td><td>{t()}</td></tr>" for _ in range(2)) + "</table>"
        if kind == 13:
            return f"<figure><img src=x><figcaption>{t()}</figcaption></figure>"
        if kind == 14:
            return f"<pre>{t()}</pre>" if self.chance(0.5) else f"<div>{t()}</div>"
        return f'<p><a href="/x">{t()}</a></p>' if self.chance(0.3) else f"<h3>{t()}</h3>"

    def page(self) -> str:
        plain = self.chance(0.08)
        parts = list(PARTS)
        content = [f"<h1>{self.some(MAIN, 0.9)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 12))):
            content.append(self.content_block())
        if not plain:
            for _ in range(int(self.rng.integers(0, 3))):
                content.insert(int(self.rng.integers(len(content) + 1)), self.part(self.pick(["advert", "share", "form", "sidebar", "notice", "comments"])))
        inner = "".join(content)
        if plain:
            main = f"<div>{inner}</div>"
        elif self.chance(0.45):
            main = f"<article>{inner}</article>"
        elif self.chance(0.3):
            main = self.box("main", CONTENT, inner) if self.chance(0.5) else f"<main>{inner}</main>"
        elif self.chance(0.2):
            main = f'<div role="main">{inner}</div>'
        else:
            main = self.box(self.pick(["div", "section", "article", "div"]), CONTENT, inner)
        if self.chance(0.3):
            main = self.box("div", FRAMES, main)
        before = [self.part(self.pick(parts), plain) for _ in range(int(self.rng.integers(0, 4)))]
        after = [self.part(self.pick(parts), plain) for _ in range(int(self.rng.integers(0, 4)))]
        head = f"<head><title>{self.some(OTHER, 0.8)}</title><style>p{{}}</style></head>" if self.chance(0.8) else ""
        body = "".join([*before, main, *after])
        if self.chance(0.3):
            body = self.box("div", FRAMES, body)
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
