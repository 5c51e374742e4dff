"""Labelled web pages for training the page model: random pages from layouts, each text marked as article or not."""

from __future__ import annotations

import random

#: Fixed class and id words by role, as pages commonly name their parts.
NAMES = {
    "main": "article content main post entry story text body article-body post-content entry-content page-content prose news-text".split(),
    "ad": "ad ads advert advertisement sponsored promo adbox ad-slot ad-banner adsense sponsor promotion".split(),
    "side": "sidebar side rail widget related recommended most-read aside trending popular sidebar-right see-also".split(),
    "comment": "comments comment comment-list replies reply respond discussion reader-comments disqus feedback".split(),
    "nav": "nav navbar menu breadcrumb breadcrumbs topbar navigation main-menu pagination tabs toc links".split(),
    "head": "header masthead site-header logo branding top page-header banner-top".split(),
    "foot": "footer site-footer copyright legal colophon bottom page-footer credits".split(),
    "notice": "notice cookie cookies cookie-banner consent gdpr alert subscribe newsletter popup modal paywall message announcement privacy".split(),
    "share": "share social follow share-buttons tags meta-links".split(),
    "form": "form search login signup contact search-box subscribe-form".split(),
}


class Page:
    """A page under construction; texts of the article carry the mark \\x01 in front, all others \\x02."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        style = r.random()
        made = ["".join(r.choice("abdefghilmnoprstuéü") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]
        if style < 0.1:
            made = [w.upper() + "!!" for w in made]
        elif style < 0.2:
            made = [w + r.choice(["***", "###", "&amp;&amp;", "%%%"]) for w in made]
        elif r.random() < 0.8:
            made[-1] += r.choice(".!?.")
        return " ".join(made).capitalize()

    def attr(self, role: str, sure: float = 1.0) -> str:
        if self.r.random() > sure:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[role])}"'

    def text(self, good: bool, low: int = 1, high: int = 40) -> str:
        return ("\x01" if good else "\x02") + self.words(low, high)

    def box(self, tag: str, attr: str, *inner: str) -> str:
        return f"<{tag}{attr}>{''.join(inner)}</{tag}>"

    def links(self, n: int) -> str:
        r = self.r
        item = lambda: f'<a href="/{r.randint(1, 99)}">{self.text(False, 1, 4)}</a>'
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return "".join(f"<div>{item()}</div>" if r.random() < 0.5 else f"<p>{item()}</p>" for _ in range(n))

    def paragraph(self, good: bool) -> str:
        r = self.r
        kind, body = r.random(), self.text(good, 1, r.choice([6, 30, 90]))
        if r.random() < 0.25:
            body += f" <b>{self.words(1, 4)}</b> " + self.words(1, 9)
        if r.random() < 0.15:
            body += f' <a href="/x">{self.words(1, 4)}</a>'
        if kind < 0.62:
            return f"<p>{body}</p>"
        if kind < 0.74:
            return f"<p><b>{body}<br>"
        if kind < 0.8:
            return f"<{'h2' if good else 'h4'}>{self.text(good, 1, 8)}</{'h2' if good else 'h4'}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.text(good, 2, 12)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.text(good, 1, 3)}</td><td>{self.text(good, 1, 3)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{self.text(good, 2, 12)}</figcaption></figure>"
        return f"<div>{body}</div>"

    def other(self, role: str) -> str:
        r = self.r
        if role == "nav":
            return self.box(r.choice(["nav", "nav", "div"]), self.attr("nav", 0.5 if r.random() < 0.5 else 1), self.links(r.randint(2, 9))) if r.random() < 0.6 else self.box("nav", "", self.links(r.randint(2, 9)))
        if role == "head":
            return self.box("header", self.attr("head", 0.5), f"<div>{self.text(False, 1, 5)}</div>") if r.random() < 0.6 else self.box("div", self.attr("head"), f"<p>{self.text(False, 1, 5)}</p>")
        if role == "foot":
            body = "&copy; " if r.random() < 0.6 else ""
            body = self.text(False, 1, 12).replace("\x02", "\x02" + body)
            return self.box("footer", self.attr("foot", 0.4), body if r.random() < 0.5 else f"<p>{body}</p>") if r.random() < 0.7 else self.box("div", self.attr("foot"), f"<p>{body}</p>")
        if role == "side":
            body = self.links(r.randint(1, 6)) if r.random() < 0.5 else f"<h3>{self.text(False, 1, 4)}</h3><p>{self.text(False, 3, 40)}</p>"
            return self.box("aside", self.attr("side", 0.5), body) if r.random() < 0.5 else self.box("div", self.attr("side"), body)
        if role == "comment":
            one = lambda: self.box(r.choice(["div", "li", "article"]), ' class="comment"' if r.random() < 0.7 else "", f"<p>{self.text(False, 2, 60)}</p>")
            return self.box(r.choice(["section", "div", "ol"]), self.attr("comment"), f"<h3>{self.text(False, 1, 3)}</h3>" if r.random() < 0.5 else "", *[one() for _ in range(r.randint(1, 5))])
        if role == "form":
            body = f"<label>{self.text(False, 1, 3)}</label><input name=q>"
            body += f"<select><option>{self.text(False, 1, 2)}</option></select>" if r.random() < 0.3 else ""
            return self.box("form", self.attr("form", 0.5), f"<p>{self.text(False, 2, 12)}</p>" if r.random() < 0.4 else "", body, f"<button>{self.text(False, 1, 2)}</button>")
        tag = r.choice(["div", "div", "section", "aside", "p", "ins"]) if role == "ad" else r.choice(["div", "div", "section", "p"])
        body = self.text(False, 2, 30)
        return self.box(tag, self.attr(role), body if tag in ("p", "ins") or r.random() < 0.6 else f"<p>{body}</p>")

    def article(self) -> str:
        r = self.r
        body = [f"<h1>{self.text(True, 1, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
            body.append(self.paragraph(True))
            if r.random() < 0.06:
                body.append(self.other(r.choice(["ad", "share", "side", "notice", "form"])))
        if r.random() < 0.15:
            body.append(self.other("comment"))
        kind = r.random()
        if kind < 0.55:
            return self.box("article", self.attr("main", 0.3), *body)
        if kind < 0.75:
            return self.box("main", self.attr("main", 0.3), *body)
        return self.box("div", self.attr("main"), *body)

    def html(self) -> str:
        r = self.r
        some = lambda p, *roles: [self.other(x) for x in roles if r.random() < p]
        top = some(0.5, "head", "nav", "notice", "ad", "form")
        low = some(0.5, "comment", "side", "ad", "foot") + some(0.15, "notice", "share", "form", "nav")
        if r.random() < 0.5:
            r.shuffle(top)
        parts = [*top, self.article(), *low]
        if r.random() < 0.2:
            parts.insert(len(top), self.other("side"))
        body = "".join(parts)
        if r.random() < 0.3:
            body = f'<div id="{r.choice(["wrap", "page", "container", "root"])}">{body}</div>'
        tail = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{}}</style></head><body>{body}{tail}"


def pages(n: int, seed: int = 1) -> list[str]:
    """n pages whose texts carry their marks."""
    return [Page(seed * 1_000_003 + i).html() for i in range(n)]
