"""Labelled training pages for the block classifier: made layouts whose text blocks are known to be content or not.

Layouts vary in what real sites vary in: semantic elements or plain ``div``s, names or none, wrappers that bear the name
of a layout, furniture inside the article, sections of an article that bear the name of furniture, short paragraphs and
wordy notices. Texts are random words, so only their shape can be learned.
"""

from __future__ import annotations

import random

# Names that sites give to page furniture, to their main text, and to nothing in particular.
MENU_NAMES = "nav navbar navigation menu topbar toolbar breadcrumb breadcrumbs pagination pager toc skip tabs".split()
TOP_NAMES = "header masthead banner branding site-header logo login search".split()
BOTTOM_NAMES = "footer copyright legal imprint site-footer colophon disclaimer".split()
SIDE_NAMES = "sidebar widget widgets related recommended trending popular teaser promo promoted tags archive".split()
ADVERT_NAMES = "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored".split()
NOTICE_NAMES = "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup privacy captcha".split()
SHARE_NAMES = "share sharing social follow".split()
COMMENT_NAMES = "comment comments commentlist discussion disqus respond replies reply feedback shoutbox".split()
CONTENT_NAMES = "article articlebody content entry post prose story body text main".split()
NEUTRAL_NAMES = "row col container wrapper inner box page site layout block item left right center section clearfix".split()
#: Names of furniture that sections of an article bear as well.
TOPIC_NAMES = "discussion related privacy share comments legal search feedback popular notice disclaimer tags social archive legal reply alert".split()
OUTER_ELEMENTS = "nav footer aside form menu dialog search".split()
OUTER_ROLES = "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()

#: Marks content in the texts of training pages; see :func:`training_pages`.
MARK = "\ue000"


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.names = rng.random() < 0.6  # does the site name its elements?
        self.semantic = rng.random() < 0.6  # does it use nav, footer, aside?

    def words(self, low: int, high: int, mark: bool = False) -> str:
        rng = self.rng
        made = ["".join(rng.choice("abdefgilmnorstu") for _ in range(rng.randint(1, 10))) for _ in range(rng.randint(low, high))]
        return (MARK if mark else "") + " ".join(made)

    def prose(self, sentences: int, mark: bool = False) -> str:
        made = " ".join(self.words(3, 22).capitalize().replace(" ", ", " if self.rng.random() < 0.2 else " ", 1) + self.rng.choice(["."] * 8 + ["?", "!"]) for _ in range(sentences))
        return (MARK if mark else "") + made

    def name(self, choices: list[str]) -> str:
        if not self.names:
            return ""
        rng, name = self.rng, self.rng.choice(choices)
        if rng.random() < 0.4:
            name = rng.choice([f"{rng.choice(NEUTRAL_NAMES)}-{name}", f"{name}-{rng.choice(NEUTRAL_NAMES)}", f"{name} {rng.choice(NEUTRAL_NAMES)}", f"js{name.capitalize()}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def box(self, inner: str, element: str, choices: list[str]) -> str:
        rng = self.rng
        if self.semantic and element != "div" and rng.random() < 0.8:
            return f"<{element}{self.name(choices) if rng.random() < 0.4 else ''}>{inner}</{element}>"
        role = f' role="{rng.choice(OUTER_ROLES)}"' if element == "nav" and rng.random() < 0.1 else ""
        tag = "div" if rng.random() < 0.8 else "section"
        wrapped = f"<{tag}{self.name(choices)}{role}>{inner}</{tag}>"
        return f"<div{self.name(NEUTRAL_NAMES)}>{wrapped}</div>" if rng.random() < 0.3 else wrapped

    def links(self, low: int, high: int, longest: int = 4) -> str:
        items = [f'<li><a href="/{i}">{self.words(1, longest)}</a></li>' for i in range(self.rng.randint(low, high))]
        return f"<ul>{''.join(items)}</ul>"

    def furniture(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            return self.box(rng.choice([self.links(3, 9), self.links(3, 9), self.words(1, 6)]), "nav", MENU_NAMES)
        if kind == "top":
            slogan = f"<p>{rng.choice([self.words(1, 5), self.prose(1)])}</p>"
            inner = f"<h1>{self.words(1, 3)}</h1>{slogan}" if rng.random() < 0.4 else slogan
            return self.box(inner, "header", TOP_NAMES)
        if kind == "bottom":
            inner = f"&copy; {self.words(1, 4)} {self.prose(rng.randint(0, 2))}"
            return self.box(inner if rng.random() < 0.5 else f"<p>{inner}</p>{self.links(0, 5)}", "footer", BOTTOM_NAMES)
        if kind == "side":
            teasers = "".join(f"<p>{self.prose(1)} <a href=/>{self.words(1, 2)}</a></p>" for _ in range(rng.randint(0, 3)))
            return self.box(f"<h{rng.randint(2, 4)}>{self.words(1, 3)}</h4>{teasers}{self.links(2, 6, 9)}", "aside", SIDE_NAMES)
        if kind == "advert":
            return self.box(rng.choice([self.prose(1), f"<p>{self.prose(rng.randint(1, 2))}</p>", f"<a href=/>{self.words(2, 6)}</a>"]), rng.choice(["div", "aside"]), ADVERT_NAMES)
        if kind == "notice":
            return self.box(f"<p>{self.prose(rng.randint(1, 3))} <a href=/>{self.words(1, 2)}</a></p>", rng.choice(["div", "dialog"]), NOTICE_NAMES)
        if kind == "form":
            return f"<form{self.name(NOTICE_NAMES)}><p>{self.prose(1)}</p><label>{self.words(1, 2)}</label><input><button>{self.words(1, 1)}</button></form>"
        if kind == "share":
            return self.box("".join(f"<a href=/>{self.words(1, 2)}</a> " for _ in range(rng.randint(2, 5))), "div", SHARE_NAMES)
        said = "".join(f"<li{self.name(['comment'])}><b>{self.words(1, 2)}</b><p>{self.prose(rng.randint(1, 4))}</p></li>" for _ in range(rng.randint(1, 5)))
        kept, self.names = self.names, True  # readers' words look like an article's: only a name tells them apart
        out = self.box(f"<h3>{self.words(1, 3)}</h3><ol>{said}</ol>", "div", COMMENT_NAMES)
        self.names = kept
        return out

    def paragraph(self) -> str:
        rng = self.rng
        kind = rng.random()
        if kind < 0.62:
            text = self.prose(rng.choice([1, 1, 2, 3, 4, 6]), True)
            if rng.random() < 0.15:
                text += f" <a href=/>{self.words(1, 3)}</a> {self.prose(1)}"
            return f"<p{self.name(NEUTRAL_NAMES) if rng.random() < 0.1 else ''}>{text}</p>"
        if kind < 0.72:
            return f"<p>{self.words(1, 4, True)}{rng.choice(['', '.', ':'])}</p>"
        if kind < 0.82:
            return f"<h{rng.randint(2, 4)}>{self.words(1, 6, True)}</h2>"
        if kind < 0.9:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>{''.join(f'<li>{self.words(1, 12, True)}</li>' for _ in range(rng.randint(2, 5)))}</{tag}>"
        if kind < 0.94:
            return f"<blockquote><p>{self.prose(rng.randint(1, 3), True)}</p></blockquote>"
        if kind < 0.955:
            return f"<div>{self.prose(rng.randint(1, 3), True)}</div>"
        if kind < 0.975:
            return f"<figure><figcaption>{self.words(3, 12, True)}</figcaption></figure>"
        return f"<table>{''.join(f'<tr><td>{self.words(1, 3, True)}</td><td>{self.words(1, 3, True)}</td></tr>' for _ in range(rng.randint(2, 4)))}</table>"

    def article(self) -> str:
        rng = self.rng
        parts = [self.paragraph() for _ in range(rng.randint(1, 12))]
        parts.insert(rng.randrange(len(parts) + 1), f"<p>{self.prose(rng.randint(2, 6), True)}</p>")
        if rng.random() < 0.5:  # a section on a subject that furniture is named after
            tag = rng.choice(["section", "div"])
            topic = f'<h2 id="{rng.choice(TOPIC_NAMES)}">{self.words(1, 3, True)}</h2>' if rng.random() < 0.5 else f"<h2>{self.words(1, 3, True)}</h2>"
            parts.append(f'<{tag} id="{rng.choice(TOPIC_NAMES)}">{topic}<p>{self.prose(rng.randint(2, 5), True)}</p></{tag}>')
        for kind, chance in (("share", 0.2), ("advert", 0.2), ("side", 0.12), ("comments", 0.08)):
            if rng.random() < chance:
                parts.insert(rng.randrange(1, len(parts) + 1), self.furniture(kind))
        if rng.random() < 0.4:  # parts of an article in boxes of their own
            at = rng.randrange(len(parts))
            tag, names = rng.choice(["section", "div", "div"]), self.name(NEUTRAL_NAMES) if rng.random() < 0.4 else ""
            parts[at:] = [f"<{tag}{names}>{''.join(parts[at:])}</{tag}>"]
        if rng.random() < 0.3:
            parts = [f"<div{self.name(CONTENT_NAMES + NEUTRAL_NAMES)}>{''.join(parts)}</div>"]
        head = f"<h1>{self.words(2, 12, True)}</h1>"
        if rng.random() < 0.3:  # who wrote it and when, often bare text
            byline = self.words(1, 6, True)
            head += rng.choice([f"<p>{byline}</p>", f"{byline}<br>", f"<div{self.name(['byline', 'meta', 'date', 'author'])}>{byline}</div>", f"<time>{byline}</time>"])
        if rng.random() < 0.2:
            head = f"<header>{head}<p>{self.words(2, 5, True)}</p></header>"
        inner = head + "".join(parts) if rng.random() < 0.9 else "".join(parts)
        if rng.random() < 0.55:
            inner = f"<article{self.name(CONTENT_NAMES) if rng.random() < 0.3 else ''}>{inner}</article>"
            return f"<main>{inner}</main>" if rng.random() < 0.3 else inner
        if rng.random() < 0.25:
            return f"<main>{inner}</main>"
        return f"<div{self.name(CONTENT_NAMES)}>{inner}</div>"

    def page(self) -> str:
        rng = self.rng
        before = [self.furniture(k) for k in ("notice", "top", "menu", "menu", "advert", "form", "side") if rng.random() < 0.4]
        after = [self.furniture(k) for k in ("share", "side", "side", "comments", "advert", "form", "notice") if rng.random() < 0.3]
        rng.shuffle(before)
        rng.shuffle(after)
        middle = self.article()
        if rng.random() < 0.3:  # the wrapper of nearly everything bears the name of a layout
            middle = f'<div class="{rng.choice(SIDE_NAMES + ["header", "nav", "footer", "ads"])}-{rng.choice(["left", "right", "layout", "page"])}">{middle}</div>'
        whole = "".join(before) + middle + "".join(after) + (self.furniture("bottom") if rng.random() < 0.85 else "")
        for _ in range(rng.randrange(3)):
            whole = f"<div{self.name(NEUTRAL_NAMES)}>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{whole}</body></html>"


def training_pages(n: int, seed: int) -> list[str]:
    """``n`` pages; the text of every content block has :data:`MARK` in front, no other text has it."""
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]
