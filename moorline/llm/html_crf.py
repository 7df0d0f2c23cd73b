"""A linear-chain conditional random field over a page's blocks: features, labelled pages, training, Viterbi.

The labelled pages are invented: templates with the article's blocks marked, in many layouts, with words of no
language, so that the field learns from tags, names and shapes. Training takes a few seconds on the driver.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

#: Words in class and id names that speak for a part of a page; of nested parts the innermost counts most.
PARTS = {
    "content": r"content|article|post|entry|story|body|prose|text|main|page",
    "menu": r"nav\w*|menu\w*|breadcrumb\w*|crumbs|tabs|pager|pagination|toc|links",
    "side": r"side\w*|aside|rail|widget|related|recommend\w*|popular|trending|more|tags|teaser|author|bio",
    "advert": r"ads?|advert\w*|sponsor\w*|promo\w*|banner|adsense|affiliate",
    "foot": r"foot\w*|copyright|legal|colophon|imprint",
    "head": r"head|header|masthead|logo|topbar|brand|hero|site",
    "notice": r"cookie\w*|notice|alert|consent|gdpr|popup|modal|overlay|newsletter|subscribe|paywall|signup|toast|warning",
    "comment": r"comment\w*|repl(?:y|ies)|discuss\w*|disqus|respon\w*|thread|reader\w*",
    "share": r"share|sharing|social|follow",
    "form": r"form|search|login|contact|input|field|poll",
}
_PART = {k: re.compile(rf"(?:^|[^a-z])(?:{v})(?:$|[^a-z])") for k, v in PARTS.items()}
_TAG_PARTS = {"article": "content", "main": "content", "nav": "menu", "menu": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "form", "dialog": "notice", "button": "form", "label": "form", "fieldset": "form", "select": "form"}
TAGS = ("p", "h1", "h2", "h3", "h4", "li", "td", "div", "section", "blockquote", "pre", "figcaption", "body", "ul", "table", "article", "main", "nav", "footer", "header", "aside", "form", "head", "dd")
NAMES = [
    "bias",
    *(f"own_{t}" for t in TAGS),
    *(f"above_{t}" for t in TAGS),
    *(f"inner_{p}" for p in PARTS),
    *(f"any_{p}" for p in PARTS),
    "words_0_3", "words_4_9", "words_10_24", "words_25_up", "sentence", "commas", "linked_some", "linked_most", "sign", "first", "early", "late",
    "words_50_up", "no_part", "outside", "unframed", "unframed_prose", "unframed_heading", "unframed_links",
]
_AT = {n: i for i, n in enumerate(NAMES)}


@lru_cache(maxsize=4096)
def part_of(tag: str, names: str) -> str | None:
    """The part of a page that an element's class and id names, or else its tag, speak for."""
    low = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower()
    for kind in ("comment", "notice", "advert", "share", "menu", "foot", "form", "side", "head", "content"):
        if low and _PART[kind].search(low):
            return kind
    return _TAG_PARTS.get(tag)


def parts_of(path: tuple[tuple[str, str], ...]) -> list[str]:
    """The parts of a page that a block's elements speak for, from the page down."""
    return [p for p in (part_of(t, n) for t, n in path) if p]


def active(path: tuple[tuple[str, str], ...], parts: list[str], text: str, linked: int, place: float, framed: bool) -> list[int]:
    """The features of a block that are on. path: (tag, names) from the page down to the block's own element; framed:
    whether any block of the page is in an element that speaks for content."""
    on = {0}
    tags = [t for t, _ in path]
    if tags and tags[-1] in TAGS:
        on.add(_AT[f"own_{tags[-1]}"])
    on.update(_AT[f"above_{t}"] for t in tags[:-1] if t in TAGS)
    if parts:
        on.add(_AT[f"inner_{parts[-1]}"])
        on.update(_AT[f"any_{p}"] for p in parts)
    n = text.count(" ") + 1
    on.add(_AT["words_0_3" if n < 4 else "words_4_9" if n < 10 else "words_10_24" if n < 25 else "words_25_up"])
    if n >= 50:
        on.add(_AT["words_50_up"])
    sentence = text[-1] in ".!?\"'…。»”"
    if sentence:
        on.add(_AT["sentence"])
    if text.count(",") >= 2:
        on.add(_AT["commas"])
    if linked:
        on.add(_AT["linked_most" if linked * 2 > len(text) else "linked_some"])
    if "©" in text or "&copy" in text:
        on.add(_AT["sign"])
    if place < 0.3 or place > 0.7:
        on.add(_AT["first" if place == 0 else "early" if place < 0.3 else "late"])
    if not parts:
        on.add(_AT["no_part"])
    if framed and "content" not in parts:
        on.add(_AT["outside"])
    if not framed:
        # Nothing on the page speaks for content: prose outside of any telling part has to do so itself.
        on.add(_AT["unframed"])
        if not parts and linked * 2 > len(text):
            on.add(_AT["unframed_links"])
        elif not parts and tags and re.fullmatch("h[1-6]", tags[-1]):
            on.add(_AT["unframed_heading"])
        elif not parts and (sentence or n >= 10):
            on.add(_AT["unframed_prose"])
    return sorted(on)


def labelled_pages(n: int, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Invented pages: the html, and the texts of the article's blocks."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int, high: int) -> str:
        own = [word() for _ in range(rng.randint(low, high))]
        text = " ".join(w + ("," if rng.random() < 0.08 else "") for w in own).rstrip(",")
        return text.capitalize() + rng.choice([".", ".", ".", "!", "?"])

    prose = lambda low=1, high=6: " ".join(sentence(3, 18) for _ in range(rng.randint(low, high)))
    title = lambda: " ".join(word() for _ in range(rng.randint(2, 12))).capitalize()
    links = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rng.randint(2, 9))) + "</ul>"
    name = lambda *of: (lambda c: f' {rng.choice(["class", "id"])}="{rng.choice(["", "", word() + " ", word() + "-"])}{c}"')(rng.choice(of))

    def some(low: int, high: int) -> str:
        return "".join(f"<p>{prose(1, 3)}</p>" for _ in range(rng.randint(low, high)))

    def junk(where: str) -> str:
        own = {
            "menu": lambda: rng.choice([links(), f"<div>{links()}</div>", f"<nav>{links()}</nav>", f"<div{name('nav', 'menu', 'main-menu', 'breadcrumb', 'pagination')}>{links()}</div>", f"<nav><a href='/'>{word()}</a> <a href='/x'>{word()}</a></nav>"]),
            "head": lambda: rng.choice([f"<header><h2>{title()}</h2><p>{sentence(3, 9)}</p></header>", f"<div{name('header', 'masthead', 'site-header', 'topbar')}><p>{title()}</p></div>"]),
            "advert": lambda: rng.choice([f"<div{name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{prose(1, 2)}</div>", f"<aside{name('ad', 'promo')}><p>{prose(1, 3)}</p></aside>", f"<p{name('ad', 'advert', 'sponsor')}>{prose(1, 2)}</p>"]),
            "side": lambda: rng.choice([f"<aside><h3>{title()}</h3>{some(1, 3)}</aside>", f"<div{name('sidebar', 'widget', 'related', 'recommended', 'popular')}><h3>{title()}</h3>{rng.choice([links(), some(1, 3)])}</div>"]),
            "notice": lambda: f"<{(t := rng.choice(['div', 'section', 'p', 'dialog']))}{name('cookie-notice', 'notice', 'consent', 'alert', 'newsletter', 'subscribe', 'popup', 'modal')}>{prose(1, 3)}{rng.choice(['', '<button>Ok</button>'])}</{t}>",
            "share": lambda: f"<div{name('share', 'social', 'sharing')}><a href='/f'>{word()}</a> <a href='/t'>{word()}</a></div>",
            "form": lambda: f"<form{rng.choice(['', name('search', 'login', 'contact-form')])}><label>{title()}</label><input><button>{word()}</button>{rng.choice(['', f'<p>{prose(1, 2)}</p>'])}</form>",
            "comment": lambda: rng.choice([f"<section{name('comments', 'comment-list', 'discussion', 'responses')}><h3>{title()}</h3>" + "".join(f"<div{name('comment', 'reply')}><p>{prose(1, 4)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>", f"<div{name('comments', 'disqus', 'reader-comments')}><ul>" + "".join(f"<li>{rng.choice([word(), '<b>' + word() + '</b>'])} {prose(1, 4)}</li>" for _ in range(rng.randint(1, 4))) + "</ul></div>"]),
            "foot": lambda: rng.choice([f"<p>&copy; {title()}</p>", f"<footer>&copy; {word()}.example &middot; {prose(1, 2)}</footer>", f"<footer>{some(1, 2)}{links()}</footer>", f"<div{name('footer', 'copyright', 'legal')}><p>&copy; {title()}</p>{prose(1, 2)}</div>"]),
        }
        return own[where]()

    pages = []
    for _ in range(n):
        kept: list[str] = []

        def say(text: str) -> str:
            kept.append(text)
            return text

        inside = [f"<h1>{say(title())}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.66:
                inside.append(f"<p>{say(prose())}" + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.72:
                inside.append(f"<h2>{say(title())}</h2>")
            elif kind < 0.78:
                inside.append("<ul>" + "".join(f"<li>{say(sentence(2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.83:
                inside.append(f"<blockquote>{say(prose(1, 2))}</blockquote>")
            elif kind < 0.86:
                inside.append(f"<p><b>{say(title())}</b></p>")
            elif kind < 0.89:
                inside.append("<table><tr>" + "".join(f"<td>{say(title())}</td>" for _ in range(rng.randint(2, 4))) + "</tr></table>")
            elif kind < 0.92:
                inside.append(f"<pre>{say(prose(1, 1))}</pre>")
            else:
                inside.append(junk(rng.choice(["advert", "side", "share", "notice", "form"])))
        body = "".join(inside)
        shape = rng.random()
        plain = lambda: rng.choice(["", "", f' class="{word()}"', f' id="{word()}-{word()}"'])
        if shape < 0.22:
            body = f"<article>{body}</article>"
        elif shape < 0.32:
            body = f"<main>{body}</main>"
        elif shape < 0.4:
            body = f"<main><article{name('post', 'entry')}>{body}</article></main>"
        elif shape < 0.62:
            body = f"<div{name('content', 'article', 'post', 'entry-content', 'story', 'main', 'article-body')}>{body}</div>"
        elif shape < 0.78:
            for _ in range(rng.randint(1, 3)):
                body = f"<div{plain()}>{body}</div>"
        elif shape < 0.83:
            body = f"<section{plain()}>{body}</section>"
        elif shape < 0.87:
            body = f"<table{plain()}><tr><td{plain()}>{body}</td></tr></table>"
        bare = rng.choice([0.0, 0.25, 1.0]) if shape >= 0.62 else 1
        before = [junk(k) for k in ("menu", "head", "advert", "notice", "form", "side") if rng.random() < bare * (0.8 if k == "menu" else 0.35)]
        after = [junk(k) for k in ("share", "advert", "side", "comment", "notice", "form") if rng.random() < bare * (0.55 if k == "comment" else 0.35)]
        rng.shuffle(before)
        rng.shuffle(after)
        foot = junk("foot") if rng.random() < (0.85 if bare else 0.3) else ""
        pages.append((f"<html><head><title>{title()}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{body}{''.join(after)}{foot}</body></html>", kept))
    return pages


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = 200, rate: float = 0.2, ridge: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and transitions (label, label) of the greatest regularised likelihood, by Adam."""
    pages = [p for p in pages if p[0]]
    longest = max(len(f) for f, _ in pages)
    x = np.zeros((sum(len(f) for f, _ in pages), len(NAMES)), dtype=np.float32)
    y = np.zeros((len(pages), longest), dtype=np.int64)
    there = np.zeros((len(pages), longest), dtype=bool)
    for k, on in enumerate(on for f, _ in pages for on in f):
        x[k, on] = 1
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
        there[i, : len(labels)] = True
    weights, moves = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    parameters = [weights, moves]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    gold = np.eye(2)[y] * there[..., None]
    pairs = (there[:, 1:, None, None] * np.eye(2)[y[:, :-1]][..., :, None] * np.eye(2)[y[:, 1:]][..., None, :]).sum(axis=(0, 1))
    n = there.sum()
    for step in range(1, steps + 1):
        scores = np.zeros((len(pages), longest, 2))
        scores[there] = x @ weights.astype(np.float32)
        up, down = np.zeros_like(scores), np.zeros_like(scores)
        up[:, 0] = scores[:, 0]
        for t in range(1, longest):
            forward = scores[:, t] + np.logaddexp.reduce(up[:, t - 1, :, None] + moves, axis=1)
            up[:, t] = np.where(there[:, t, None], forward, up[:, t - 1])
        for t in range(longest - 2, -1, -1):
            backward = np.logaddexp.reduce(moves + (scores[:, t + 1] + down[:, t + 1])[:, None, :], axis=2)
            down[:, t] = np.where(there[:, t + 1, None], backward, 0)
        total = np.logaddexp.reduce(up[:, -1], axis=1)
        single = np.exp(up + down - total[:, None, None]) * there[..., None]
        joint = np.exp(up[:, :-1, :, None] + moves + (scores[:, 1:] + down[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        grads = [x.T @ (gold - single)[there].astype(np.float32) / n - ridge * weights, (pairs - joint.sum(axis=(0, 1))) / n - ridge * moves]
        for p, g, m, v in zip(parameters, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights, moves


def decode(features: list[list[int]], weights: np.ndarray, moves: np.ndarray) -> list[int]:
    """The likeliest labels of a page's blocks (Viterbi); ties go to label 1, the article."""
    if not features:
        return []
    (a, b), (c, d) = moves.tolist()
    own = [(weights[on, 0].sum(), weights[on, 1].sum()) for on in features]
    low, high = own[0]
    back = []
    for s, t in own[1:]:
        back.append((0 if low + a > high + c else 1, 0 if low + b > high + d else 1))
        low, high = s + max(low + a, high + c), t + max(low + b, high + d)
    label = 0 if low > high else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]
