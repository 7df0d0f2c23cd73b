"""Main text of web pages: a conditional random field labels a page's leaf blocks as article or not.

The whole html is read; elements are closed as browsers do for missing end tags. Scripts, styles, comments and other
text that is never shown make no blocks; what is no markup, as code, is skipped up to its end tag without being parsed,
and what is hidden markup, as a drawing or a list of choices, ends at the latest with the element it stands in.
A null or empty html, and a page without blocks, has an empty text. Repeated rows each get their own text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_crf
from .common import append, tune

#: Labelled pages to train on.
PAGES = 900
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
#: Elements whose content is plain text up to their end tag, never shown, and where that end tag is.
_ENDS = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>]|\Z)", re.I) for name in ("script", "style", "noscript", "iframe", "textarea", "title", "noembed", "xmp")}
#: Elements that hold markup which isn't shown: they end with their end tag or with the element they are in; of these,
#: the elements that an element of running text also ends.
_HIDDEN = {"template", "svg", "select", "video", "audio", "canvas", "annotation", "datalist"}
_BROKEN_OUT = {"svg", "select", "datalist"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img input label button ruby rt rp nobr blink map math mi mo mn ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
#: Elements that a start tag closes, if open in the same box; and the elements that are such boxes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_BOXES = {"ul", "ol", "dl", "table", "html", "body", "article", "main", "div", "section", "aside", "nav", "td", "th"}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def blocks(page: str | None) -> list[tuple[tuple[tuple[str, str], ...], str, int]]:
    """The leaf blocks of a page: path of elements, text, linked characters."""
    out: list[tuple[tuple[tuple[str, str], ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def hidden() -> int | None:
        return next((i for i, (t, _) in enumerate(stack) if t in _HIDDEN), None)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and hidden() is None:
                out.append((tuple(stack), text, linked))
            parts.clear()
        linked = 0

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            text = m.group()
            if not text.startswith(("<!", "<?")):
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        tag = tag.lower()
        closing = bool(m.group(1) or m.group(4))
        if tag in _ENDS:
            if not closing and not m.group().endswith("/>"):
                end = _ENDS[tag].search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag in _HIDDEN:
            flush()
            if closing:
                _pop(stack, tag)
            elif not m.group().endswith("/>"):
                stack.append((tag, ""))
            continue
        if not closing and (out_of := hidden()) is not None:
            if tag in _ENDS_P and stack[out_of][0] in _BROKEN_OUT and all(t != "foreignobject" for t, _ in stack):
                flush()
                del stack[out_of:]
            elif m.group().endswith("/>"):
                continue
        if tag == "a":
            in_link = not closing
        if tag == "br":
            parts.append(" ")
        if tag in _INLINE or tag == "br":
            if tag in ("button", "label"):
                flush()
                if closing:
                    _pop(stack, tag)
                else:
                    stack.append((tag, ""))
            continue
        flush()
        if closing:
            _pop(stack, tag)
            continue
        if tag in _ENDS_P:
            _close(stack, {"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag.startswith("h") and tag[1:].isdigit() else {"p"})
        if tag in _CLOSES:
            _close(stack, _CLOSES[tag])
        if tag == "body":
            stack[:] = [e for e in stack if e[0] == "html"]
        if tag not in _VOID:
            stack.append((tag, " ".join(filter(None, (x or y or z for x, y, z in _NAMES.findall(m.group(3) or m.group(6) or ""))))))
    flush()
    return out


def _pop(stack: list[tuple[str, str]], tag: str) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return


def _close(stack: list[tuple[str, str]], tags: set[str]) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            del stack[i:]
            return
        if stack[i][0] in _BOXES:
            return


def featured(found: list) -> list[list[int]]:
    last = max(1, len(found) - 1)
    parts = [html_crf.parts_of(path) for path, _, _ in found]
    framed = any("content" in p for p in parts)
    return [html_crf.active(path, own, text, linked, i / last, framed) for i, ((path, text, linked), own) in enumerate(zip(found, parts))]


@lru_cache(maxsize=1)
def fitted():
    """The field's weights and transitions, trained on the invented pages."""
    examples = []
    for page, kept in html_crf.labelled_pages(PAGES):
        found = blocks(page)
        left, labels = list(kept), []
        for _, text, _ in found:
            labels.append(int(bool(left) and " ".join(left[0].split()) == text))
            if labels[-1]:
                left.pop(0)
        examples.append((featured(found), labels))
    return html_crf.train(examples)


def main_text(page: str | None, weights, moves) -> str:
    found = blocks(page)
    labels = html_crf.decode(featured(found), weights, moves)
    return " ".join(text for (_, text, _), label in zip(found, labels) if label)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    tune(pages.sparkSession)
    weights, moves = fitted()
    table, made = append(pages.select("page_id", "url", "html"), "html", lambda rows: [main_text(r, weights, moves) for r in rows], "string")
    return table.select("page_id", "url", F.col(made).alias("text"), F.length(made).cast("bigint").alias("n_chars"))
