"""HTML as a sequence of leaf blocks: each block's path of tags and names, its text, and how much of it is links."""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np

# Elements that break a line, that hold nothing, and that hold no text of the page.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("audio canvas datalist iframe noscript object script select style svg template textarea title video".split())
# A tag that opens closes the nearest of these, unless one of the others is nearer.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HOLDERS = frozenset("article aside blockquote body button div dd details dialog fieldset figure footer form header li main nav section table td th".split())

PATH_BUCKETS, WORD_BUCKETS, STATS = 8192, 64, 8
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*+)>?)")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    low = attributes.lower()
    if "class" not in low and "id" not in low and "role" not in low:
        return (tag,)
    found = [w.lower() for _, *v in _NAMES.findall(attributes) for w in _WORD.findall("".join(v))]
    return (tag, *dict.fromkeys("." + w for w in found))


def blocks(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of characters in links) of each leaf block of a page in order.

    A block is the text between two tags that break a line; other tags join what is around them, and br is white space.
    Character references are decoded, white space becomes one space. A p ends where a block begins, an li, td, ... where
    the next begins; end tags that nothing opened are passed over, and a page may end anywhere.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tags that are open, each with the whole path to it
    text: list[str] = []
    links, linked, at, n = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        whole = " ".join(unescape("".join(text)).split())
        if whole:
            out.append((stack[-1][1] if stack else (), whole, min(1.0, linked / len(whole))))
        text.clear()
        linked = 0

    def close(names, until) -> None:
        nonlocal links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if any(t in BLOCKS for t, _ in stack[i:]):
                    flush()
                links = max(0, links - sum(t == "a" for t, _ in stack[i:]))
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            m_start, m_end = n, n
        else:
            m_start, m_end = m.span()
        if m_start > at:
            piece = html[at:m_start]
            text.append(piece)
            if links:
                linked += len(piece)
        at = m_end
        if m is None:
            break
        if m[1]:
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        closing, tag, attributes = (m[3], m[4].lower(), m[5]) if m[4] else (m[6], m[7].lower(), m[8])
        if closing:
            if tag == "br":
                text.append(" ")
            elif tag not in VOID:
                close({tag}, ())
            continue
        if tag in UNREAD:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(html, at)
                at = n if end is None else (html.find(">", end.end()) + 1 or n)
            continue
        if tag in BLOCKS:
            flush()
            close({"p"}, HOLDERS)
            if tag in ENDS:
                close(*ENDS[tag])
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            continue
        before = stack[-1][1] if stack else ()
        stack.append((tag, (*before, *_named(tag, attributes)) if tag in BLOCKS else (*before, *[x for x in _named(tag, attributes)[1:]])))
        links += tag == "a"
    flush()
    return out


def path_buckets(path: tuple[str, ...]) -> np.ndarray:
    """Hashed distinct tags and names of a path, and its last one for itself."""
    named = {*path, f"{path[-1]}<"} if path else {"<"}
    return np.array(sorted({zlib.crc32(x.encode()) % PATH_BUCKETS for x in named}), np.int64)


def word_buckets(text: str) -> np.ndarray:
    """Hashed bag of a block's lower-cased words, of length 1."""
    hashed = [zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS for w in text.lower().split()]
    bag = np.bincount(hashed, minlength=WORD_BUCKETS).astype(np.float32)
    return bag / max(1e-6, float(np.sqrt((bag * bag).sum())))


def stats(text: str, linked: float) -> list[float]:
    """Length, links, and how a block is written."""
    n = len(text)
    words = text.count(" ") + 1
    return [
        np.log1p(words) / 5, linked, float(text[-1] in ".!?"), sum(text.count(c) for c in "|·©»›") / words, min(1.0, 5 * text.count(",") / words),
        float(text[:1].isupper()), np.log1p(n / words) / 3, float(any(c.isdigit() for c in text[:200])),
    ]
