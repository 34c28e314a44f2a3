"""Arbitrary markup to text: one pass over its tokens, in time that grows with the text, whatever is left open."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd

from lectern.functions.vector import vectorised

#: Elements whose content is noise, and elements that break lines. Fixed values.
NOISE = frozenset(("script", "style", "head", "title", "noscript"))
BLOCKS = frozenset("p br div li tr table blockquote ul ol hr section article header footer figure figcaption h1 h2 h3 h4 h5 h6".split())
#: Elements whose content holds no tags; of the last two it holds character references. Fixed values.
RAW = frozenset(("iframe", "noembed", "noframes", "plaintext", "script", "style", "xmp", "textarea", "title"))
_DECODED = ("textarea", "title")
#: White space of Unicode, which the expressions of lectern.functions.text have as (?U)\s.
BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
_BLANKS = re.compile(f"[{BLANK}]+")
_INVISIBLE = re.compile("[​-‏⁠﻿­᠎]")

# What may stand after "<". No pattern can match in two ways, so none is tried twice over the same text.
_OPEN = re.compile(r"<(?=[A-Za-z!?/])")
_NAME = re.compile(r"[^\t\n\x0c\r />]+")
_TIDY = re.compile(r"""(?:[\t\n\x0c\r /]++[^\t\n\x0c\r /=>"']++(?:=(?:"[^"]*+"|'[^']*+'|[^\t\n\x0c\r "'=<>`]++))?+)*+[\t\n\x0c\r /]*+>""")
_GAP = re.compile(r"[\t\n\x0c\r /]*")
_KEY = re.compile(r"=?[^\t\n\x0c\r /=>]*[\t\n\x0c\r ]*(=[\t\n\x0c\r ]*)?")
_BARE = re.compile(r"[^\t\n\x0c\r >]*")
_COMMENT_END = re.compile("--!?>")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z0-9]+;?))")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\x0c\r />])", re.IGNORECASE)
_CLOSING = {name: re.compile(rf"</{name}(?=[\t\n\x0c\r />])", re.IGNORECASE) for name in RAW - {"script", "plaintext"}}


def _character(m: re.Match) -> str:
    """What a character reference stands for; itself if that is nothing. A name may go on without a semicolon after its end."""
    if m[3]:
        if m[3] in html5:
            return html5[m[3]]
        n = next((n for n in range(min(6, len(m[3]) - 1), 1, -1) if m[3][:n] in html5), 0)
        return html5[m[3][:n]] + m[3][n:] if n else m[0]
    digits = (m[1] or m[2]).lstrip("0")
    code = int(digits or "0", 16 if m[1] else 10) if len(digits) < 9 else 0
    if 0x80 <= code <= 0x9F:  # as in Windows' character set
        return bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"


def decoded(x: str) -> str:
    """A text with its character references resolved, once."""
    return _REFERENCE.sub(_character, x) if "&" in x else x


def _tag_end(x: str, at: int) -> int:
    """Where a tag ends whose name ends at ``at``; -1 if it is never closed. A > in a quoted value does not close it."""
    if m := _TIDY.match(x, at):
        return m.end()
    while True:
        at = _GAP.match(x, at).end()
        if at >= len(x):
            return -1
        if x[at] == ">":
            return at + 1
        m = _KEY.match(x, at)
        at = m.end()
        if m[1] and at < len(x):
            if x[at] in "\"'":
                at = x.find(x[at], at + 1) + 1
                if not at:
                    return -1
            else:
                at = _BARE.match(x, at).end()


def _script_end(x: str, at: int) -> int:
    """Where a script's end tag begins: not inside a script in a comment in it."""
    depth = 0  # 1 in a comment, 2 in a script in it
    while m := _SCRIPT.search(x, at):
        at = m.end()
        if m[0] == "<!--":
            depth, at = depth or 1, m.start() + 2  # its dashes may be those that close it
        elif m[0] == "-->":
            depth = 0
        elif m[1]:
            if depth < 2:
                return m.start()
            depth = 1
        elif depth == 1:
            depth = 2
    return len(x)


def tokens(x: str) -> Iterator[tuple[str, str]]:
    """('text', decoded text), ('open', name), ('close', name) and ('alone', name) in order; comments and declarations part texts
    and are left out. What is not closed, a comment or a tag, takes the rest and is left out too."""
    at = text = 0  # where the search goes on, where the text begins that is not yet told
    while m := _OPEN.search(x, at):
        start, sign = m.start(), x[m.end()]
        if sign == "/":
            sign = x[start + 2 : start + 3]
            if sign and not (sign.isascii() and sign.isalpha()):
                end = x.find(">", start + 2) + 1 or len(x)
                name = None
            elif not sign:
                break
            else:
                name = _NAME.match(x, start + 2)
                end, kind = _tag_end(x, name.end()), "close"
        elif sign in "!?":
            name = None
            if x.startswith("<!--", start):
                short = 5 if x.startswith(">", start + 4) else 6 if x.startswith("->", start + 4) else 0
                done = None if short else _COMMENT_END.search(x, start + 4)
                end = start + short if short else done.end() if done else len(x)
            else:
                end = x.find(">", start + 2) + 1 or len(x)
        else:
            name = _NAME.match(x, start + 1)
            end, kind = _tag_end(x, name.end()), "open"
        if start > text:
            yield "text", decoded(x[text:start])
        if end < 0:
            return
        at = text = end
        if name is None:
            continue
        low = name[0].lower()
        yield "alone" if kind == "open" and x[end - 2] == "/" else kind, low
        if kind == "open" and low in RAW:
            if low == "plaintext":
                stop = len(x)
            elif low == "script":
                stop = _script_end(x, end)
            else:
                stop = closing.start() if (closing := _CLOSING[low].search(x, end)) else len(x)
            if stop > end:
                yield "text", decoded(x[end:stop]) if low in _DECODED else x[end:stop]
            at = text = stop
    if text < len(x):
        yield "text", decoded(x[text:])


def _read(markup: str, flat: bool) -> Iterator[str]:
    """Texts outside noise elements, with a space after each (flat) or a line break for each tag of a block."""
    noise = 0
    for kind, told in tokens(markup):
        if kind == "text":
            if not noise:
                yield told
                if flat:
                    yield " "
        elif told in NOISE and kind != "alone":
            noise = noise + 1 if kind == "open" else max(0, noise - 1)
        elif not flat and not noise and told in BLOCKS:
            yield "\n"


def collapsed(x: str) -> str:
    """Runs of white space as one space; none at the ends."""
    return _BLANKS.sub(" ", x).strip(" ")


def flat_text(markup: str, most: int = 0) -> str:
    """All text on one line, a space wherever a tag or comment stood; the first ``most`` characters if positive."""
    out = collapsed("".join(_read(markup or "", True)))
    return out[:most] if most > 0 else out


def block_text(markup: str) -> str:
    """Text with a line per block; inline tags leave no space."""
    read = "".join(_read(markup or "", False)).replace("\r\n", "\n").replace("\r", "\n")
    lines = [collapsed(line) for line in _INVISIBLE.sub("", read).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


@vectorised("string")
def flat_text_udf(x: pd.Series) -> pd.Series:
    return x.map(flat_text, na_action="ignore")


@vectorised("string")
def block_text_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda m: block_text(m or ""))
