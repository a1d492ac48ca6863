"""Plain text of RTF: a parser of groups, control words and escaped bytes, with a stack of what holds in each group.

Bytes (\\'hh) are read in the code page of the font in use, else of the document; a Unicode character (\\uN) takes the place of
the \\ucN characters after it; a surrogate pair is one character. Destinations without text of the document are left out
with all that is in them, whatever is nested there.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Words of the format that stand for text, destinations that hold none, and code pages of character sets.
SIGNS = {
    "par": "\n", "line": "\n", "row": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": "|", "nestcell": "|", "nestrow": "\n",
    "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•",
    "emspace": "\u2003", "enspace": "\u2002", "qmspace": "\u2005", "zwj": "\u200d", "zwnj": "\u200c",
}
SILENT = frozenset(
    "fonttbl colortbl stylesheet info pict object themedata colorschememapping datastore latentstyles listtable listoverridetable rsidtbl revtbl xmlnstbl"
    " header headerl headerr headerf footer footerl footerr footerf footnote annotation atnid atnauthor bkmkstart bkmkend fldinst filetbl template generator".split()
)
PAGES = {"ansi": "cp1252", "mac": "mac_roman", "pc": "cp437", "pca": "cp850"}
CHARSETS = {
    0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "gb2312", 136: "big5", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256",
    186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250", 255: "cp437",
}

_TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)|\\$", re.S)


class _Group(NamedTuple):
    skip: int = 1  # characters after \uN that stand for it
    page: str | None = None  # of the font, if one is chosen
    silent: bool = False
    fonts: bool = False  # the table of fonts


def _known(page: str) -> str:
    try:
        "".encode(page)
    except LookupError:
        return "cp1252"
    return page


def rtf_text(raw: bytes) -> str:
    """The document's text; what isn't RTF is read as if it were. Lines end at \\n."""
    out: list[str] = []
    pending = bytearray()  # escaped bytes, which may be halves of a character
    high = 0  # first half of a surrogate pair
    document, fonts, font = "cp1252", {}, 0
    group, stack, left, fresh = _Group(), [], 0, False
    at = 0

    def settle() -> None:
        if pending:
            out.append(pending.decode(group.page or document, "replace"))
            pending.clear()

    while at < len(raw):
        m = _TOKEN.match(raw, at)
        if m is None:  # a lone backslash
            at += 1
            continue
        at = m.end()
        word, number, byte, sign, brace, plain = m.groups()
        if byte is not None:
            if left:
                left -= 1
            elif not group.silent:
                pending.append(int(byte, 16))
            fresh = False
            continue
        if plain is None and brace is None and word is None and sign is None:
            continue  # a line end of the file
        settle()
        if brace == b"{":
            stack.append(group)
            fresh, left = True, 0
            continue
        if brace == b"}":
            group = stack.pop() if stack else _Group()
            left = 0
        elif word is not None:
            name, n = word.decode(), int(number) if number else None
            if name == "bin" and n:
                at += n
            elif name == "u" and n is not None:
                left = group.skip
                code = n % 65536
                if not group.silent:
                    if 0xD800 <= code < 0xDC00:
                        high = code
                    elif 0xDC00 <= code < 0xE000:
                        out.append(chr(0x10000 + (high - 0xD800 << 10) + code - 0xDC00) if high else "\ufffd")
                        high = 0
                    else:
                        out.append(chr(code))
            elif name == "uc" and n is not None:
                group = group._replace(skip=max(n, 0))
            elif name in PAGES:
                document = PAGES[name]
            elif name == "ansicpg" and n:
                document = _known("utf-8" if n == 65001 else f"cp{n}")
            elif name == "f" and n is not None:
                font = n
                if not group.fonts:
                    group = group._replace(page=fonts.get(n))
            elif name == "fcharset" and group.fonts and n in CHARSETS:
                fonts[font] = CHARSETS[n]
            elif name == "plain" or name == "pard":
                pass
            elif name in SILENT and fresh:
                group = group._replace(silent=True, fonts=name == "fonttbl")
            elif name in SIGNS and not group.silent:
                out.append(SIGNS[name])
        elif sign is not None:
            if sign == b"*" and fresh:
                group = group._replace(silent=True)
                continue  # the destination's name follows
            if not group.silent:
                if left and sign in b"{}\\~-_":
                    left -= 1
                else:
                    out.append({b"~": "\xa0", b"-": "", b"_": "\u2011", b"\r": "\n", b"\n": "\n", b"{": "{", b"}": "}", b"\\": "\\"}.get(sign, ""))
        elif not group.silent:
            text = plain.decode(group.page or document, "replace")
            out.append(text[left:])
            left = max(left - len(text), 0)
        fresh = False
    settle()
    return "".join(out)
