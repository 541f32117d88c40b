"""Texts in a plain form, with the place of each character in the original."""

from __future__ import annotations

import unicodedata

import regex

#: Runs of characters that stay as they are, or one character with its marks.
_PART = regex.compile(r"([ -~\t\n가-힣]+)(?![\p{M}\u1160-\u11FF\u200D])|\X")
_HIDDEN = regex.compile(r"[\p{Cf}--[\n]]", regex.V1)


def folded(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The text in NFKC without invisible characters, and for each of its characters where the original begins and ends.

    The places are None if the text is in that form already.
    """
    if text.isascii() or (unicodedata.is_normalized("NFKC", text) and not _HIDDEN.search(text)):
        return text, None, None
    out: list[str] = []
    begin: list[int] = []
    end: list[int] = []
    for m in _PART.finditer(text):
        if m[1]:
            out.append(m[0])
            begin.extend(range(m.start(), m.end()))
            end.extend(range(m.start() + 1, m.end() + 1))
            continue
        for c in _HIDDEN.sub("", unicodedata.normalize("NFKC", m[0])):
            out.append(c)
            begin.append(m.start())
            end.append(m.end())
    return "".join(out), begin, end
