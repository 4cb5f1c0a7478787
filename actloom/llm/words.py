"""Words of a text as they are compared across texts."""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
LINE_END = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")
LATIN_MARKS = re.compile("[\u0300-\u036f]+")
# Where other combining characters lie; only texts with a character from here are looked through one by one.
OTHER_MARKS = re.compile("[\u0483-\u1dff\u20d0-\u20ff\u2cef-\u302f\u3099\u309a\ua66f-\uabed\ufb1e\ufe20-\ufe2f\U000101fd-\U0001ffff]")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case and accents.

    Entities are decoded and tags dropped first, invisible characters taken
    out, and words hyphenated over a line end made one. None for NULL.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "\n" in text:
        text = LINE_END.sub("", text)
    if not text.isascii():
        text = LATIN_MARKS.sub("", unicodedata.normalize("NFKD", text))
        if OTHER_MARKS.search(text):
            text = "".join(c for c in text if not unicodedata.combining(c))
    return WORD.findall(text.casefold())
