"""One plain form of a text: no case, punctuation, invisible characters, markup, line marks or layout."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character references, tags that stand inside words, marks that open a line.
ENTITIES = {"&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&#160;": " ", "&amp;": "&"}
_INNER = "a|b|i|u|s|em|strong|span|code|mark|small|sub|sup|font|tt"
_ATTRIBUTES = r"(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"<>\n]*\"|'[^'<>\n]*'|[^\s\"'<>]+))*\s*/?>"
INLINE_TAG = re.compile(rf"</?(?:{_INNER}){_ATTRIBUTES}", re.I)
OTHER_TAG = re.compile(rf"</?[A-Za-z][\w:-]*{_ATTRIBUTES}")
LINE_MARK = re.compile(r"^[ \t]*(?:(?:[rR]\d+>|[QA]:|//+|/\*+|\*+/?|>+|#+|--|[-+|]|\d+[:.)|]|L\d+:)[ \t]+)+", re.M)


class _Keep(dict):
    """Code point to what stands for it: letters, digits and blanks stay, invisible characters and the rest go."""

    def __missing__(self, c: int):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "Z" or ch in "\t\n\r\v\f":
            out = " "
        else:
            out = ch if kind[0] in "LN" else None
        self[c] = out
        return out


_KEEP = _Keep()
_FORMAT = "".join(chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cf")
_INVISIBLE = re.compile(f"[{re.escape(_FORMAT)}\ufe00-\ufe0f\u0000-\u0008\u000e-\u001f]")


def plain_text(t: str) -> str:
    """Words of letters and digits with single blanks between them; tags are tags at any length."""
    if "&" in t:
        for name, char in ENTITIES.items():
            t = t.replace(name, char)
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    if "<" in t:
        t = OTHER_TAG.sub(" ", INLINE_TAG.sub("", t))
    t = LINE_MARK.sub(" ", t)
    if "\\" in t:
        t = re.sub(r"\\[nrt]", " ", t)
    return " ".join(t.lower().translate(_KEEP).split())


@F.pandas_udf(T.StringType())
def plain(text: pd.Series) -> pd.Series:
    """plain_text() of a column; null stays null."""
    return text.map(plain_text, na_action="ignore")
