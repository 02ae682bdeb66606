"""Letters beyond ASCII as ASCII, in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition, and typographic signs.
OWN = {"ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "TH", "þ": "th", "Ł": "L", "ł": "l", "ı": "i", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def _table() -> dict[str, str]:
    """Latin letters with marks as what is left without them, by Unicode's decomposition; combining marks as nothing."""
    out = {chr(i): "" for i in range(0x300, 0x370)}
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if bare and bare.isascii():
            out[chr(i)] = bare
    return out | OWN


_TABLE = _table()
_ONE = {k: v for k, v in _TABLE.items() if len(v) == 1}
_NONE = "".join(k for k, v in _TABLE.items() if not v)
_MORE = {k: v for k, v in _TABLE.items() if len(v) > 1}


def ascii_folded(c: Column) -> Column:
    """The text with Latin letters as their ASCII ones; what has none stays."""
    for k, v in _MORE.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(_ONE) + _NONE, "".join(_ONE.values()))
