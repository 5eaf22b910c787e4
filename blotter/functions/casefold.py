"""Per-character case folding as a Spark ``translate`` table.

Case-insensitive matching here means: fold every character of the text and of the pattern with
Unicode *simple* case folding (one character to one character), then compare exactly. This is
the rule RE2 and ICU apply to single characters, so e.g. K / k / KELVIN SIGN all match, while
characters whose folding needs several characters (such as 'ß' -> 'ss') fold to themselves.

The table is generated from Python's Unicode database, not written out: every BMP character
whose one-character folding differs from itself.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_char(c: str) -> str:
    """Simple case folding of one character (itself when the folding is not one character)."""
    f = c.casefold()
    if len(f) == 1:
        return f
    low = c.lower()
    return low if len(low) == 1 else c


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: BMP characters whose folding differs."""
    src, dst = [], []
    for cp in range(0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        f = fold_char(c)
        if f != c:
            src.append(c)
            dst.append(f)
    return "".join(src), "".join(dst)


def fold_text(s: str) -> str:
    """Fold a Python string the same way as :func:`fold_col` folds a column."""
    return "".join(fold_char(c) if ord(c) < 0x10000 else c for c in s)


def fold_col(col: Column | str) -> Column:
    """Fold a string column character by character (JVM-side, no UDF).

    Pure-ASCII values (character count equals byte count) take the byte-wise ``lower`` path,
    which is the same folding for ASCII; only values with other characters pay for the
    per-character ``translate``.
    """
    c = F.col(col) if isinstance(col, str) else col
    src, dst = fold_table()
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, src, dst))

