"""Header cleaning: turn arbitrary column names into unique snake_case names.

Pure metadata (no data is read): ``clean_names(df)`` is a single ``toDF`` rename.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame

# FIXED VALUES: symbols spelled out as words before punctuation is dropped.
SYMBOL_WORDS: dict[str, str] = {"%": "percent", "#": "number"}

_CAMEL_1 = re.compile(r"([a-z0-9])([A-Z])")
_CAMEL_2 = re.compile(r"([A-Z]+)([A-Z][a-z])")
_NON_ALNUM = re.compile(r"[^A-Za-z0-9]+")


def clean_name(name: str) -> str:
    """One header to snake_case (without de-duplication)."""
    s = name.replace("'", "").replace('"', "")
    for sym, word in SYMBOL_WORDS.items():
        s = s.replace(sym, f"_{word}_")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    s = _CAMEL_2.sub(r"\1_\2", s)
    s = _CAMEL_1.sub(r"\1_\2", s)
    s = _NON_ALNUM.sub("_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names_list(names: Iterable[str]) -> list[str]:
    """Clean every name and make duplicates unique with ``_2``, ``_3`` ... suffixes."""
    out: list[str] = []
    seen: dict[str, int] = {}
    taken: set[str] = set()
    for raw in names:
        base = clean_name(raw)
        if base not in taken:
            seen[base] = 1
            taken.add(base)
            out.append(base)
            continue
        k = seen.get(base, 1)
        while True:
            k += 1
            cand = f"{base}_{k}"
            if cand not in taken:
                break
        seen[base] = k
        taken.add(cand)
        out.append(cand)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns of ``df`` to cleaned, unique names (metadata only)."""
    return df.toDF(*clean_names_list(df.columns))
