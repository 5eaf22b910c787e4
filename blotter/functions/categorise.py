"""Ordered, first-match rule categorisation of free text.

Matching: a rule pattern is searched anywhere in the text (no anchors, no word boundaries),
ignoring case by Unicode simple case folding (see :mod:`.casefold`). The text is folded once
per row, JVM-side. Alternatives that are plain literals (all but one of
the built-in ones) are found by a chain of ``contains`` searches; alternatives with regex syntax use
``rlike`` on the folded text; patterns with groups, classes or escapes are run whole as one
case-insensitive regex on the original text. Literals that can never decide are not searched (see
``decisive``).

Everything is one JVM expression evaluated per row: no shuffle, no Python, no choice by input size; it
works on streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .casefold import fold_col, fold_text
from .rules import CRIME_RULES, DEFAULT_CATEGORY

Rules = Sequence[tuple[str, str]]

# Case-insensitive with Unicode case folding: the behaviour of ICU / RE2 "ignore case".
CASE_FLAGS = "(?iu)"

_NOT_SPLITTABLE = set("()[]{}\\")
_REGEX_SYNTAX = set(".^$*+?{}[]()|\\")


def split_alternatives(pattern: str) -> list[str] | None:
    """Top-level alternatives of a pattern without groups/classes/escapes, else None."""
    if any(ch in _NOT_SPLITTABLE for ch in pattern):
        return None
    return pattern.split("|")


def detects(text: Column | str, pattern: str, ignore_case: bool = True, folded: Column | None = None) -> Column:
    """Unanchored search of ``pattern`` in ``text`` (NULL in, NULL out).

    ``folded`` is the case-folded text when the caller already has it (saves a translate).
    """
    c = F.col(text) if isinstance(text, str) else text
    if not ignore_case:
        return c.rlike(pattern)
    alts = split_alternatives(pattern)
    if alts is None:
        return c.rlike(CASE_FLAGS + pattern)
    f = fold_col(c) if folded is None else folded
    conds = [
        f.contains(fold_text(a)) if not any(ch in _REGEX_SYNTAX for ch in a) else f.rlike(fold_text(a))
        for a in alts
    ]
    return reduce(lambda x, y: x | y, conds)


def rule_expr(text: Column | str, rules: Rules = CRIME_RULES, default: str = DEFAULT_CATEGORY,
              ignore_case: bool = True, folded: Column | None = None) -> Column:
    """CASE WHEN text ~ rule1 THEN name1 ... ELSE default END (never NULL), pure JVM."""
    c = F.col(text) if isinstance(text, str) else text
    if ignore_case and folded is None:
        folded = fold_col(c)
    expr = None
    for name, pattern in rules:
        cond = detects(c, pattern, ignore_case, folded)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def needless(alternative: str, literals: Sequence[str]) -> bool:
    """Whether text that matches ``alternative`` always holds one of ``literals`` (all folded).

    Only wildcards (``.``) may stand between the alternative's fixed parts.
    """
    parts = alternative.split(".")
    if any(ch in _REGEX_SYNTAX for part in parts for ch in part):
        return False
    return any(lit in part for lit in literals if lit for part in parts)


def decisive(rules: Rules) -> list[tuple[str, str]]:
    """The rules without alternatives that can never decide.

    A text that matches an alternative which contains a shorter literal of the same or of an earlier
    rule has already matched that literal, so the alternative need not be searched. The result is
    the same for every text; the rules themselves stay as written.
    """
    out: list[tuple[str, str]] = []
    earlier: list[str] = []
    for name, pattern in rules:
        alternatives = split_alternatives(pattern)
        if alternatives is None:
            out.append((name, pattern))
            continue
        folded = [fold_text(a) for a in alternatives]
        literals = [a for a in folded if not any(ch in _REGEX_SYNTAX for ch in a)]
        kept = [a for i, (a, f) in enumerate(zip(alternatives, folded))
                if f not in folded[:i] and not needless(f, earlier + [lit for lit in literals if lit != f])]
        if kept:
            out.append((name, "|".join(kept)))
        earlier += literals
    return out


def categorise(df: DataFrame, col: str, rules: Rules = CRIME_RULES, default: str = DEFAULT_CATEGORY,
               out: str = "category") -> DataFrame:
    """Add column ``out`` holding the first rule whose pattern occurs in ``col``.

    ``rules`` is an ordered list of ``(category, regex)``; the default is used for no match
    and for NULL text. An input column named ``out`` is replaced. The folded text is computed once per
    row. The category is produced by a one-element ``explode``: Catalyst keeps filters on the
    category above that generator (so the rules run once per row, not once more inside every
    pushed-down filter), while filters on other columns are still pushed below it to the scan.
    """
    folded = df.withColumn("_folded", fold_col(col))
    category = rule_expr(col, decisive(rules), default, folded=F.col("_folded"))
    keep = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != out]
    return folded.select(*keep, F.explode(F.array(category)).alias(out))


def category_dimension(df: DataFrame, col: str, rules: Rules = CRIME_RULES,
                       default: str = DEFAULT_CATEGORY, out: str = "category") -> DataFrame:
    """The distinct values of ``col`` (NULL included) with their category: ``col, out``.

    A lookup table for values that repeat. Joining it back is left to the caller and to the optimizer,
    which picks the join by the sizes it sees; categorising rows directly was faster in every case
    measured here.
    """
    return categorise(df.select(col).distinct(), col, rules, default, out)


def categorise_sql(text_sql: str, rules: Rules = CRIME_RULES, default: str = DEFAULT_CATEGORY) -> str:
    """The same rule chain as ANSI-ish SQL text with ``regexp_matches(x, p, 'i')`` (for oracles)."""
    parts = ["CASE"]
    for name, pattern in rules:
        p = pattern.replace("'", "''")
        n = name.replace("'", "''")
        parts.append(f"WHEN regexp_matches({text_sql}, '{p}', 'i') THEN '{n}'")
    d = default.replace("'", "''")
    parts.append(f"ELSE '{d}' END")
    return " ".join(parts)
