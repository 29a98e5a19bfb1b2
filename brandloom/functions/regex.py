"""Pattern helpers: the same pattern text behaves alike on every engine.

Word boundaries in our patterns are ASCII ones.  Java's ``\\b`` also counts accented
letters as word characters, so text is first passed through ``ascii_view``, which
replaces characters outside ASCII by a symbol that is no word character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandloom.vocab import WS_CLASS, WHITESPACE

PLACEHOLDER = "¤"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``: keeps nested
    expressions (and their cost inside lambdas) linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(c: Column) -> Column:
    """Constant-time test per row: one byte per character."""
    return F.length(c) == F.octet_length(c)


def ascii_view(c: Column, keep: str = "") -> Column:
    """Text with every non-ASCII character (except white space and ``keep``) replaced
    by a symbol."""
    kept = WS_CLASS[1:-1].replace("\\s", "") + keep
    return let(c, lambda t: F.when(is_ascii(t), t).otherwise(F.regexp_replace(t, f"[^\\x00-\\x7f{kept}]", PLACEHOLDER)))


def js_pattern(p: str) -> str:
    """Give ``\\s`` and a closing ``$`` their wider/narrower meaning."""
    return p.replace("\\s", WS_CLASS).replace("$", "\\z")


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(("(?i)" if ignore_case else "") + js_pattern(pattern))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(js_pattern(pattern)))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def quote_regex(c: Column) -> Column:
    """Escape a string column so that it matches itself as a pattern."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def js_round(x: Column) -> Column:
    """Half-up rounding towards positive infinity, as a long."""
    return F.floor(x + F.lit(0.5))
