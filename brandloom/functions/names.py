"""Business-name matching keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandloom import vocab as V
from brandloom.functions.regex import let
from brandloom.functions.text import fold

MIN_PREFIX = 5


def normalize_folded(folded: Column) -> Column:
    c = F.replace(folded, F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(c, "[^a-z0-9 ]+", " ")
    c = F.regexp_replace(c, r"\b(" + "|".join(V.NAME_STOP_NOUNS) + r")\b", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def normalize_name(c: Column) -> Column:
    return normalize_folded(fold(c))


def same_norm(a: Column, b: Column) -> Column:
    """Same business, on normalised names: equal, or the shorter one (5+ characters)
    is a whole-word prefix of the longer one."""

    def test(x: Column, y: Column) -> Column:
        starts = F.when(F.length(x) <= F.length(y), F.startswith(y, F.concat(x, F.lit(" ")))).otherwise(F.startswith(x, F.concat(y, F.lit(" "))))
        return (x != "") & (y != "") & ((x == y) | ((F.least(F.length(x), F.length(y)) >= MIN_PREFIX) & starts))

    return let(a, lambda x: let(b, lambda y: test(x, y)))


def any_same(norms: Column, norm: Column) -> Column:
    return let(norm, lambda m: F.exists(norms, lambda n: same_norm(n, m)))


def first_same(names: Column, norms: Column, norm: Column) -> Column:
    """First of ``names`` whose norm is the same business, else NULL."""
    zipped = F.arrays_zip(names.alias("name"), norms.alias("norm"))
    return let(norm, lambda m: F.get(F.filter(zipped, lambda x: same_norm(x["norm"], m)), F.lit(0))["name"])


def proper_prefixes(norm: Column) -> Column:
    """Whole-word prefixes of 5+ characters, shorter than the name itself."""

    def cut(tokens: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, 1, i), " ")
        )
        return F.when(F.size(tokens) > 1, F.filter(each, lambda p: F.length(p) >= MIN_PREFIX)).otherwise(F.array().cast("array<string>"))

    return let(F.split(norm, " "), cut)
