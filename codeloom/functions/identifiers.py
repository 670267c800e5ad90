"""Identifiers: splitting, classes and weights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


#: One part of a name: capitals up to the one that begins a word, a word with or without its capital, or a number.
PART = "[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"


def subtokens(text: Column) -> Column:
    """Lower-cased parts of a name or path, cut at case changes, digits and everything that is neither letter nor digit."""
    return F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), F.lower)


def subtokens_of(text: str) -> list[str]:
    """The same parts of a text of the driver."""
    return [x.lower() for x in re.findall(PART, text)]


def ident_multiplier(name: Column, definers: Column, mentioned: Column | None = None) -> Column:
    """How much a name counts as an edge: boosted if mentioned or long and composed, lowered if private or defined in many files."""
    joined = (name.contains("_") | name.contains("-")) & name.rlike("[a-zA-Z]")
    camel = name.rlike("[a-z]") & name.rlike("[A-Z]")
    out = F.when((joined | camel) & (F.length(name) >= S.LONG_IDENT), S.IDENT_BOOST).otherwise(1.0)
    if mentioned is not None:
        out = F.when(mentioned, S.IDENT_BOOST).otherwise(1.0) * out
    out = out * F.when(name.startswith("_"), S.UNDERSCORE_PENALTY).otherwise(1.0)
    return out * F.when(definers > S.RARE_DEFINERS, S.RARE_PENALTY).otherwise(1.0)


def tier(rank: Column, top: Column) -> Column:
    share = F.when(top > 0, rank / top).otherwise(F.lit(0.0))
    return F.when(share >= S.HUB_TIER, "hub").when(share >= S.MID_TIER, "mid").otherwise("leaf")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(text) / 4)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def declaration_site(defined_in: Column, external: Column) -> Column:
    return defined_in.isNull() & ~F.coalesce(external, F.lit(False))


def is_test_file(path: Column) -> Column:
    return path.rlike(S.TEST_FILE)
