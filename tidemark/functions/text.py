"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def normalise(text: str | Column) -> Column:
    """Lower case, white space folded and trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def tokens(text: str | Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def text_key(text: str | Column) -> Column:
    """A hash of the normalised text that every engine computes alike."""
    return F.md5(normalise(text))


def non_empty(text: str | Column) -> Column:
    return F.coalesce(F.length(normalise(text)) > 0, F.lit(False))


def contains_name(text: Column, name: Column) -> Column:
    """Whole-word containment without a pattern, so ``+``, brackets and quotes in names need no escaping."""
    flat = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), NOT_WORD, " ")), F.lit(" "))
    return F.contains(flat(text), flat(name))
