"""JSON that models write: fences, prefixes, stray backslashes, broken objects (N*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import bound


#: How a JSON value begins.
_BEGINS = r"^\s*[\[{\"\-0-9tfn]"


def unfenced(c: Column) -> Column:
    """The outermost braces of a text, without code fence or prefix."""

    def braces(text: Column, body: Column) -> Column:
        return bound(F.regexp_extract(body, r"(?s)(\{.*\})", 1), lambda x: F.when(x != "", x).otherwise(F.trim(text)))

    def inside(text: Column) -> Column:
        return bound(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), lambda x: bound(F.when(x != "", x).otherwise(text), lambda y: braces(y, y)))

    return bound(c, inside)


def unescaped(c: Column) -> Column:
    """A backslash that begins no JSON escape is doubled."""
    return F.regexp_replace(c, r"(?<!\\)\\(?![\\\"/bfnrtu])", r"\\\\")


def parsed(c: Column, schema: str) -> Column:
    """The text, then its braces, then those with repaired backslashes; null if none parses. Each form is made once, and
    tried only if it is not the form before and can begin a value: a try that fails costs an exception."""

    def tried(x: Column) -> Column:
        return F.when(x.rlike(_BEGINS) & F.try_parse_json(x).isNotNull(), x)

    def repaired(x: Column) -> Column:
        return bound(unescaped(x), lambda y: F.when(y != x, tried(y)))

    def braced(before: Column, x: Column) -> Column:
        return F.coalesce(F.when(x != before, tried(x)), repaired(x))

    def first(x: Column) -> Column:
        return F.coalesce(tried(x), bound(unfenced(x), lambda y: braced(x, y)))

    return bound(bound(F.trim(c), first), lambda x: F.from_json(x, schema))


def grade(c: Column, compat: bool = False) -> Column:
    """Struct of is_correct and confidence; unparsable text falls back to its fields, else to not correct.
    ``compat`` reads any text with *correct* in it as correct (T10)."""
    p = parsed(c, "struct<is_correct:boolean,confidence:double>")
    told = F.regexp_extract(c, r"\"is_correct\"\s*:\s*(true|false)", 1)
    rough = F.when(told != "", told == "true").otherwise(F.lower(c).contains("correct") if compat else F.lit(False))
    return F.struct(F.coalesce(p["is_correct"], rough).alias("is_correct"), F.coalesce(p["confidence"], F.lit(0.5)).alias("confidence"))


def score_and_match(c: Column) -> Column:
    """Score and match of broken JSON: a score above 0.5 is a match; a told match counts more."""
    score = F.regexp_extract(c, r"\"?score\"?\s*:\s*([0-9.]+)", 1).try_cast("double")
    match = F.regexp_extract(F.lower(c), r"\"?match\"?\s*:\s*\"?(true|yes|1|false|no|0)", 1)
    told = F.when(match != "", match.isin("true", "yes", "1"))
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(told, score > 0.5, F.lit(False)).alias("match"))


def needs_synthesis(section: Column, phrases: tuple[str, ...]) -> Column:
    """A nested section holds a fallback phrase."""
    text = F.lower(F.to_json(section))
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p.lower())
    return out
