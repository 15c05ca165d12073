"""Parts of sentences by pattern: predicates, subjects, objects, modifiers, propositions, connectives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of verbs in order of trust, with the group that holds the verb.
VERBS = (
    (r"\b(is|are|was|were|being|been)\s+(\w+)", 2),
    (r"\b(\w+(?:s|ed|ing))\b", 1),
    (r"\b(has|have|had)\s+(\w+)", 2),
    (r"\b(will|would|can|could|should|must|might|may)\s+(\w+)", 2),
)
# What follows a verb, up to a full stop, a comma or the end.
OBJECTS = (r"(?:is|are|was|were)\s+(.*?)(?:\.|,|$)", r"(?:has|have|had)\s+(.*?)(?:\.|,|$)", r"(?:causes?|leads?\s+to|results?\s+in)\s+(.*?)(?:\.|,|$)")
# Modifying phrases; where a pattern has a group, the group counts.
MODIFIERS = (
    (r"\b(very|extremely|highly|completely|totally|absolutely|quite|rather|fairly)\s+\w+", 1),
    (r"\b(in|on|at|by|with|through|during|after|before)\s+\w+(?:\s+\w+)*", 1),
    (r"\b\w+ly\b", 0),
)
# Pronouns that open a sentence, and words before which a noun phrase stands.
PRONOUNS = r"^(I|You|He|She|It|We|They|This|That)\b"
NOUN_PHRASE = r"\b(the\s+\w+(?:\s+\w+)*|a\s+\w+(?:\s+\w+)*|\w+(?:\s+\w+)*)\s+(?:is|are|was|were|has|have|had|will|would|can|could|should|must|might|may)"
# Connectives between propositions, by relation; the first family that occurs counts.
RELATIONS = (
    ("implies", ("therefore", "thus", "hence", "so", "consequently")),
    ("conditional", ("if", "when", "given that", "assuming")),
    ("contrast", ("but", "however", "although", "while")),
    ("conjunction", ("and", "also", "furthermore", "moreover")),
    ("disjunction", ("or", "either", "alternatively")),
    ("causation", ("because", "since", "due to", "as")),
)


def predicate(sentence: Column) -> Column:
    """the main verb by the first pattern that matches, else ``relates``."""
    found = [F.nullif(F.regexp_extract(sentence, "(?i)" + p, group), F.lit("")) for p, group in VERBS]
    return F.coalesce(*found, F.lit("relates"))


def subjects(sentence: Column) -> Column:
    """capitalised words, an opening pronoun, noun phrases before verbs; a set, given in sorted order."""
    names = F.regexp_extract_all(sentence, F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1))
    pronoun = F.lower(F.regexp_extract(sentence, "(?i)" + PRONOUNS, 1))
    opening = F.when(pronoun != "", F.array(pronoun)).otherwise(F.array().cast("array<string>"))
    phrases = F.transform(F.regexp_extract_all(sentence, F.lit("(?i)" + NOUN_PHRASE), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.concat(names, opening, phrases)))


def objects(sentence: Column) -> Column:
    """phrases after verbs that are longer than two characters, by pattern."""
    found = F.concat(*(F.regexp_extract_all(sentence, F.lit("(?i)" + p), F.lit(1)) for p in OBJECTS))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 2)


def modifiers(sentence: Column) -> Column:
    """adverbs of degree, prepositions of phrases, and adverbs in -ly, by pattern."""
    return F.concat(*(F.regexp_extract_all(sentence, F.lit("(?i)" + p), F.lit(group)) for p, group in MODIFIERS))


def _words(sentence: Column) -> Column:
    return F.filter(F.split(sentence, r"\s+"), lambda w: w != "")


def simple_verb(sentence: Column) -> Column:
    """the first word of more than three characters that ends in s, ed or ing, else ``relates``."""
    verbs = F.filter(_words(sentence), lambda w: (F.length(w) > 3) & (w.endswith("s") | w.endswith("ed") | w.endswith("ing")))
    return F.coalesce(F.get(verbs, F.lit(0)), F.lit("relates"))


def entities(sentence: Column, most: int = 2) -> Column:
    """the first words of letters alone that begin with a capital."""
    return F.slice(F.filter(_words(sentence), lambda w: w.rlike(r"^\p{Lu}\p{L}*$")), 1, most)


def negative(sentence: Column) -> Column:
    """``not`` or ``n't`` anywhere."""
    low = F.lower(sentence)
    return low.contains("not") | low.contains("n't")


def relation(between: Column) -> Column:
    """How the text between two propositions relates them; null without a connective."""
    low, out = F.lower(between), None
    for name, markers in RELATIONS:
        rule = F.lit(False)
        for m in markers:
            rule = rule | low.contains(m)
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out
