"""Multiple-choice parsing and grading scalars (R*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def identifier_style(question: Column) -> Column:
    """R01: 'number' if an option line begins with 1-5, else 'letter'."""
    return F.when(question.rlike(r"(?:^|\n)\s*([1-5])[.):,]\s"), "number").otherwise("letter")


def is_multiple_choice(question: Column) -> Column:
    """Option lines, or lines of Option, Choice or Answer with a letter."""
    return question.rlike(r"(?i)(?:^|\n)\s*(?:[A-E]|[1-5])[.):]\s|\n\s*(?:Option|Choice|Answer)\s+[A-E][.:)]")


def choice(answer: Column, letters: str = "A-E", digits: str = "1-5") -> Column:
    """Struct of kind and id of the choice an answer names. Letters before numbers; then the first line's
    beginning; then, in texts under 100 characters, a letter or number that stands alone."""
    line = F.trim(F.split(answer, "\n")[0])

    def marked(x: str) -> list[Column]:
        return [
            _first(answer, rf"(?i)(?:^|\n)\s*([{x}])[.):]\s"),
            _first(answer, rf"(?i)(?:option|answer|choice)\s+([{x}])\b"),
            F.coalesce(_first(answer, rf"(?i)(?:the\s+(?:correct\s+)?answer\s+is\s+([{x}]))|(?:\b([{x}])\s+is\s+(?:the\s+)?correct)"), _first(answer, rf"(?i)(?:the\s+(?:correct\s+)?answer\s+is\s+([{x}]))|(?:\b([{x}])\s+is\s+(?:the\s+)?correct)", 2)),
        ]

    def begins(x: str) -> Column:
        return _first(line, rf"(?i)^([{x}])(?:[.):,]|\s|$)")

    def alone(x: str) -> Column:
        return F.when(F.length(answer) < 100, _first(answer, rf"(?i)\b([{x}])\b"))

    def tagged(kind: str, ids: list[Column]) -> Column:
        found = F.coalesce(*ids)
        return F.when(found.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.upper(found).alias("id")))

    return F.coalesce(tagged("letter", marked(letters)), tagged("number", marked(digits)), tagged("letter", [begins(letters)]), tagged("number", [begins(digits)]), tagged("letter", [alone(letters)]), tagged("number", [alone(digits)]))


def normalised_choice(kind: Column, ident: Column, target: str) -> Column:
    """A-Z to 1-26 or back."""
    number = F.when(ident.rlike(r"^\d+$"), ident.cast("int"))
    letter = F.when((number >= 1) & (number <= 26), F.chr((number + 64).cast("long")))
    other = F.when(F.lit(target) == "number", (F.ascii(F.upper(ident)) - 64).cast("string")).otherwise(letter)
    return F.when(kind == target, ident).otherwise(other)


def option_content(question: Column, ident: Column) -> Column:
    """Text of an option, to the next option line or the end; white space collapsed. The look-ahead needs no regex:
    the lines after the option's own are taken up to the next option line."""
    lines = F.split(question, "\n")
    starts = F.transform(lines, lambda x: F.upper(F.regexp_extract(x, r"^\s*([A-Ea-e1-5])[.):,]", 1)))
    at = F.array_position(starts, F.upper(ident))
    rest = F.slice(starts, (at + 1).cast("int"), F.greatest(F.size(starts) - at, F.lit(0)).cast("int"))
    ends = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct(F.when(acc["on"] & (x == ""), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & (x == "")).alias("on")), lambda acc: acc["n"])
    body = F.array_join(F.slice(lines, at.cast("int"), ends + 1), "\n")
    content = F.trim(F.regexp_replace(F.regexp_replace(body, r"^\s*[A-Ea-e1-5][.):,]", ""), r"\s+", " "))
    return F.when((at > 0) & (content != ""), content)


def options(question: Column) -> Column:
    """Option texts of the lines ``1) text``; marks ``(*)`` go."""
    lines = F.filter(F.split(question, "\n"), lambda x: x.rlike(r"^\s*(?:\d+|[A-Za-z])[.)]\s+\S"))
    return F.transform(lines, lambda x: F.trim(F.replace(F.regexp_replace(x, r"^\s*(?:\d+|[A-Za-z])[.)]\s+", ""), F.lit("(*)"), F.lit(""))))


def correct_option(question: Column) -> Column:
    """R09, without its shifted index (T11): place (from 1) of the option line marked ``(*)``; null if none is."""
    lines = F.filter(F.split(question, "\n"), lambda x: x.rlike(r"^\s*(?:\d+|[A-Za-z])[.)]\s+\S"))
    at = F.array_position(F.transform(lines, lambda x: x.contains("(*)")), True)
    return F.when(at > 0, at.cast("int"))


def stdout_metric(text: Column, pattern: str) -> Column:
    """The first number a pattern finds in a run's output."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.cast("double"))


def has_embedded_options(question: Column) -> Column:
    """A line that begins with 1-9 and a dot or bracket."""
    return F.exists(F.split(question, "\n"), lambda x: F.trim(x).rlike(r"^[1-9][.)]"))


def first_integer(c: Column) -> Column:
    """The first integer that stands alone."""
    found = F.regexp_extract(c, r"\b(\d+)\b", 1)
    return F.when(found != "", found)


def repaired_score(fmt: Column, score: Column, correct: Column, model: Column, has_correct: Column | None = None, has_model: Column | None = None, mode: str = "strict") -> Column:
    """A multiple-choice score follows from the letters. Letters are compared as they are.

    ``strict`` repairs only where both letters are there; ``compat`` reads two *missing* letters as equal (presence flags
    tell a missing letter from a null one, which is left alone).
    """
    told = F.coalesce((correct != "") & (model != ""), F.lit(False))
    out = F.when(told, F.when(correct == model, 1.0).otherwise(0.0)).otherwise(score)
    if mode == "compat":
        missing_c, missing_m = ~has_correct, ~has_model
        one = (missing_c & has_model & (model != "")) | (missing_m & has_correct & (correct != ""))
        out = F.when(missing_c & missing_m, 1.0).when(F.coalesce(one, F.lit(False)), 0.0).otherwise(out)
    return F.when(fmt == "mc", out).otherwise(score)


def fingerprint(question: Column) -> Column:
    """First 100 characters of the trimmed question, trimmed."""
    return F.trim(F.substring(F.trim(question), 1, 100))


def word_overlap(option: Column, answer: Column) -> Column:
    """Long options need 60 % of their words in the answer; short ones must stand in it."""
    o, a = F.trim(F.lower(F.regexp_replace(option, r"\s+", " "))), F.trim(F.lower(F.regexp_replace(answer, r"\s+", " ")))
    ow, aw = (F.array_distinct(F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))) for x in (o, a))
    ratio = F.size(F.array_intersect(ow, aw)) / F.greatest(F.size(ow), F.lit(1))
    return F.when((F.length(o) > 15) & (F.size(ow) > 0), ratio >= 0.6).otherwise(a.contains(o))


# Ways in which a free text names its predicted option, in order of trust.
PREDICTIONS = (
    r"I\s+predict\s+(?:that\s+)?(?:option|answer)\s*(?:number|#)?\s*(\d+)",
    r"(?:My prediction|My answer|I believe|I think)\s+(?:is|would be)\s+(?:option|answer)?\s*(?:number|#)?\s*(\d+)",
    r"(?:option|answer)\s+(\d+)\s+(?:is|seems|appears to be)\s+(?:the\s+)?correct",
    r"(?:based on|after)\s+(?:my|this)\s+analysis,\s+(?:option|answer)\s+(\d+)",
    r"(?:therefore|thus|hence),\s+(?:option|answer)\s+(\d+)",
    r"(?:I would|I am going to|I will)\s+(?:choose|select|pick|go with)\s+(?:option|answer)\s+(\d+)",
    r"(?:option|answer)\s+(\d+)[\s.:,]",
    r"(?:the\s+)?correct\s+(?:option|answer)\s+(?:is|would be)\s+(\d+)",
    r"I\s+(?:choose|select|pick)\s+(?:option|answer)\s+(\d+)",
    r"(?:option|answer)\s+(\d+)\s+is\s+(?:the\s+)?(?:most\s+)?(?:correct|accurate|appropriate)",
)
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
CONFIDENCE = (r"(?:My confidence|Confidence level|I am)(?:is|:)?\s+(high|medium|low)", r"I have\s+(high|medium|low)(?:\s+level of)?\s+confidence")
CONCLUSIONS = (
    r"(?:Scientific conclusion|Conclusion|Final conclusion|In conclusion|To summarize)(?:is|:)(.*?)$",
    r"(?:Based on my analysis|After analyzing all options|Having considered the evidence)(.*?)$",
)


def prediction(text: Column) -> Column:
    """Struct of predicted (``Option n`` or ``Could not determine``) and confidence (unknown if none is told)."""
    named = F.coalesce(*(_first(text, "(?i)" + p) for p in PREDICTIONS))
    word = None
    for k, w in [*enumerate(ORDINALS, 1), *enumerate("abcdefg", 1)]:
        rule = text.rlike(rf"(?i)(?:the\s+)?{w}(?:\s+option|\s+answer)?\s+(?:is|seems|appears\s+to\s+be)\s+correct")
        word = F.when(rule, str(k)) if word is None else word.when(rule, str(k))
    number = F.coalesce(named, word)
    told = F.coalesce(*(_first(text, "(?i)" + p) for p in CONFIDENCE))
    return F.struct(F.coalesce(F.concat(F.lit("Option "), number), F.lit("Could not determine")).alias("predicted"), F.coalesce(F.lower(told), F.lit("unknown")).alias("confidence"))


def conclusion(text: Column) -> Column:
    """The text after a heading of conclusion; empty if there is none."""
    found = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, "(?is)" + p, 1)), F.lit("")) for p in CONCLUSIONS))
    return F.coalesce(found, F.lit(""))


def option_thoughts(text: Column, options: int) -> Column:
    """Map of option_k to the text after ``Option k:``, to the next one; the first of a number counts."""
    parts = F.split(F.regexp_replace(text, r"(?i)(?:I\s+predict|My\s+prediction)[\s\S]*$", ""), r"(?i)(?:^|\b)option\s+(?=\d+[\s:])")
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.concat(F.lit("option_"), F.regexp_extract(p, r"^(\d+)", 1)).alias("k"), F.regexp_replace(p, r"^\d+[\s:]+|\s+$", "").alias("v")))
    good = F.filter(pairs, lambda p: (p["v"] != "") & F.regexp_extract(p["k"], r"(\d+)$", 1).cast("int").between(1, options))
    first = F.filter(good, lambda p, i: F.array_position(F.transform(good, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def option_keys(thoughts: Column) -> Column:
    """Keys option_k in order of number; others last."""
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(k, r"^option_(\d+)$", 1), F.lit("")).cast("int"), F.lit(2**31 - 1))
    return F.transform(F.array_sort(F.transform(F.map_keys(thoughts), lambda k: F.struct(number(k).alias("n"), k.alias("k")))), lambda s: s["k"])


def line_options(question: Column) -> Column:
    """Options of the lines after the first blank line that begin with one letter or digit, ``)`` or ``.``, and a
    space; a mark ``(*)`` at the end goes. Without a blank line there are none."""
    at = F.instr(question, "\n\n")
    lines = F.transform(F.split(F.substring(question, at + 2, F.length(question)), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    found = F.filter(lines, lambda x: x.rlike(r"^[\p{L}\p{Nd}][).] "))
    texts = F.transform(found, lambda x: F.trim(F.regexp_replace(F.trim(F.substring(x, F.lit(4), F.length(x))), r"\s*\(\*\)$", "")))
    return F.when(at > 0, texts).otherwise(F.array().cast("array<string>"))


def options_text(options: Column) -> Column:
    """Options as numbered lines."""
    return F.array_join(F.transform(options, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n")


#: Fields of a grader's answer that R16 reads.
GRADE = "struct<score:double,match:boolean,correct_choice:string,correct_letter:string,model_choice:string,model_letter:string,confidence:double>"


def normalised_grade(grade: Column, fmt: Column) -> Column:
    """Struct of score, correct_letter, model_letter and format. A missing score follows from the match (for multiple
    choice 0 without one, for free answers null); letters take the older field names where the newer are missing."""
    by_match = F.when(grade["match"], 1.0).when(~grade["match"], 0.0)
    score = F.coalesce(grade["score"], by_match, F.when(fmt == "mc", 0.0))
    letter = lambda k: F.when(fmt == "mc", F.coalesce(grade[f"{k}_letter"], grade[f"{k}_choice"]))
    return F.struct(score.alias("score"), letter("correct").alias("correct_letter"), letter("model").alias("model_letter"), F.when(fmt == "mc", "mc").otherwise("qa").alias("format"))
