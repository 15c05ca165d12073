"""Reasoning-structure scalars: pattern hits, flow labels, clause features."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern families of reasoning text, matched without regard to case.
PATTERNS = {
    "uncertainty": (
        r"(?:hmm|well|actually|wait|but then again|I'm not sure|might be|could be|seems like|appears to|I think|maybe|perhaps|possibly|likely|probably)",
        r"(?:I'm torn|I'm conflicted|I'm hesitant|I'm second-guessing|I keep going back and forth)",
        r"(?:on one hand|on the other hand|however|although|but|yet|still)",
        r"(?:let me reconsider|let me think again|actually, wait|hold on|that makes me wonder)",
    ),
    "logical_connector": (
        r"(?:because|since|therefore|thus|hence|as a result|consequently|due to|leads to|causes)",
        r"(?:if.*then|when.*then|given that|assuming|provided that)",
        r"(?:compared to|in contrast|unlike|similar to|just like|analogous to|whereas|while)",
        r"(?:better than|worse than|more.*than|less.*than|superior to|inferior to)",
        r"(?:the evidence shows|this suggests|this indicates|this implies|this demonstrates)",
        r"(?:supported by|contradicted by|consistent with|inconsistent with)",
    ),
    "evidence": (
        r"(?:the.*shows|the.*indicates|the.*suggests|the.*demonstrates|the.*proves)",
        r"(?:based on|according to|research shows|studies show|evidence suggests)",
        r"(?:we know that|it's established that|it's clear that|obviously|clearly)",
        r"(?:the fact that|given that|considering that|taking into account)",
    ),
    "contradiction": (
        r"(?:but.*contradicts|this contradicts|that's wrong|that doesn't make sense|that can't be right)",
        r"(?:actually, no|wait, that's not right|I was wrong|I made an error|that's backwards)",
        r"(?:opposite|contrary to|against|conflicts with|inconsistent)",
    ),
    "conclusion": (
        r"(?:so I conclude|therefore I think|I'm confident|I believe|my answer is)",
        r"(?:ultimately|finally|in conclusion|to sum up|the answer is|I settle on)",
        r"(?:I'm going with|I choose|I select|my final answer|I decide)",
    ),
    "decision": (
        r"(?:I need to decide|I have to choose|I must pick|the question is|the key is)",
        r"(?:the critical factor|the main issue|the deciding factor|what matters most)",
        r"(?:I'm leaning toward|I favor|I prefer|I'm inclined to think)",
    ),
}
# Flow labels of sentences; the first that matches counts.
FLOW = (
    ("INITIAL_APPROACH", r"(?:let me|I need to|I should)"),
    ("OPTION_INTRODUCTION", r"(?:first|initially|to start)"),
    ("COUNTER_CONSIDERATION", r"(?:but|however|on the other hand)"),
    ("RECONSIDERATION", r"(?:actually|wait|hmm)"),
    ("LOGICAL_INFERENCE", r"(?:so|therefore|thus|hence)"),
    ("CONCLUSION", r"(?:I think|I believe|I conclude)"),
    ("CAUSAL_REASONING", r"(?:because|since|due to)"),
    ("COMPARISON", r"(?:compared to|unlike|similar)"),
)
# Markers of certainty and of quantity, sought as parts of the text.
CERTAINTY = (
    (0.9, ("definitely", "certainly", "clearly", "obviously", "undoubtedly", "must", "will", "always")),
    (0.6, ("probably", "likely", "should", "would", "generally", "typically", "usually")),
    (0.3, ("possibly", "might", "could", "maybe", "perhaps", "sometimes", "occasionally")),
)
QUANTIFIERS = (
    ("universal", ("all", "every", "each", "any", "always")),
    ("existential", ("some", "there is", "there are", "exists", "sometimes")),
    ("negative", ("no", "none", "nothing", "never", "nobody")),
    ("proportional", ("most", "many", "few", "several", "majority")),
)
# Negations, and words of time and of frequency.
NEGATION = r"(?i)\b(?:not|no|never|nothing|nobody|nowhere|neither)\b|\b(?:isn't|aren't|wasn't|weren't|won't|wouldn't|can't|couldn't|shouldn't|mustn't)\b|\b(?:don't|doesn't|didn't|haven't|hasn't|hadn't)\b"
TEMPORAL = (r"\b(before|after|during|while|when|whenever|until|since|now|then|today|yesterday|tomorrow)\b", r"\b(always|never|sometimes|often|rarely|frequently|occasionally|usually|typically)\b")


def _in_slices(f, made: str):
    """f, an Arrow function of texts, as a column function that is given some 2 MB of text at a time (one text at least), so
    that what it makes of a batch of long texts stays small."""

    def run(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        out, at = [], 0
        while at < len(texts) or not out:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (2 << 20), "right")) - at)
            out.append(f(texts.slice(at, n)))
            at += n
        return pa.concat_arrays(out)

    return F.arrow_udf(run, made)


def _split_at(texts: pa.Array, pattern: str) -> list[list[str] | None]:
    """Each text cut before and after every match: what is outside stands at even places, the matches at odd ones. The engine
    is linear in the text, whatever the pattern; a mark is a character that no text of the batch has."""
    mark = next(m for m in map(chr, (*range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE))) if not pc.any(pc.match_substring(texts, m)).as_py())
    return [None if x is None else x.split(mark) for x in pc.replace_substring_regex(texts, f"(?i)({pattern})", mark + r"\1" + mark).to_pylist()]


@cache
def _hits(kind: str, places: bool):
    made = "array<struct<position:double>>" if places else "array<struct<type:string,text:string,confidence:double,position:double,context:string>>"

    def find(texts: pa.Array) -> pa.Array:
        cut = [_split_at(texts, p) for p in PATTERNS[kind]]
        ends, position, found, context = [0], [], [], []
        for k, text in enumerate(texts.to_pylist()):
            n = len(text or "")
            for parts in cut:
                at = 0
                for i, x in enumerate(parts[k] or ()):
                    if i % 2:
                        position.append(at / n)
                        if not places:
                            found.append(x)
                            context.append(text[max(0, at - 50) : at + len(x) + 50].replace("\n", " "))
                    at += len(x)
            ends.append(len(position))
        columns = {"position": pa.array(position, pa.float64())}
        if not places:
            text = pa.array(found, pa.string())
            length = pc.divide(pc.utf8_length(text).cast(pa.float64()), 20.0)
            columns = {"type": pa.array([kind] * len(found), pa.string()), "text": text, "confidence": pc.min_element_wise(length, 1.0), **columns, "context": pa.array(context, pa.string())}
        # a list is null where its first offset is
        starts = [None if none else x for x, none in zip(ends, [*texts.is_null().to_pylist(), False], strict=True)]
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    return _in_slices(find, made)


def pattern_hits(text: Column, kind: str) -> Column:
    """Every match of a family: type, text, confidence (length / 20, at most 1), position (0 to 1), context (50
    characters to either side)."""
    return _hits(kind, False)(text)


def pattern_places(text: Column, kind: str) -> Column:
    """The positions of a family's matches, without their texts."""
    return _hits(kind, True)(text)


@cache
def _counts(kind: str):
    def count(texts: pa.Array) -> pa.Array:
        out = pc.count_substring_regex(texts, f"(?i){PATTERNS[kind][0]}")
        for p in PATTERNS[kind][1:]:
            out = pc.add(out, pc.count_substring_regex(texts, f"(?i){p}"))
        return out.cast(pa.int32())

    return _in_slices(count, "int")


def pattern_count(text: Column, kind: str) -> Column:
    """How many matches a family has, without their places."""
    return _counts(kind)(text)


def sentences(text: Column, least: int = 10) -> Column:
    """trimmed sentences of at least ten characters."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= least)


def flow_label(sentence: Column) -> Column:
    """The first of eight labels that matches, else ELABORATION."""
    out = None
    for label, pattern in FLOW:
        rule = sentence.rlike("(?i)" + pattern)
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise("ELABORATION")


@cache
def _flow():
    def label(texts: pa.Array) -> pa.Array:
        cut = pc.split_pattern_regex(texts, r"[.!?]+")
        said = pc.replace_substring_regex(cut.flatten(), r"^\s+|\s+$", "")
        long = pc.greater_equal(pc.utf8_length(said), 10)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        kept = np.concatenate([[0], np.cumsum(long.to_numpy(zero_copy_only=False))]).astype(np.int32)
        said = said.filter(long)
        rules = [pc.match_substring_regex(said, "(?i)" + p) for _, p in FLOW]
        labels = pc.case_when(pa.StructArray.from_arrays(rules, [k for k, _ in FLOW]), *(pa.scalar(k) for k, _ in FLOW), pa.scalar("ELABORATION"))
        starts = pa.array(kept[ends], pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(starts, labels)

    return _in_slices(label, "array<string>")


def flow(text: Column) -> Column:
    """The labels of a text's sentences, in order; see flow_label."""
    return _flow()(text)


def structure(text: Column) -> Column:
    """All families' hits and the flow of a text."""
    return F.struct(*(pattern_hits(text, k).alias(k) for k in PATTERNS), flow(text).alias("flow"))


def outline(text: Column) -> Column:
    """C08 as far as the features need it: places in place of hits."""
    return F.struct(*(pattern_places(text, k).alias(k) for k in PATTERNS), flow(text).alias("flow"))


def negated(sentence: Column) -> Column:
    """F23."""
    return sentence.rlike(NEGATION)


def _has(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def certainty(sentence: Column) -> Column:
    """0.9, 0.6 or 0.3 by the first tier with a marker, else 0.7."""
    low = F.lower(sentence)
    out = F.when(_has(low, CERTAINTY[0][1]), CERTAINTY[0][0])
    for value, markers in CERTAINTY[1:]:
        out = out.when(_has(low, markers), value)
    return out.otherwise(0.7)


def quantifier(sentence: Column) -> Column:
    """type:marker of the first marker found, in table order."""
    low, out = F.lower(sentence), None
    for kind, markers in QUANTIFIERS:
        for m in markers:
            out = F.when(low.contains(m), f"{kind}:{m}") if out is None else out.when(low.contains(m), f"{kind}:{m}")
    return out


def temporal_marker(sentence: Column) -> Column:
    """the first temporal word, else the first word of frequency, in lower case."""
    when, often = (F.regexp_extract(F.lower(sentence), p, 1) for p in TEMPORAL)
    return F.when(when != "", when).when(often != "", often)


def conditional_type(sentence: Column) -> Column:
    """by parts of the text, so ``if`` is found in *specific*."""
    low = F.lower(sentence)
    out = F.when(low.contains("if") & low.contains("then"), "if_then").when(low.contains("if"), "if_implicit").when(low.contains("when"), "when").when(low.contains("unless"), "unless")
    return out.when(low.contains("provided") | low.contains("given that"), "provided").when(low.contains("assuming"), "assuming")


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of the clauses' words, + 0.3 for an equal predicate, + 0.2 for a shared subject; at most 1."""
    wa, wb = (F.array_distinct(F.filter(F.split(x["normalized_form"], r"\s+"), lambda w: w != "")) for x in (a, b))
    both = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(F.array_union(wa, wb)), F.lit(1))
    more = F.when(a["predicate"].eqNullSafe(b["predicate"]), 0.3).otherwise(0.0) + F.when(F.size(F.array_intersect(a["subjects"], b["subjects"])) > 0, 0.2).otherwise(0.0)
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(F.least(F.lit(1.0), both + more))


def stream_body(text: Column) -> Column:
    """What follows ``STREAM OF THOUGHT:`` up to a line of 80 ``=``; header and dash lines go."""
    begin = F.instr(text, "STREAM OF THOUGHT:")
    tail = F.substring(text, begin, F.length(text))
    body = F.substring_index(tail, "=" * 80, 1)
    body = F.regexp_replace(body, r"^(?:[^\n]*STREAM OF THOUGHT:[^\n]*(?:\n|$)|[ \t]*-{40}[ \t]*(?:\n|$))+", "")
    return F.when(begin == 0, "").otherwise(F.regexp_replace(body, r"^\s+|\s+$", ""))


def features(s: Column) -> dict[str, Column]:
    """13 numbers of a structure; means of nothing are 0 (positions 0.5), deviations are of the population."""

    def mean(xs: Column, default: float) -> Column:
        n = F.size(xs)
        return F.when(n == 0, default).otherwise(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1)))

    def dev(xs: Column) -> Column:
        # the mean is bound by an array of one, else it would be made anew for every element
        squares = F.get(F.transform(F.array(mean(xs, 0.0)), lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))), F.lit(0))
        return F.when(F.size(xs) == 0, 0.0).otherwise(F.sqrt(squares / F.greatest(F.size(xs), F.lit(1))))

    def share(n: Column, of: Column) -> Column:
        return F.when(of == 0, 0.0).otherwise(n / F.greatest(of, F.lit(1)))

    pos = F.transform(s["uncertainty"], lambda h: h["position"])
    steps = F.size(s["flow"])
    most = F.array_max(F.transform(F.array_distinct(s["flow"]), lambda x: F.size(F.filter(s["flow"], lambda y: y == x))))
    others = sum((F.size(s[k]) for k in ("uncertainty", "logical_connector", "evidence", "contradiction", "decision")), F.lit(0))
    return {
        "uncertainty_count": F.size(s["uncertainty"]),
        "logical_connector_count": F.size(s["logical_connector"]),
        "evidence_count": F.size(s["evidence"]),
        "contradiction_count": F.size(s["contradiction"]),
        "conclusion_count": F.size(s["conclusion"]),
        "decision_count": F.size(s["decision"]),
        "flow_length": steps,
        "flow_diversity": share(F.size(F.array_distinct(s["flow"])), steps),
        "uncertainty_mean_position": mean(pos, 0.5),
        "uncertainty_std_position": dev(pos),
        "early_uncertainty_ratio": share(F.size(F.filter(pos, lambda x: x < 0.33)), F.size(pos)),
        "flow_repetition_ratio": share(F.coalesce(most, F.lit(0)), steps),
        "conclusion_efficiency": share(F.size(s["conclusion"]), others),
    }


# Sub-clause patterns by kind, each with two groups.
SUB_CLAUSES = {
    "conditional": (
        r"if\s+(.+?)\s*,?\s*then\s+(.+?)[\.,]",
        r"if\s+(.+?)\s*,\s*(.+?)[\.,]",
        r"when\s+(.+?)\s*,\s*(.+?)[\.,]",
        r"whenever\s+(.+?)\s*,\s*(.+?)[\.,]",
        r"provided\s+that\s+(.+?)\s*,\s*(.+?)[\.,]",
        r"given\s+that\s+(.+?)\s*,\s*(.+?)[\.,]",
        r"assuming\s+(.+?)\s*,\s*(.+?)[\.,]",
    ),
    "causal": (
        r"(.+?)\s+causes?\s+(.+?)[\.,]",
        r"(.+?)\s+leads?\s+to\s+(.+?)[\.,]",
        r"(.+?)\s+results?\s+in\s+(.+?)[\.,]",
        r"because\s+(.+?)\s*,\s*(.+?)[\.,]",
        r"since\s+(.+?)\s*,\s*(.+?)[\.,]",
        r"due\s+to\s+(.+?)\s*,\s*(.+?)[\.,]",
    ),
    "disjunctive": (r"either\s+(.+?)\s+or\s+(.+?)[\.,]", r"(.+?)\s+or\s+(.+?)[\.,]"),
}


def sub_clauses(sentence: Column, least: int = 5) -> Column:
    """array of kind, role (1 or 2) and text of every match's groups that are longer than `least` characters."""

    def of(kind: str, pattern: str, role: int) -> Column:
        found = F.regexp_extract_all(sentence, F.lit("(?i)" + pattern), F.lit(role))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.trim(x).alias("text")))

    out = [of(kind, p, role) for kind, patterns in SUB_CLAUSES.items() for p in patterns for role in (1, 2)]
    return F.filter(F.flatten(F.array(*out)), lambda c: F.length(c["text"]) > least)
