"""Text scalars as Column functions: hashes, identifiers, truncation, cleaning, chunks (F*, C01-C03, P02, P03)."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Openings of evaluation sentences that a technical answer must not hold; each ends with its sentence.
BOILER_PLATE = (
    r"The question is clear[^.]*\.",
    r"The question is well-structured[^.]*\.",
    r"The stem is unambiguous[^.]*\.",
    r"The answer choices are plausible[^.]*\.",
    r"The question is factually accurate[^.]*\.",
    r"The difficulty is appropriate[^.]*\.",
    r"The distractors are well-chosen[^.]*\.",
    r"The educational value is high[^.]*\.",
    r"The only minor deduction[^.]*\.",
    r"The content block[^.]*\.",
    r"This question tests[^.]*\.",
    r"The question requires[^.]*\.",
    r"This is a good question[^.]*\.",
    r"This question is appropriate[^.]*\.",
    r"The provided context[^.]*\.",
    r"Overall[,\s]*this is[^.]*\.",
    r"In summary[^.]*\.",
    r"The answer provided[^.]*\.",
    r"This answer[^.]*demonstrates[^.]*\.",
    r"The response shows[^.]*\.",
    r"This explanation[^.]*\.",
    r"The text states[^.]*\.",
    r"According to the passage[^.]*\.",
    r"The passage mentions[^.]*\.",
    r"As described in[^.]*\.",
    r"The document indicates[^.]*\.",
    r"This demonstrates[^.]*understanding[^.]*\.",
    r"requiring careful reading[^.]*\.",
    r"potential[ly]* overwhelm[^.]*\.",
)


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def question_hash(c: Column) -> Column:
    """md5 of the white-space-normalised text."""
    return F.md5(normalised(c))


def file_id(path: Column, modified: Column) -> Column:
    """first 16 hex digits of sha256(path_mtime); mtime in microseconds."""
    return F.substring(F.sha2(F.concat_ws("_", path, F.unix_micros(modified).cast("string")), 256), 1, 16)


def chunk_id(doc: Column, index: Column) -> Column:
    """id and four-digit index."""
    return F.concat(doc.cast("string"), F.lit("_"), F.lpad(index.cast("string"), 4, "0"))


def stem(path: Column) -> Column:
    """file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def sanitised(c: Column) -> Column:
    """letters, digits, blank, dot and underscore only; right-trimmed."""
    return F.rtrim(F.regexp_replace(c, r"[^\p{L}\p{N} ._]", ""))


def slug(c: Column, fallback: Column, length: int = 50) -> Column:
    """other characters than letters and digits collapse to one underscore, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.substring(c, 1, length), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", fallback).otherwise(s)


def first_words(c: Column, n: int = 500) -> Column:
    """the text itself if it has at most n words, else its first n joined by blanks."""
    w = words(c)
    return F.when(F.size(w) <= n, c).otherwise(F.array_join(F.slice(w, 1, n), " "))


def truncated(c: Column, limit: int, mark: str = "\n\n[Content truncated for analysis]") -> Column:
    """cut at the last full stop if it lies in the last fifth of the limit; a mark tells of the cut."""
    head = F.substring(c, 1, limit)
    last = F.when(F.instr(F.reverse(head), ".") > 0, F.length(head) - F.instr(F.reverse(head), ".")).otherwise(-1)
    cut = F.when(last > F.lit(limit * 0.8), F.substring(head, F.lit(1), (last + 1).cast("int"))).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit(mark)))


def preprocessed(c: Column) -> Column:
    """white space, links, addresses, citations, punctuation and digits go; lower case."""
    for pattern, new in ((r"\s+", " "), (r"http\S+|www\S+|https\S+", ""), (r"\S*@\S*\s?", ""), (r"\[\d+(?:,\s*\d+)*\]", ""), (r"[^\p{L}\p{N}_\s]", " "), (r"\d+", "")):
        c = F.regexp_replace(c, pattern, new)
    return normalised(F.lower(c))


def content_tokens(c: Column, stop: tuple[str, ...]) -> Column:
    """tokens of the preprocessed text, longer than two characters and not in the stop list (no lemmatiser)."""
    return F.filter(F.split(preprocessed(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(*stop))


def cleaned_answer(c: Column) -> Column:
    """evaluation sentences and choice labels go."""
    for pattern in BOILER_PLATE:
        c = F.regexp_replace(c, "(?is)" + pattern, "")
    for pattern in (r"\([A-Z]\)", r"choice\s+[A-Z]", r"option\s+[A-Z]"):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s*\.\s*\.", "."))


def option_number(c: Column) -> Column:
    """the number in ``(Option N)``, else the trimmed text."""
    n = F.regexp_extract(c, r"\(Option (\d+)\)", 1)
    return F.when(n != "", n).otherwise(F.trim(c))


def short_label(c: Column) -> Column:
    """two or more words become four letters of the first two, one word its first eight."""
    w = F.split(c, " ")
    return F.when(F.size(w) >= 2, F.concat(F.substring(w[0], 1, 4), F.substring(w[1], 1, 4))).otherwise(F.substring(c, 1, 8))


def keyword_fallback(c: Column, common: tuple[str, ...], n: int = 6) -> Column:
    """the first n distinct words of four or more letters that are not common; in order of first place."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]{4,})\b"), F.lit(1)))
    return F.slice(F.filter(found, lambda w: ~w.isin(*common)), 1, n)


def duration_text(seconds: Column) -> Column:
    """seconds, minutes, hours or days with two decimals (an exact half rounds up: T23)."""
    out = None
    for limit, unit, name in ((60, 1, "seconds"), (3600, 60, "minutes"), (86400, 3600, "hours"), (None, 86400, "days")):
        text = F.format_string(f"%.2f {name}", (seconds / unit).cast("double"))
        if out is None:
            out = F.when(seconds < limit, text)
        else:
            out = out.when(seconds < limit, text) if limit else out.otherwise(text)
    return out


def labelled_field(c: Column, name: str, stop: tuple[str, ...] = (), anchored: bool = True) -> Column:
    """text after ``NAME:`` up to a line that begins with another label, or the end; null if absent."""
    ends = "|".join(rf"\n\s*{x}:" for x in stop)
    pattern = rf"(?s){'(?:^|.*?\n)\\s*' if anchored else ''}{name}:\s*(.*?)\s*(?:{ends + '|' if ends else ''}$)"
    found = F.regexp_extract(c, pattern, 1)
    return F.when(c.rlike(rf"(?s){'(?:^|\n)\\s*' if anchored else ''}{name}:"), found)


def score_field(c: Column, name: str, default: int) -> Column:
    """a score as a whole number, truncated toward zero; a default where it is missing."""
    found = F.regexp_extract(c, rf"{name}:\s*(\d+(?:\.\d+)?)", 1)
    return F.coalesce(F.when(found != "", found.cast("double").cast("int")), F.lit(default))


def question_answer_text(q: Column, a: Column) -> Column:
    """One text of a question and its answer."""
    return F.concat(F.lit("Question: "), F.trim(q), F.lit("\nAnswer: "), F.trim(a))


def without_literal(df: DataFrame, literal: str = "(*)") -> DataFrame:
    """A literal goes from every string of every column, nested ones and map keys included."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StringType):
            return F.replace(c, F.lit(literal), F.lit(""))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(F.transform_keys(c, lambda k, v: clean(k, t.keyType)), lambda k, v: clean(v, t.valueType))
        if isinstance(t, T.StructType):
            fields = F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in t.fields))
            return F.when(c.isNotNull(), fields)
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def chunks(df: DataFrame, text: str = "text", size: int = 500) -> DataFrame:
    """chunk_index and chunk of `size` words each, joined by blanks; the last may be shorter; none without words."""
    w = words(F.col(text))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("w_") - 1) / size).cast("int")), lambda i: F.array_join(F.slice(F.col("w_"), i * size + 1, F.lit(size)), " "))
    full = df.withColumn("w_", w).where(F.size("w_") > 0)
    return full.select("*", F.posexplode(pieces).alias("chunk_index", "chunk")).drop("w_", text)


def char_chunks(df: DataFrame, text: str = "text", size: int = 2000) -> DataFrame:
    """Pieces of `size` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return df.where(F.length(text) > 0).select("*", F.posexplode(pieces).alias("chunk_index", "chunk")).drop(text)


def boundary_chunks(df: DataFrame, text: str = "text", size: int = 15_000) -> DataFrame:
    """Pieces of at most `size` characters, cut at the last blank line, line end or sentence end inside; a cut always
    advances. A sequential scan, so a vectorised function."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: boundary_cut(t or "", size))

    return df.select("*", F.posexplode(cut(F.col(text))).alias("chunk_index", "chunk")).drop(text)


def boundary_cut(text: str, size: int) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", ". "):
                found = text.rfind(mark, at, end)
                if found > at:
                    end = found + len(mark)
                    break
        out.append(text[at:end])
        at = max(end, at + 1)
    return out


def wrapped(c: Column, width: int = 80) -> Column:
    """every paragraph filled to a width."""

    @F.pandas_udf("string")
    def fill(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "\n\n".join(textwrap.fill(p.strip(), width) for p in t.split("\n\n") if p.strip()))

    return fill(c)


def title(text: Column, path: Column) -> Column:
    """A ``Title:`` line, else the first of ten lines longer than ten characters, else the stem."""
    lines = F.slice(F.split(text, "\n"), 1, 10)
    told = F.regexp_extract(text, r"(?im)^title:\s*(.+)$", 1)
    line = F.trim(F.get(F.filter(lines, lambda x: F.length(F.trim(x)) > 10), F.lit(0)))
    return F.when(told != "", F.trim(told)).otherwise(F.coalesce(line, stem(path)))


# Openings that a label loses, in order; then phrases after them.
LABEL_PREFIXES = ("Here is the topic label:", "Technical label:", "The label is:", "Label:", "Topic:", "Based on", "After analyzing", "Looking at")
LABEL_INTROS = ("is ", "would be ", "appears to be ", "seems to be ")
# Labels too general to be technical, and what makes a label technical.
GENERIC_LABELS = (
    "mixed research", "research topic", "topic cluster", "unknown topic", "various studies", "multiple topics", "diverse research",
    "general research", "biomedical research", "medical research", "scientific research", "research field", "research area",
    "research studies", "research applications", "biological studies", "medical studies", "clinical studies", "major research",
    "specialized research", "focused research", "advanced research", "fundamental research", "applied research",
    "experimental research", "theoretical research", "core research",
)
BROAD_LABELS = (
    "radiation research", "cancer research", "dna research", "cell research", "molecular research", "biological research",
    "medical research", "clinical research", "therapeutic research", "diagnostic research",
)
INDICATORS = (
    "dna", "rna", "protein", "gene", "cell", "molecular", "pathway", "mechanism", "receptor", "enzyme", "antibody", "treatment",
    "therapy", "disease", "cancer", "tumor", "radiation", "chemical", "biological", "clinical", "diagnosis", "biomarker",
    "signaling", "metabolism", "synthesis",
)
SPECIFIC = ("p53", "crispr", "mrna", "covid", "alzheimer", "parkinson")


def cleaned_label(c: Column) -> Column:
    """the first prefix that matches goes, then marks at the ends, then the first introductory phrase."""

    def without(x: Column, openings: tuple[str, ...]) -> Column:
        out, low = None, F.lower(x)
        for p in openings:
            rule, cut = low.startswith(p.lower()), F.trim(F.substring(x, F.lit(len(p) + 1), F.length(x)))
            out = F.when(rule, cut) if out is None else out.when(rule, cut)
        return out.otherwise(x)

    c = bound(c, lambda x: without(x, LABEL_PREFIXES))
    for mark in ('"', "'", ":", "*", "-"):
        c = F.regexp_replace(c, rf"^[{mark}]+|[{mark}]+$", "")
    return bound(F.trim(c), lambda x: without(x, LABEL_INTROS))


def is_technical_label(c: Column) -> Column:
    """P25: four characters or more, not general, at most six words, with a technical word; one such word alone among three
    words or fewer must be a specific term."""

    def any_of(x: Column, parts: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | x.contains(p)
        return out

    def judged(x: Column) -> Column:
        low = F.lower(x)
        w = words(low)
        n = F.size(F.filter(w, lambda v: any_of(v, INDICATORS)))
        fit = (F.length(x) >= 4) & ~any_of(low, GENERIC_LABELS + BROAD_LABELS) & (F.size(w) <= 6)
        return fit & bound(n, lambda k: (k > 0) & ~((k == 1) & (F.size(w) <= 3) & ~any_of(low, SPECIFIC)))

    return F.coalesce(bound(c, judged), F.lit(False))


def directory_description(name: Column, keywords: Column) -> Column:
    """a sentence of the first five keywords and one of the next five."""
    top, other = F.slice(keywords, 1, 5), F.slice(keywords, 6, 5)

    def listed(xs: Column) -> Column:
        return F.array_join(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), ", ")

    first = F.concat(F.lit("The "), name, F.lit(" directory contains documents primarily focused on "), listed(top), F.lit(" and "), F.element_at(top, -1), F.lit(". "))
    last = F.when(F.size(other) > 1, F.concat(F.lit(" and "), F.element_at(other, -1), F.lit("."))).otherwise(".")
    more = F.when(F.size(other) > 0, F.concat(F.lit("Other relevant topics include "), listed(other), last)).otherwise("")
    none = F.concat(F.lit("No meaningful keywords could be extracted from the "), name, F.lit(" directory."))
    return F.when(F.size(keywords) == 0, none).otherwise(F.concat(first, more))


def split_list(c: Column) -> Column:
    """a comma list, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def question_fields(response: Column) -> Column:
    """F32: struct of question_type, difficulty_level and question from line prefixes; without a question, the whole
    response as an advanced critical analysis."""

    def line(name: str) -> Column:
        return F.when(response.rlike(rf"(?m)^{name}:"), F.trim(F.regexp_extract(response, rf"(?m)^{name}:([^\n]*)", 1)))

    q = line("QUESTION")
    return F.struct(
        F.when(q.isNull(), "critical_analysis").otherwise(line("QUESTION_TYPE")).alias("question_type"),
        F.when(q.isNull(), "advanced").otherwise(line("DIFFICULTY")).alias("difficulty_level"),
        F.coalesce(q, F.trim(response)).alias("question"),
    )


def cleaned_answers(answers: Column) -> Column:
    """every answer of a list, cleaned."""
    return F.transform(answers, cleaned_answer)


# Openings that a model puts before a label (the first that matches goes), phrases after them, further
# openings that go in turn, and first words and openings of texts that are no label.
LONG_LABEL_PREFIXES = (
    "Here is the topic label:", "Here are the topic labels for each paper:", "Here are the topic labels:", "The topic labels are:", "Topic label:",
    "The topic label is:", "Based on the analysis:", "After analyzing:", "Based on these excerpts:", "After reviewing:", "Looking at these papers:",
    "From the excerpts:", "Analyzing these", "The common theme", "The main topic", "I would suggest", "I would label this", "This cluster represents",
    "These papers focus on", "The research focuses on", "Topic:", "Label:", "Research topic:", "Common theme:", "Main topic:", "Subject:", "Theme:",
    "Area:", "Field:",
)
LONG_LABEL_INTRO = ("is ", "would be ", "appears to be ", "seems to be ", "can be described as ")
LONG_LABEL_OPENINGS = ("focused on ", "related to ", "dealing with ")
NO_LABEL_WORDS = ("paper", "papers", "research", "studies", "analysis", "topic", "label", "theme")
NO_LABEL_OPENINGS = ("based", "after", "here", "the", "this", "these")


def bound(c: Column, f) -> Column:
    """f(c), with c evaluated once: an expression used many times would otherwise be copied into the plan as often."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _without_opening(c: Column, openings: tuple[str, ...]) -> Column:
    """c without the first of the openings that it has, in any case."""
    pattern = "(?i)^(?:" + "|".join(o.replace(".", r"\.") for o in sorted(openings, key=len, reverse=True)) + ")"
    return bound(c, lambda x: F.when(x.rlike(pattern), F.trim(F.regexp_replace(x, pattern, ""))).otherwise(x))


def long_label(response: Column, papers: Column, most: int = 50) -> Column:
    """F16: the label in a response's first line, cleaned, at most `most` characters; a text that is no label gives
    ``Research Topic n papers``."""
    c = _without_opening(F.split(F.trim(response), "\n")[0], LONG_LABEL_PREFIXES)
    for x in ('"', "'", ":", "*", "-", " "):
        c = F.btrim(c, F.lit(x))
    c = _without_opening(c, LONG_LABEL_INTRO)
    for o in LONG_LABEL_OPENINGS:
        c = _without_opening(c, (o,))
    none = F.concat(F.lit("Research Topic "), papers.cast("string"), F.lit(" papers"))

    def judged(x: Column) -> Column:
        low = F.lower(x)
        bad = low.rlike("^(?:" + "|".join(NO_LABEL_OPENINGS) + ")") | F.split(F.trim(low), r"\s+")[0].isin(*NO_LABEL_WORDS)
        return F.when((F.length(x) > 3) & ~bad, F.substring(x, 1, most)).otherwise(none)

    return bound(c, judged)


def remaining(done: Column, total: Column, seconds: Column, most: float = 86400.0) -> Column:
    """Seconds left at the pace so far, a day at most; null before anything is done."""
    return F.when(done > 0, F.least(F.lit(most), seconds / done * (total - done)))
