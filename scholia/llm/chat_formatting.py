"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation becomes one string; each turn is ``<|im_start|>`` + mark + role + newline + text + ``<|im_end|>`` + newline.
The mark is empty, or ``\\`` where the turn is escaped. The grammar allows ``<|`` nowhere but in the template, a newline
in no role, and ``\\`` at the start of no unescaped role. Escaping maps ``\\`` to ``\\\\``, ``<|`` to ``<\\|`` and, in
roles, newline to ``\\n``; it is undone exactly.

Rendering is tried with no escapes, then with those turns escaped which the grammar rejects, then with all turns escaped,
until the parser gives back the source turns.

Defined results: null role or text counts as empty; turns are ordered by turn (null first), then role and text, so ties and
repeated rows have one order; rows with a null conv_id form one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _lit(s: str) -> Column:
    return F.lit(s)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, _lit("\\"), _lit("\\\\")), _lit("<|"), _lit("<\\|"))


def unescape(c: Column) -> Column:
    # an escaped backslash is set aside while the other escapes are undone
    parts = F.split(c, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, _lit("<\\|"), _lit("<|")), _lit("\\n"), _lit("\n")))
    return F.array_join(plain, "\\")


def _conflicts(t: Column) -> Column:
    role, text = t["role"], t["text"]
    return role.contains("<|") | text.contains("<|") | role.contains("\n") | role.startswith("\\")


def render_turn(t: Column, escaped: Column) -> Column:
    role = F.replace(escape(t["role"]), _lit("\n"), _lit("\\n"))
    hard = F.concat(_lit(START + "\\"), role, _lit("\n"), escape(t["text"]), _lit(END + "\n"))
    return F.when(escaped, hard).otherwise(F.concat(_lit(START), t["role"], _lit("\n"), t["text"], _lit(END + "\n")))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation; null where the grammar rejects it."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    tail = END + "\n"

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(1), F.length(p) - len(tail))
        cut = F.instr(body, "\n")
        ok = p.endswith(tail) & ~body.contains("<|") & (cut > 0)
        role = F.substring(body, F.lit(1), cut - 1)
        text = F.substring(body, cut + 1, F.length(body))
        hard = role.startswith("\\")
        role, text = F.when(hard, unescape(F.substring(role, F.lit(2), F.length(role)))).otherwise(role), F.when(hard, unescape(text)).otherwise(text)
        return F.when(ok, F.struct(role.alias("role"), text.alias("text")))

    turns = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    good = (F.element_at(pieces, 1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(good, turns)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (source), formatted, escapes (0 none, 1 conflicting turns, 2 all), parsed, and mask: the spans
    (start, length in characters of formatted) of assistant text under the loss."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = convs.select("conv_id", source.alias("turns"))

    def rendered(level: int) -> Column:
        esc = (lambda t: F.lit(False), _conflicts, lambda t: F.lit(True))[level]
        return F.array_join(F.transform("turns", lambda t: render_turn(t, esc(t))), "")

    same = [F.coalesce(parse(rendered(k)) == F.col("turns"), F.lit(False)) for k in (0, 1)]
    convs = convs.withColumn("escapes", F.when(same[0], 0).when(same[1], 1).otherwise(2))
    convs = convs.withColumn("formatted", F.when(F.col("escapes") == 0, rendered(0)).when(F.col("escapes") == 1, rendered(1)).otherwise(rendered(2)))
    convs = convs.withColumn("parsed", parse(F.col("formatted")))
    return convs.withColumn("mask", _mask(F.col("formatted")))


def _mask(formatted: Column) -> Column:
    """Spans of assistant text, found in the output by its own markers."""
    pieces = F.transform(F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>"))), lambda p: F.struct(F.length(p).alias("n"), F.instr(p, "\n").alias("head"), F.substring_index(p, "\n", 1).alias("role")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint,escaped:boolean>>)").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + len(START) + p["head"]).cast("long").alias("start"), (p["n"] - p["head"] - len(END) - 1).cast("long").alias("length"), p["role"].startswith("\\").alias("escaped"))
        found = F.when(p["role"].isin("assistant", "\\assistant"), F.array_append(acc["found"], span)).otherwise(acc["found"])
        return F.struct((acc["at"] + len(START) + p["n"]).cast("long").alias("at"), found.alias("found"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["found"])


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""

    def text(m: Column) -> Column:
        raw = F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))
        return F.when(m["escaped"], unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(mask, text), "")
