"""Conversation structure repair by signatures: audits are solved once for each distinct sequence of roles and faults.

1. Rows in order of turn (nulls first; rows of one turn by role, then by the SHA-256 of their text) are told apart only by
   the role's initial and the first fault: blank (no character outside ``[\\x20\\x09-\\x0D]``), duplicate (role and text
   seen earlier in the conversation) or truncated (the last such character is none of ``.!?``). Equal rows of one turn are
   counted before anything is shuffled by conversation, and the first place of a role and text is a minimum with partial
   sums, so a conversation or a text with a third of all rows is no hot group there.
2. A conversation's signature is a string of one letter a row (see LETTERS). Rows are ranged by conversation and place, so
   a long conversation lies in many tasks, of which each writes its fragment; fragments in order make the signature.
3. Each distinct signature is solved once: a table of least costs by (row, last initial kept), filled from the last row.
   Of one state the possible edits have different initials and each leads to one state (what is inserted or given a new
   role must be the one initial that may follow), so the ASCII-least of the cheapest audits takes the least initial that
   keeps the cost, place by place.
4. Audits are joined back to their conversations and replayed over the rows, which stream by in order: a task holds one
   batch of rows and one audit, whatever the conversation's length. SHA-256 is one chain over a conversation's text, so the
   rows which may stay in one conversation meet in one task; rows that any audit deletes are not sent.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert an empty user or
assistant row 3; a truncated row that is not deleted adds 3. The roles that remain read ``(s?(ua)+)?``.

Defined results: a null in role or text is one space; a role's initial is its first character, in lower case s, u or a
or none of them (an empty role, too); a null conv_id is a conversation of its own; a conversation without rows has counts of
0, no audit and the hash of the empty string; empty tables give empty tables; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.scratch import TEXTS, Scratch, parts

#: A signature's letters by initial (user, assistant, system, other): sound, truncated, blank and duplicate rows.
LETTERS = {"sound": "uaso", "truncated": "UASO", "blank": "1234", "duplicate": "5678"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
_ROW = {x: (initial, fault) for fault, row in LETTERS.items() for initial, x in zip("uaso", row, strict=True)}
_ROLE = {"u": "user", "a": "assistant"}
#: What may follow a state (the last initial kept; E at the beginning), apart from s after E.
_NEXT = {"E": "u", "s": "u", "u": "a", "a": "u"}
_STATES = "Esua"
_FAR = 1 << 60
#: The place of a null turn, which no turn has.
_BEFORE = -(2**63) - 1


def least_costs(signature: str) -> list[dict[str, int]]:
    """For each row (and the end), the least cost of all edits from there on, by state."""
    table: list[dict[str, int]] = [{}] * (len(signature) + 1)
    for k in range(len(signature), -1, -1):
        if k == len(signature):
            base = {"E": 0, "a": 0, "s": _FAR, "u": _FAR}
        else:
            initial, fault = _ROW[signature[k]]
            later, more = table[k + 1], CUT if fault == "truncated" else 0
            base = {q: DELETE + later[q] for q in _STATES}
            if fault in ("sound", "truncated"):
                for q in _STATES:
                    base[q] = min(base[q], REROLE + more + later[_NEXT[q]])
                    if initial == _NEXT[q] or (q == "E" and initial == "s"):
                        base[q] = min(base[q], KEEP + more + later[initial])
        # inserted rows: from a state to the one that may follow it, at most round the circle of u and a
        for _ in range(3):
            base = {q: min(base[q], INSERT + base[_NEXT[q]]) for q in _STATES}
        table[k] = base
    return table


def solve(signature: str) -> tuple[int, str]:
    """The least cost, and the ASCII-least of the audits of that cost."""
    table = least_costs(signature)
    k, state, audit = 0, "E", []
    left = cost = table[0]["E"]
    while k < len(signature) or left:
        initial, fault = _ROW[signature[k]] if k < len(signature) else ("", "blank")
        more = CUT if fault == "truncated" else 0
        if k < len(signature) and left == DELETE + table[k + 1][state]:
            audit.append("D")
            k, left = k + 1, left - DELETE
        elif left == INSERT + table[k][_NEXT[state]]:
            audit.append("I")
            state, left = _NEXT[state], left - INSERT
        elif fault != "blank" and fault != "duplicate" and (initial == _NEXT[state] or (state == "E" and initial == "s")) and left == more + table[k + 1][initial]:
            audit.append("K")
            k, state, left = k + 1, initial, left - more
        else:
            audit.append("R")
            k, state, left = k + 1, _NEXT[state], left - REROLE - more
    return cost, "".join(audit)


def counted(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials may not follow each other."""
    faults = [sum(signature.count(x) for x in LETTERS[f]) for f in ("blank", "duplicate", "truncated")]
    initials = "".join(_ROW[x][0] for x in signature)
    return (*faults, max(0, len(initials) - 1) - sum(initials[k : k + 2] in ("su", "ua", "au") for k in range(len(initials) - 1)))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows as a fixed rule damages them, by crc32(`conv_id:turn`) mod 20: 0 drops a row,
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. A null counts as one space."""
    space = F.lit(" ")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    df = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    df = df.where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return df.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one_")).drop("one_")


def _letters(initial: Column, fault: Column) -> Column:
    """A row's letter; initial 1 to 4 (user, assistant, system, other), fault 1 to 4 in the order of LETTERS."""
    return F.substring(F.lit("".join(LETTERS.values())), (4 * (fault - 1) + initial).cast("int"), F.lit(1))


def _joined(rows: DataFrame, s: Scratch) -> DataFrame:
    """conv_id, signature of every conversation that has rows, and gaps."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id")
            known = np.asarray(conv.is_valid())
            value = conv.fill_null(0).to_numpy()
            cut = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (known[1:] != known[:-1])))
            letters, n = b.column("letter").to_pylist(), b.column("n").to_pylist()
            told = [x * k for x, k in zip(letters, n, strict=True)]
            ends = np.append(cut[1:], b.num_rows)
            first = pa.array(cut)
            yield pa.RecordBatch.from_arrays([conv.take(first), *(b.column(c).take(first) for c in ("nth", "key", "role", "th")), pa.array(["".join(told[a:z]) for a, z in zip(cut, ends, strict=True)])], names=["conv_id", "nth", "key", "role", "th", "letters"])

    ordered = rows.repartitionByRange(parts(s.spark), "conv_id", "key", "role", "th").sortWithinPartitions("conv_id", "key", "role", "th", "nth")
    made = ordered.mapInArrow(fragments, "conv_id long, nth int, key decimal(20,0), role string, th string, letters string")
    # a batch of rows is one fragment at most of a conversation: few fragments, each of one letter a row
    part = F.struct("key", "role", "th", "nth", "letters")
    return made.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["letters"]), "").alias("signature"))


def _solved(signatures: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [(x, *counted(x), *solve(x)) for x in b.column("signature").to_pylist()]
            cols = list(zip(*told, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.string())], names=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return signatures.mapInArrow(run, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Replay:
    """The edits of one conversation, applied to its rows as they come; only rows that may stay come."""

    def __init__(self, signature: str, audit: str):
        self.signature, self.audit, self.at, self.row, self.state, self.first = signature, audit, 0, 0, "E", True
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode())
        self.first = False

    def _inserts(self) -> None:
        """Rows to insert and rows to delete that do not come."""
        while self.at < len(self.audit):
            if self.audit[self.at] == "I":
                self.state = _NEXT[self.state]
                self._put(_ROLE[self.state], "")
            elif self.audit[self.at] == "D" and _ROW[self.signature[self.row]][1] in ("blank", "duplicate"):
                self.row += 1
            else:
                return
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit, initial = self.audit[self.at], _ROW[self.signature[self.row]][0]
        self.at, self.row = self.at + 1, self.row + 1
        if edit != "D":
            self.state = initial if edit == "K" else _NEXT[self.state]
            self._put(role if edit == "K" else _ROLE[self.state], text)

    def end(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation: its audit, then its rows in order."""
    conv, now = None, None
    told = lambda: pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([now.end()])], names=["conv_id", "repaired_sha256"])
    out: list[tuple] = []
    for b in batches:
        for c, kind, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text")), strict=True):
            if kind == 0:
                if now:
                    out.append((conv, now.end()))
                conv, now = c, _Replay(role, text)
            else:
                now.add(role, text)
        if out:
            ids, hashes = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes)], names=["conv_id", "repaired_sha256"])
            out = []
    if now:
        yield told()


def repair(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, signature and repaired_sha256 (of the repaired
    ``role:text``, joined by newlines) of the conversations of rows (conv_id, turn, role, text), and of those that only
    `every` (conv_id) has."""
    spark = rows.sparkSession
    s = Scratch(spark, "repair")
    space = F.lit(" ")
    df = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    # nulls first, and no turn is equal to null
    key = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.expr(f"cast({_BEFORE}BD as decimal(20,0))"))
    last = F.right(F.btrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(last == "", 3).when(last.isin(".", "!", "?"), 1).otherwise(2)
    initial = F.when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).when(F.col("role").startswith("s"), 3).otherwise(4)
    df = df.withColumns({"key": key, "th": F.sha2("text", 256), "fault": fault, "initial": initial})
    # equal rows of a turn are one line with a count
    lines = s.keep(df.groupBy("conv_id", "key", "role", "th").agg(F.count("*").cast("int").alias("n"), F.first("fault").alias("fault"), F.first("initial").alias("initial")), "lines")
    firsts = s.keep(lines.where("fault <> 3").groupBy("conv_id", "role", "th").agg(F.min("key").alias("first")), "firsts")
    same = lines["conv_id"].eqNullSafe(firsts["conv_id"]) & (lines["role"] == firsts["role"]) & (lines["th"] == firsts["th"])
    marked = lines.join(firsts, same, "left").select(lines["conv_id"], lines["role"], lines["th"], "key", "n", "initial", F.when(F.col("first") < F.col("key"), 4).otherwise(F.col("fault")).alias("fault"))
    # the first of equal rows is what it is; the others of its turn repeat it
    sound = marked.select("conv_id", "key", "role", "th", F.lit(0).alias("nth"), F.when(F.col("fault").isin(3, 4), F.col("n")).otherwise(1).alias("n"), _letters(F.col("initial"), F.col("fault")).alias("letter"))
    again = marked.where("n > 1 and fault < 3").select("conv_id", "key", "role", "th", F.lit(1).alias("nth"), (F.col("n") - 1).alias("n"), _letters(F.col("initial"), F.lit(4)).alias("letter"))
    signed = s.keep(_joined(s.keep(sound.unionByName(again), "letters"), s), "signatures")
    solved = s.keep(_solved(signed.select("signature").distinct()), "solved")
    done = s.keep(signed.join(solved, "signature"), "audits")
    # the rows that may stay, each once, with their place; then the audits over them
    stay = df.where("fault <> 3").groupBy("conv_id", "role", "text").agg(F.min("key").alias("key"), F.min("th").alias("th"))
    sent = stay.select("conv_id", F.lit(1).alias("kind"), "key", "role", "th", "text")
    first = done.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("decimal(20,0)").alias("key"), F.col("signature").alias("role"), F.lit(None).cast("string").alias("th"), F.col("audit").alias("text"))
    stream = first.union(sent).repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "kind", "key", "role", "th")
    hashed = s.keep(stream.select("conv_id", "kind", "role", "text").mapInArrow(_replayed, "conv_id long, repaired_sha256 string"), "hashes", TEXTS)
    turns = s.keep(lines.groupBy("conv_id", "key").agg(F.lit(1).alias("one")).where(f"key > {_BEFORE}BD").groupBy("conv_id").agg((F.max("key") - F.min("key") + 1 - F.count("*")).cast("long").alias("gaps")), "gaps")
    ids = df.select("conv_id") if every is None else df.select("conv_id").union(every.select(F.col("conv_id").cast("long")))
    # a null conversation is joined, too
    out = ids.groupBy(F.coalesce(F.col("conv_id"), F.lit(0)).alias("id_"), F.col("conv_id").isNull().alias("null_")).agg(F.lit(1).alias("one_"))
    for t in (turns, done, hashed):
        keyed = t.withColumns({"id_": F.coalesce(F.col("conv_id"), F.lit(0)), "null_": F.col("conv_id").isNull()}).drop("conv_id")
        out = out.join(keyed, ["id_", "null_"], "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    numbers = [F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    told = out.select(F.when(~F.col("null_"), F.col("id_")).alias("conv_id"), *numbers, F.coalesce("audit", none).alias("audit"), F.coalesce("signature", none).alias("signature"), F.coalesce("repaired_sha256", F.sha2(none, 256)).alias("repaired_sha256"))
    return s.sweep(told)
