"""Best-fit packing by a configuration linear program over the length histogram.

1. Texts are tokenised once, in one pass; each piece becomes a slim row (length and checksum, no ids).
2. The histogram of piece lengths (at most ``capacity`` entries, whatever the input) goes to the driver. The fractional
   program - cover every length class by patterns that fit a sequence - is solved by multiplicative weights, whose
   pricing step is an unbounded knapsack by dynamic programming over token capacity.
3. Rounding: whole multiples of the patterns, then single ones by fractional part, as far as pieces are left; what
   a pattern's last place takes the longest piece that fits; what remains goes best-fit-decreasing into the gaps and new sequences, still on the histogram.
4. Every piece gets its rank among pieces of its length from counts by task (no task sees a whole length, so a length
   shared by a third of all pieces is no hot group), and the plan's table of rank ranges gives sequence and offset.

Defined results: a null or empty text is one piece holding the end id alone; a null doc_id stays null; repeated rows are
packed one by one; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.scratch import TEXTS, Scratch
from scholia.llm.textblock import blocks

CAPACITY = 2048
END_ID = 0
CLASS_WIDTH = 8
#: The added token of byte_bpe_50k.json, which its library finds inside texts.
ADDED = {"<|endoftext|>": 50256}
EPSILON = 0.1
ROUNDS = 1500
#: Part of the fractional solution that is rounded as patterns; the rest of the histogram fills gaps best-fit.
SHARE = 0.8
SLACK = 2


@cache
def tokenizer(name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level BPE of byte_bpe_50k.json; the same vocabulary as ranks gives the same ids about eight times faster (tested)."""
    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path(name), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def encode(text: str) -> list[int]:
    """The ids of byte_bpe_50k.json; encode_ordinary() of the tokenizer takes the added token for plain text."""
    return tokenizer().encode(text, allowed_special="all")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; and the task with the piece's number among that
    task's pieces of its length, which a retried task repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch, _ in blocks(batches):
            out = []
            done: dict[str, list] = {}
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t = t.as_py()
                if (rows := done.get(t)) is None:
                    ids = np.array([*encode(t), END_ID], "<u4")
                    rows = [(k, start, n, zlib.crc32(ids[start : start + n].tobytes())) for k, (start, n) in enumerate(cut(len(ids), capacity))]
                    done[t] = rows
                out += [(doc, *r) for r in rows]
            cols = list(zip(*out, strict=True))
            nth = []
            for n in cols[3]:
                nth.append(seen[n])
                seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array(nth, pa.int64()), pa.array([task] * len(nth), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


def price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern (copies by class) of most value within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size)
    size, value = size[order], value[order]
    upto = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            got = best[c - size[: upto[c]]] + value[: upto[c]]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], pick[c] = got[k], k
    copies, c = np.zeros(len(size), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            copies[order[pick[c]]] += 1
            c -= size[pick[c]]
    return float(best[capacity]), copies


def fractional(need: np.ndarray, size: np.ndarray, capacity: int, epsilon: float = EPSILON, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Pattern weights x with sum_p a[p][l] * x[p] >= need[l]: multiplicative weights over the length classes."""
    weight = np.ones(len(need))
    x: dict[tuple[int, ...], float] = defaultdict(float)
    covered = np.zeros(len(need))
    for _ in range(rounds):
        if covered.min() >= np.log(len(need) + 2) / epsilon:
            break
        _, a = price(weight / need, size, capacity)
        used = np.flatnonzero(a)
        step = float((need[used] / a[used]).min())
        x[tuple(np.repeat(used, a[used]))] += step
        gain = a[used] * step / need[used]
        covered[used] += gain
        weight[used] *= (1 - epsilon) ** gain
        weight /= weight.max()
    scale = np.median(covered[covered > 0]) if len(covered) else 1.0
    return {p: v / scale for p, v in x.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = CLASS_WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences as (how many, piece lengths in order). Every piece of the histogram is used exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    full = [(int(left[capacity]), (capacity,))] if left[capacity] else []
    left[capacity] = 0
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return full
    # classes of lengths, each as large as its longest member; sizes in units of `width` tokens
    of = -(-lengths // width)
    units = np.unique(of)
    need = np.array([left[lengths[of == u]].sum() for u in units], float)
    x = fractional(need, units, capacity // width)
    made: list[tuple[int, list[int]]] = []

    def longest(low: int, high: int, run: int) -> int:
        """The longest length in (low, high] of which `run` pieces are left."""
        found = np.flatnonzero(left[low + 1 : high + 1] >= run)
        return low + 1 + int(found[-1]) if len(found) else 0

    def take(pattern: tuple[int, ...], most: int) -> None:
        """Up to `most` sequences of this pattern, in runs of equal lengths; the last place takes the longest piece that fits."""
        classes = sorted((int(units[k]) for k in pattern), reverse=True)
        while most > 0:
            run, chosen, room = most, [], capacity
            for u in classes[:-1]:
                length = longest((u - 1) * width, u * width, 1)
                if not length:
                    break
                chosen.append(length)
                left[length] -= 1
                room -= length
            length = longest(0, room, 1) if len(chosen) == len(classes) - 1 else 0
            for k in chosen:
                left[k] += 1
            if not length:
                return
            chosen.append(length)
            for k in set(chosen):
                run = min(run, int(left[k]) // chosen.count(k))
            for k in chosen:
                left[k] -= run
            made.append((run, chosen))
            most -= run

    for p, v in sorted(x.items(), key=lambda kv: -kv[1]):
        take(p, int(SHARE * v))
    for p, v in sorted(x.items(), key=lambda kv: -(SHARE * kv[1] % 1)):
        if SHARE * v % 1 >= 0.5:
            take(p, 1)
    for n, lengths in made:
        if capacity - sum(lengths) > SLACK:  # a pattern that came out worse than its class sizes promised is dissolved
            for k in lengths:
                left[k] += n
    made = [m for m in made if capacity - sum(m[1]) <= SLACK]
    return full + _best_fit(made, left, capacity)


def _best_fit(made: list[tuple[int, list[int]]], rest: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """The rest of the histogram, longest first, each into the fullest sequence that has room."""
    gaps: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n, lengths in made:
        gaps[capacity - sum(lengths)].append((n, lengths))
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        for gap in range(length, capacity):
            while n and gaps.get(gap):
                m, lengths = gaps[gap].pop()
                fit = gap // length
                run = min(m, n // fit)
                if run == 0:
                    run, fit = 1, n
                if run < m:
                    gaps[gap].append((m - run, lengths))
                gaps[gap - fit * length].append((run, lengths + [length] * fit))
                n -= run * fit
            if not n:
                break
        if n:
            fit = capacity // length
            if n // fit:
                gaps[capacity - fit * length].append((n // fit, [length] * fit))
            if n % fit:
                gaps[capacity - n % fit * length].append((1, [length] * (n % fit)))
    return [(n, tuple(lengths)) for groups in gaps.values() for n, lengths in groups]


def ranges(sequences: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """For each length, ranges of ranks: rank r in [first, first + n * copies) is in sequence
    base + (r - first) // copies, at offset + (r - first) % copies * length."""
    rows, used, base = [], defaultdict(int), 0
    for n, lengths in sequences:
        at = 0
        for length, copies in _runs(lengths):
            rows.append((length, used[length], used[length] + n * copies, base, copies, at))
            used[length] += n * copies
            at += copies * length
        base += n
    return pd.DataFrame(rows, columns=["length", "first", "end", "base", "copies", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def _runs(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    out: dict[int, int] = defaultdict(int)
    for x in lengths:
        out[x] += 1
    return list(out.items())


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Every piece with sequence_id and offset."""
    spark = docs.sparkSession
    s = Scratch(spark, "packing")
    rows = s.keep(pieces(docs, capacity, text), "pieces", TEXTS)
    counts = s.keep(rows.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = ranges(plan(histogram, capacity))
    key = (table["length"].to_numpy() << 44) + table["first"].to_numpy()
    shared = spark.sparkContext.broadcast((key, *(table[k].to_numpy() for k in ("length", "first", "base", "copies", "offset"))))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = s.keep(counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("rank0")), "starts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, _, first, base, copies, offset = shared.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            r = rank - first[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            cols = [b.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(base[at] + r // copies[at]), pa.array(offset[at] + r % copies[at] * length)], names=[*names, "sequence_id", "offset"])

    ranked = rows.join(starts, ["task", "length"]).withColumn("rank", F.col("rank0") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return s.sweep(ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
