"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne's scheme).

Counting: every training token and pair of neighbours is counted, in 64 bits. Tasks sum what they see, deal sorted runs of
(hash, count) by hash range, and each range is merged apart; no count is sampled and no word is a hot group. There are as many
ranges as leave about RANGE_BYTES of the table to each, so a range stays small however large the table is.

Filter: a count c is quantised to level q = 1 + floor(log(c / least) / log(BASE)), and the events (n-gram, 1), ...,
(n-gram, q) are set. The filter has a segment for each range of hashes, so segments are built apart and only
their bits meet. Words and pairs are stored from count 1, and the bits follow the number of events
(BITS_PER_EVENT) without a ceiling. A count is read back by probing levels until one is missing. A filter of at most
2 ** MAX_BITS bits is gathered by the driver and broadcast. A larger one stays a table: every block sends its distinct
n-grams to their segments and gets the levels back, which gives the same scores at any size.

Model: P(w | u) = k * c(u, w) / c(u) + (1 - k) * (c(w) + 1) / (N + V + 1), with counts from probes, u the word before (or
the beginning), and a weight k for each level of c(u) that maximises the left-one-out likelihood of all training tokens.

base_score needs exact counts: those of the TOP most common words are broadcast; other words are dealt by hash to the ranges
that hold their counts, and the sums go back to their texts.

Defined results: a null or empty text is the end token alone; held-out rows and rows with a null doc_id (held out: false)
are scored like others; with no training rows N = V = 0; empty tables give empty tables; repeated rows count and are scored
one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.scratch import TEXTS, Scratch, parts
from scholia.llm.textblock import Block, blocks, mix, spans

BASE = 1.5
PROBES = 4
#: Ranges of hashes: LEAST_RANGES at least, more as the table grows, MOST_RANGES at most (then ranges grow).
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 8 << 20, 256, 1 << 22
#: The largest filter that is broadcast: 128 MB in each Python worker.
MAX_BITS = 30
BITS_PER_EVENT = 12
TOP = 1 << 18
FLUSH = 1 << 20
WEIGHTS = np.array([0.0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
LEVELS = 64

_END = mix(np.array([0xE17A1465], np.uint64))[0]
_LOW = np.uint64(2**32 - 1)
_BEGIN = mix(np.array([0x94D049BB], np.uint64))[0]


def held_out(doc_id: Column, every: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(every)) == part, F.lit(False))


def token_hashes(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, and hash with the one before, of every token; each row ends with the end token."""
    low = b.lowered()
    starts, ends = low.words()
    row = low.row_of(starts)
    h = spans(low.prefix(), starts, ends)
    n = np.bincount(row, minlength=b.n) + 1
    last = np.cumsum(n) - 1
    out = np.empty(n.sum(), np.uint64)
    word = np.ones(len(out), bool)
    word[last] = False
    out[word], out[last] = h, _END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[last - n + 1] = _BEGIN
    return np.repeat(np.arange(b.n), n), out, before


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def _runs(h: np.ndarray, c: np.ndarray, kind: int, shift: int, width: str = "<u4") -> list[tuple[int, int, bytes, bytes]]:
    """Rows (range, kind, hashes, counts) of sorted distinct hashes; a task's counts before a flush fit in 32 bits."""
    if not len(h):
        return []
    part = (h >> np.uint64(shift)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return [(int(part[a]), kind, h[a:z].tobytes(), c[a:z].astype(width).tobytes()) for a, z in zip(cut, np.append(cut[1:], len(h)), strict=True)]


_RUN = "part int, kind int, h binary, c binary"


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["part", "kind", "h", "c"])


def ranges(size: int, tasks: int) -> int:
    """Ranges of hashes, a power of two, for texts of `size` bytes."""
    wanted = min(MOST_RANGES, max(LEAST_RANGES, 2 * tasks, size // RANGE_BYTES))
    return 1 << (wanted - 1).bit_length()


def counts(texts: DataFrame, s: Scratch, size: int) -> tuple[DataFrame, int]:
    """Runs (part, kind, h, c): merged counts of words (kind 1) and of pairs (kind 2) by range of hashes; and the shift that
    gives a hash's range. `size`: the bytes of the texts."""
    shift = 65 - ranges(size, parts(s.spark)).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind in (1, 2):
                if held[kind - 1]:
                    h, c = np.unique(np.concatenate(held[kind - 1]), return_counts=True)
                    held[kind - 1].clear()
                    rows += _runs(h, c, kind, shift)
            return _run_batch(rows)

        for _, b in blocks(batches):
            row, h, before = token_hashes(b)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            held[0] += [h, before[first]]
            held[1].append(pair(before, h))
            size += len(h)
            if size >= FLUSH:
                yield flush()
                size = 0
        yield flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = []
        kinds = table.column("kind").to_numpy()
        for kind in (1, 2):
            mine = table.filter(pa.array(kinds == kind))
            h = np.frombuffer(b"".join(mine.column("h").to_pylist()), np.uint64)
            c = np.frombuffer(b"".join(mine.column("c").to_pylist()), "<u4").astype(np.int64)
            if len(h):
                order = np.argsort(h, kind="stable")
                h, c = h[order], c[order]
                cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                rows.append((int(table.column("part")[0].as_py()), kind, h[cut].tobytes(), np.add.reduceat(c, cut).astype("<i8").tobytes()))
        return pa.Table.from_batches([_run_batch(rows)])

    seen = texts.select("text").mapInArrow(count, _RUN)
    return s.keep(seen.groupBy("part").applyInArrow(merge, _RUN), "counts", TEXTS), shift


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        for part, kind, h, c in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("h"), b.column("c"), strict=True):
            yield part, kind, np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), "<i8")


def _bin(c: np.ndarray) -> np.ndarray:
    return np.floor(16 * np.log2(c)).astype(np.int64)


def level(c: np.ndarray, least: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        q = 1 + np.floor(np.log(np.maximum(c, 1) / least) / np.log(BASE) + 1e-9)
    return np.where(c >= least, np.minimum(q, LEVELS - 1), 0).astype(np.int64)


def values(least: int) -> np.ndarray:
    """The mean of the whole counts of each level; 0 for level 0."""
    out = [0.0]
    for q in range(1, LEVELS):
        low, high = least * BASE ** (q - 1), least * BASE**q
        a, z = np.ceil(low - 1e-6), np.ceil(high - 1e-6) - 1
        out.append(float((a + z) / 2 if z >= a else low))
    return np.array(out)


def _probes(h: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the n-grams' probes at a level, 32 bits each."""
    x = mix(h + np.uint64(q * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return x >> np.uint64(32), (x & _LOW) | np.uint64(1)


def _place(start: np.ndarray, step: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Places in a segment of `size` bits (below 2 ** 32)."""
    return (((start + np.uint64(probe) * step) & _LOW) * np.uint64(size)) >> np.uint64(32)


class Filter:
    """The words of the bit array of all segments of `size` bits (named by the bits of a hash above `shift`), or of one of
    them, for n-grams of that segment alone."""

    def __init__(self, words: np.ndarray, size: int, shift: int):
        self.words, self.size, self.shift, self.whole = words, size, np.uint64(shift), 64 * len(words) > size

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level of each n-gram whose probes, and those of all levels below, are set."""
        out = np.zeros(len(h), np.int64)
        at = np.arange(len(h))
        for q in range(1, LEVELS):
            g = h[at]
            first = (g >> self.shift) * np.uint64(self.size if self.whole else 0)
            start, step = _probes(g, q)
            for probe in range(PROBES):
                p = _place(start, step, probe, self.size) + first
                on = (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
                if not on.all():
                    at, start, step, first = at[on], start[on], step[on], first[on]
            if not len(at):
                break
            out[at] = q
        return out


def segment_size(counted: DataFrame, shift: int) -> int:
    """The bits of a segment of the filter, a multiple of 64: they follow the number of events, without a ceiling."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, c in _arrays(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int(level(c, 1).sum())])], names=["n"])

    events = counted.mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0
    return max(256, 64 * -(-events * BITS_PER_EVENT // (64 << (64 - shift))))


def segments(counted: DataFrame, size: int) -> DataFrame:
    """Rows (segment, bits); a segment may have several rows, to be united."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(0, np.uint8)
        told = lambda: pa.RecordBatch.from_pydict({"segment": [now], "bits": [bits.tobytes()]}, pa.schema([("segment", pa.int32()), ("bits", pa.binary())]))
        for part, _, h, c in _arrays(batches):
            if not len(h):
                continue
            if part != now:
                if now is not None:
                    yield told()
                now, bits = part, np.zeros(size // 8, np.uint8)
            q = level(c, 1)
            flag = np.zeros(size, np.uint8)
            for k in range(1, int(q.max()) + 1):
                start, step = _probes(h[q >= k], k)
                for probe in range(PROBES):
                    flag[_place(start, step, probe, size)] = 1
            bits |= np.packbits(flag, bitorder="little")
        if now is not None:
            yield told()

    return counted.mapInArrow(segment, "segment int, bits binary")


def build_filter(made: DataFrame, size: int, shift: int) -> Filter:
    """The whole filter on the driver, to be broadcast: a row of `size` bits a segment."""
    out = np.zeros((1 << (64 - shift), size // 8), np.uint8)
    for r in made.toLocalIterator():
        out[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(out.reshape(-1).view("<u8"), size, shift)


def _rows(lengths: np.ndarray, training: np.ndarray) -> bytes:
    return (2 * lengths + training).astype("<i8").tobytes()


def _levels(block: int, rows: bytes, levels: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """The levels of a block's tokens (kind 6), one byte each for the word, the one before it, and both."""
    cols = [pa.array([6], pa.int32()), pa.array([block], pa.int64()), *(pa.nulls(1, t) for t in _TYPES[2:8])]
    return pa.RecordBatch.from_arrays([*cols, pa.array([b"".join(q.astype(np.uint8).tobytes() for q in levels)], pa.binary()), pa.array([rows], pa.binary())], names=_NAMES)


def _asks(block: int, doc_rows: bytes, h: np.ndarray, before: np.ndarray, shift: int) -> pa.RecordBatch:
    """What a block sends to the segments: its distinct n-grams by segment (kind 5), and what its tokens need of the answers (kind 4)."""
    both, code = np.unique(np.concatenate((h, [_BEGIN], pair(before, h))), return_inverse=True)
    runs = _runs(both, np.zeros(len(both)), 5, shift)
    rows = [(4, None, code.astype("<u4").tobytes(), doc_rows), *((5, r[0], r[2], None) for r in runs)]
    kind, part, hashes, rest = zip(*rows, strict=True)
    cols = [pa.array(kind, pa.int32()), pa.array([block] * len(rows), pa.int64()), *(pa.nulls(len(rows), t) for t in _TYPES[2:7])]
    return pa.RecordBatch.from_arrays([*cols, pa.array(part, pa.int32()), pa.array(hashes, pa.binary()), pa.array(rest, pa.binary())], names=_NAMES)


def routed_levels(out: DataFrame, made: DataFrame, size: int, shift: int) -> DataFrame:
    """One row (rid, rows, levels) a block with the levels of its tokens, when the filter is too large to
    broadcast: n-grams go to their segment, a task holding one segment at a time, and the levels come back to the block."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, np.zeros(0, np.uint8)
        for b in batches:
            held: list[tuple[int, np.ndarray]] = []
            told: list[tuple[int, int, bytes]] = []

            def settle(part: int, held: list, told: list) -> None:
                if held:
                    q = Filter(words.view("<u8"), size, shift).levels(np.concatenate([h for _, h in held])).astype(np.uint8)
                    ends = np.cumsum([len(h) for _, h in held])
                    told += [(rid, part, q[z - len(h) : z].tobytes()) for (rid, h), z in zip(held, ends, strict=True)]
                    held.clear()

            for part, kind, rid, h in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("rid").to_pylist(), b.column("h"), strict=True):
                if part != now:
                    settle(now, held, told)
                    now, words = part, np.zeros(size // 8, np.uint8)
                if kind == 0:
                    words |= np.frombuffer(h.as_py(), np.uint8)
                else:
                    held.append((rid, np.frombuffer(h.as_py(), np.uint64)))
            settle(now, held, told)
            rids, parts_, levels = zip(*told, strict=True) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(parts_, pa.int32()), pa.array(levels, pa.binary())], names=["rid", "part", "h"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, code, rows, levels = None, np.zeros(0, "<u4"), b"", []

        def block() -> pa.RecordBatch:
            q = np.frombuffer(b"".join(levels), np.uint8)[code]
            n = len(code) // 2
            lengths = np.frombuffer(rows, "<i8") >> 1
            context = np.empty(n, np.uint8)
            context[1:] = q[: n - 1]
            context[np.cumsum(lengths) - lengths] = q[n]
            return pa.RecordBatch.from_pydict({"rid": [rid], "rows": [rows], "levels": [b"".join((q[:n].tobytes(), context.tobytes(), q[n + 1 :].tobytes()))]}, pa.schema([("rid", pa.int64()), ("rows", pa.binary()), ("levels", pa.binary())]))

        for b in batches:
            for r, part, h, rest in zip(b.column("rid").to_pylist(), b.column("part").to_pylist(), b.column("h"), b.column("rids"), strict=True):
                if part < 0:
                    if rid is not None:
                        yield block()
                    rid, code, rows, levels = r, np.frombuffer(h.as_py(), "<u4"), rest.as_py(), []
                else:
                    levels.append(h.as_py())
        if rid is not None:
            yield block()

    asked = out.where("kind = 5").select("part", F.lit(1).alias("kind"), "rid", "h")
    held = made.select(F.col("segment").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rid"), F.col("bits").alias("h"))
    told = held.union(asked).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(answer, "rid long, part int, h binary")
    blocks_ = out.where("kind = 4").select("rid", F.lit(-1).alias("part"), "h", "rids")
    both = blocks_.union(told.select("rid", "part", "h", F.lit(None).cast("binary").alias("rids")))
    return both.repartition("rid").sortWithinPartitions("rid", "part").mapInArrow(gather, "rid long, rows binary, levels binary")


class Probabilities:
    """What scoring needs of tokens, by the levels of the word, of the word before it, and of both."""

    def __init__(self, word: np.ndarray, context: np.ndarray, both: np.ndarray, total: int, types: int):
        counts_ = values(1)
        self.context = context
        self.single = counts_[word]
        self.c1, self.c2 = counts_[context], np.where(context > 0, counts_[both], 0.0)
        self.low = (self.single + 1) / (total + types + 1)

    def high(self, less: float = 0.0) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.minimum(1.0, np.where(self.c1 > less, np.maximum(self.c2 - less, 0) / (self.c1 - less), 0.0))


def probed(f: Filter, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, code = np.unique(h, return_inverse=True)
    q = f.levels(np.append(both, _BEGIN))
    word = q[code]
    context = np.append(q[-1], word[:-1])
    context[before == _BEGIN] = q[-1]
    return word, context, f.levels(pair(before, h))


def combined(word: np.ndarray, context: np.ndarray, both: np.ndarray) -> np.ndarray:
    """One number for the three levels of a token: all that its probability depends on."""
    return (context.astype(np.int64) * LEVELS + word) * LEVELS + both


def every_probability(total: int, types: int) -> Probabilities:
    """Probabilities by the number of combined()."""
    context, word, both = np.unravel_index(np.arange(LEVELS**3), (LEVELS,) * 3)
    return Probabilities(word, context, both, total, types)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row id, lengths, training, and combined levels of the tokens of each block."""
    for b in batches:
        for rid, rows, levels in zip(b.column("rid").to_pylist(), b.column("rows"), b.column("levels"), strict=True):
            rows = np.frombuffer(rows.as_py(), "<i8")
            yield rid, rows >> 1, (rows & 1) > 0, combined(*np.frombuffer(levels.as_py(), np.uint8).reshape(3, -1))


def fit_weights(resolved: DataFrame, total: int, types: int) -> np.ndarray:
    """For each level of the context, the weight of pairs that maximises the left-one-out likelihood of all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(LEVELS**3, np.int64)
        for _, lengths, training, q in _resolved(batches):
            got += np.bincount(q[np.repeat(training, lengths)], minlength=LEVELS**3)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], names=["at", "n"])

    # at most LEVELS ** 3 rows, in practice some thousands
    sums = resolved.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(LEVELS**3)
    n[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    p = every_probability(total, types)
    high = p.high(1.0)
    low = np.maximum(p.single, 1) / (total + types + 1)
    grid = np.stack([np.bincount(p.context, np.where(n > 0, n * np.log10(w * high + (1 - w) * low), 0.0), LEVELS) for w in WEIGHTS], 1)
    return WEIGHTS[grid.argmax(1)]


def common_words(counted: DataFrame, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and exact counts of the most common words, at most `top`."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, c in _arrays(batches):
            b, n = np.unique(_bin(c), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n)], names=["bin", "n"])

    words = counted.where("kind = 1")
    hist = words.mapInArrow(sizes, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    least, held = None, 0
    for r in hist:
        held += r["n"]
        if held > top:
            break
        least = r["bin"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part, kind, h, c in _arrays(batches):
            on = _bin(c) >= least
            rows.append((part, kind, h[on].tobytes(), c[on].tobytes()))
        yield _run_batch(rows)

    got = words.mapInArrow(pick, _RUN).toPandas()
    h = np.frombuffer(b"".join(got["h"]), np.uint64)
    order = np.argsort(h)
    return h[order], np.frombuffer(b"".join(got["c"]), "<i8")[order]


def score(docs: DataFrame, training: Column, max_bits: int = MAX_BITS, top: int = TOP) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; the model learns where `training` holds.
    A filter of more than 2 ** max_bits bits is not broadcast; probes are routed to its segments, with the same scores."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    s = Scratch(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learn = rows.where("training")
    seen = learn.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    texts = seen["n"]
    counted, shift = counts(learn, s, seen["size"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h, c in _arrays(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(h)]), pa.array([int(c.sum())])], names=["types", "total"])

    t = counted.where("kind = 1").mapInArrow(totals, "types long, total long").agg(F.sum("types"), F.sum("total")).first()
    types, total = (t[0] or 0) - bool(texts), (t[1] or 0) - texts  # the beginning is a context, not a token
    size = segment_size(counted, shift)
    made = s.keep(segments(counted, size), "segments")
    # from here on only the words' exact counts are read again
    pairs, counted = counted, s.keep(counted.where("kind = 1"), "words")
    s.drop(pairs)
    f = sc.broadcast(build_filter(made, size, shift)) if size << (64 - shift) <= 2**max_bits else None
    common = sc.broadcast(common_words(counted, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_h, top_c = common.value
        task, at = TaskContext.get().partitionId() << 33, 0
        for part, b in blocks(batches):
            row, h, before = token_hashes(b)
            found = np.searchsorted(top_h, h)
            found[found == len(top_h)] = 0
            is_top = (top_h[found] == h) if len(top_h) else np.zeros(len(h), bool)
            base = np.bincount(row[is_top], np.log10((top_c[found[is_top]] + 1) / (total + types + 1)), b.n) if len(top_h) else np.zeros(b.n)
            known = np.bincount(row[is_top], minlength=b.n)
            rid = task + at + np.arange(b.n)
            at += b.n
            lengths = np.bincount(row, minlength=b.n)
            yield _scored(0, rid, part.column("doc_id"), lengths, known, base, np.zeros(b.n))
            doc_rows = _rows(lengths, part.column("training").to_numpy(zero_copy_only=False).astype(np.int64))
            yield _asks(int(rid[0]), doc_rows, h, before, shift) if f is None else _levels(int(rid[0]), doc_rows, probed(f.value, h, before))
            rare = np.flatnonzero(~is_top)
            rare = rare[np.argsort(h[rare], kind="stable")]
            runs = _runs(h[rare], np.zeros(len(rare)), 3, shift)
            if runs:
                where = rid[row[rare]]
                ends = np.cumsum([len(r[2]) // 8 for r in runs])
                yield _rare(runs, [where[a:z].tobytes() for a, z in zip(np.append(0, ends[:-1]), ends, strict=True)])

    fields = "kind int, rid long, doc_id long, n_tokens long, known long, base double, score double, part int, h binary, rids binary"
    out = s.keep(rows.mapInArrow(run, fields), "scored", TEXTS)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        words = table.filter(pa.array(kind == 1))
        asked = table.filter(pa.array(kind == 3))
        h = np.frombuffer(b"".join(words.column("h").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(words.column("c").to_pylist()), "<i8")
        q = np.frombuffer(b"".join(asked.column("h").to_pylist()), np.uint64)
        rid = np.frombuffer(b"".join(asked.column("c").to_pylist()), np.int64)
        n = np.zeros(len(q), np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, q), len(h) - 1)
            n = np.where(h[at] == q, c[at], 0)
        ids, code = np.unique(rid, return_inverse=True)
        return pa.table({"rid": pa.array(ids), "known": pa.array(np.bincount(code, n > 0, len(ids)).astype(np.int64)), "base": pa.array(np.bincount(code, np.log10((n + 1) / (total + types + 1)), len(ids)).astype(float))})

    asked = out.where("kind = 3").select("part", "kind", "h", F.col("rids").alias("c"))
    rest = asked.union(counted.where("kind = 1")).groupBy("part").applyInArrow(settle, "rid long, known long, base double")
    # the levels are kept, so that fitting and scoring need no second pass over the texts
    resolved = s.keep(routed_levels(out, made, size, shift), "levels") if f is None else out.where("kind = 6").select("rid", F.col("rids").alias("rows"), F.col("h").alias("levels"))
    p = every_probability(total, types)
    w = fit_weights(resolved, total, types)[p.context]
    logs = sc.broadcast(np.log10(w * p.high() + (1 - w) * p.low))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, lengths, _, q in _resolved(batches):
            logp = np.bincount(np.repeat(np.arange(len(lengths)), lengths), logs.value[q], len(lengths))
            yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(len(lengths))), pa.array(logp)], names=["rid", "score"])

    scored = resolved.mapInArrow(finish, "rid long, score double").select("rid", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "score")
    rest = rest.withColumn("score", F.lit(0.0)).unionByName(scored)
    rest = s.keep(rest.groupBy("rid").agg(F.sum("known").alias("more"), F.sum("base").alias("rest"), F.sum("score").alias("logp")), "rest")
    joined = out.where("kind = 0").join(rest, "rid", "left")
    zero = F.lit(0)
    told = joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        F.col("logp").alias("score"),
    )
    return s.sweep(told)


_NAMES = ["kind", "rid", "doc_id", "n_tokens", "known", "base", "score", "part", "h", "rids"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]


def _scored(kind: int, rid: np.ndarray, doc_id: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
    n = len(rid)
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(rid), doc_id, *(pa.array(x, t) for x, t in zip(numbers, _TYPES[3:7], strict=True))]
    return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(n, t) for t in _TYPES[7:])], names=_NAMES)


def _rare(runs: list[tuple], rids: list[bytes]) -> pa.RecordBatch:
    n = len(runs)
    cols = [pa.array(np.full(n, 3, np.int32)), *(pa.nulls(n, t) for t in _TYPES[1:7])]
    return pa.RecordBatch.from_arrays([*cols, pa.array([r[0] for r in runs], pa.int32()), pa.array([r[2] for r in runs], pa.binary()), pa.array(rids, pa.binary())], names=_NAMES)
