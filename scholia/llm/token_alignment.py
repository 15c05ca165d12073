"""Alignment of two tokenizers over the same texts, as joins, windows and groups of token tables.

Unit of work: a text with one space before it is cut into segments before every lone space between two characters that are
certainly no white space. Tokenizer A (byte-level BPE) begins a pre-token there, and no piece of tokenizer B holds the mark
of a space behind another character (checked against its vocabulary; else texts stay whole), so tokens of neither cross
such a place and no group of the alignment does. Equal segments are aligned once, whatever the number of their copies.

1. Cutting: each task keeps a dictionary of the segments it meets and closes a block when DICTIONARY are held. A block is
   rows of codes (one a segment of a text, in order) and its distinct segments; only these are looked up in the corpus.
2. Aligning distinct segments: what the blocks ask for is dealt by segment, and a distinct segment keeps the places that ask
   for it. Tokens are posexploded; windowed cumulative lengths give their ends; an equi-join on segment and end finds the
   common ends (cuts); the number of cuts before a token is its group, so that the tokens between two cuts are a range on
   either side, and links join the two ranges of a group.
3. Counting: the id pairs of a segment go to the places that ask for it; blocks count, once a document, the pairs it holds;
   counts by block are summed by pair (partial sums: a pair in every document is no hot group).
4. Scoring: counts are joined to the links and summed by segment; blocks get these sums and the segments' groups and add
   them up by document.

Blocks tell their segments apart by 64-bit fingerprints; everything else is keyed by the segments themselves. A place asks
once, so a segment in every text has as many places as there are blocks. Copies of a segment that come in two Arrow batches
are two segments with a part of the places each, which changes no result.

Defined results: each row is a document; a text that is null or empty, or whose tokens' bytes are not those of the text with
a space before it (for one, where it holds U+2581), has no tokens: zeros and an empty string; special tokens' strings are
plain text; repeated rows count and are returned one by one; a null doc_id stays null; very long texts are aligned whole;
empty tables give empty tables; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.packing import tokenizer
from scholia.llm.scratch import Scratch, parts
from scholia.llm.textblock import Block, blocks, column, spans

DICTIONARY = 1 << 19
#: A pair of ids is one number: a * PAIR + b (A has under 2 ** 16 ids, B at most PAIR).
PAIR = 1 << 15
#: Counts of pairs are broadcast up to so many bytes as written, and joined by a shuffle beyond.
SMALL = 16 << 20
MARK = "▁"

_SOLID = np.zeros(256, bool)  # first bytes of characters that are certainly no white space
_SOLID[33:127] = _SOLID[0xC3:0xE0] = _SOLID[0xE4:0xF5] = True


@cache
def pieces(name: str = "piece_bpe_32k.model"):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


@cache
def piece_bytes() -> list[bytes]:
    sp = pieces()
    named = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    return [bytes([int(x[3:5], 16)]) if sp.is_byte(k) else x.replace(MARK, " ").encode() for k, x in enumerate(named)]


@cache
def cuts_are_safe() -> bool:
    """Whether no piece of B holds the mark of a space behind another character."""
    sp = pieces()
    return not any(MARK in sp.id_to_piece(k).lstrip(MARK) for k in range(sp.get_piece_size()))


def segments(b: Block, safe: bool = True) -> np.ndarray:
    """Starts of the segments of texts which begin with a space; empty rows have none."""
    d = b.data
    first = np.zeros(len(d) + 1, bool)
    if safe and len(d) > 2:
        lead = np.where((d & 0xC0) != 0x80, np.arange(len(d)), 0)
        before = _SOLID[d[np.maximum.accumulate(lead)]]  # of the character that a byte is part of
        first[1 : len(d) - 1] = (d[1:-1] == 32) & before[:-2] & _SOLID[d[2:]]
    first[b.off[:-1]] = True
    first[b.off[1:]] = False
    first[b.off[:-1][np.diff(b.off) > 0]] = True
    return np.flatnonzero(first[: len(d)])


#: A place (at) is a block's number, in the bits above, and the code of a segment; texts' places have the greatest codes.
_CODE = 24
_TEXTS = (1 << _CODE) - 1
_CUT = "at long, seg string, ids binary, n binary, codes binary"
_CUT_NAMES = ["at", "seg", "ids", "n", "codes"]


class _Dictionary:
    def __init__(self):
        self.hashes, self.codes, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of these fingerprints, and the places where new ones are met first, in order of their codes."""
        met = pa.array(h).dictionary_encode()
        seen, inverse = met.dictionary.to_numpy(), met.indices.to_numpy()  # in order of their first places
        first = np.empty(len(seen), np.int64)
        first[inverse[::-1]] = np.arange(len(h))[::-1]
        at = np.searchsorted(self.hashes, seen)
        known = np.zeros(len(seen), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == seen[inside]
        code = np.empty(len(seen), np.int64)
        code[known] = self.codes[at[known]]
        new = np.flatnonzero(~known)
        code[new] = self.size + np.arange(len(new))
        self.size += len(new)
        fresh = new[np.argsort(seen[new])]
        self.hashes = np.insert(self.hashes, at[fresh], seen[fresh])
        self.codes = np.insert(self.codes, at[fresh], code[fresh])
        return code[inverse], first[new]


def cut(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """Rows of a block: its distinct segments (at, seg) and its texts (ids, segments by text, codes; at the block's end)."""
    safe = cuts_are_safe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has under 2 ** 16 blocks, as each is closed by at least so many segments
        block, known = TaskContext.get().partitionId() << 16, _Dictionary()
        for part, plain in blocks(batches):
            spaced = pc.binary_join_element_wise(pa.scalar(" "), part.column("text"), pa.scalar(""))
            b = column(pc.if_else(pc.equal(pc.binary_length(part.column("text")), 0), "", spaced))
            start = segments(b, safe)
            row = b.row_of(start)
            end = np.append(start[1:], len(b.data))
            codes, new = known.add(spans(b.prefix(), start, end))
            held = known.size
            if len(new):
                raw = b.data.tobytes()
                segs = [raw[a:z].decode() for a, z in zip(start[new].tolist(), end[new].tolist(), strict=True)]
                m = len(segs)
                yield pa.RecordBatch.from_arrays([pa.array((block << _CODE) + np.arange(held - m, held)), pa.array(segs, pa.string()), *(pa.nulls(m, pa.binary()) for _ in range(3))], names=_CUT_NAMES)
            ids = part.column("doc_id")
            ids_bytes = np.stack((ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()).astype(np.int64))).tobytes()
            planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()  # codes have under 24 bits
            told = [[(block << _CODE) + _TEXTS], [None], [ids_bytes], [np.bincount(row, minlength=b.n).astype("<i4").tobytes()], [pa.compress(planes, codec="zstd", asbytes=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(told, (pa.int64(), pa.string(), *[pa.binary()] * 3), strict=True)], names=_CUT_NAMES)
            if known.size >= dictionary:
                block, known = block + 1, _Dictionary()

    return docs.mapInArrow(run, _CUT)


@cache
def _bytes() -> tuple[pa.Array, pa.Array]:
    """Bytes of the tokens of A and of B by id."""
    t = tokenizer()
    known = {t.encode_single_token(x): x for x in t.token_byte_values()}
    return pa.array([known.get(k, b"") for k in range(t.n_vocab)], pa.large_binary()), pa.array(piece_bytes(), pa.large_binary())


def _joined(table: pa.Array, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """The values at these places of a large binary column, joined by runs of n."""
    found = table.take(pa.array(at))
    _, offsets, data = found.buffers()
    off = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(table.type, len(n), [None, pa.py_buffer(off[_edges(n)]), data])


def _edges(n: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(n)).astype(np.int64)


def _lists(n: np.ndarray, values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A list column of runs of n values."""
    return pa.ListArray.from_arrays(pa.array(_edges(n).astype(np.int32)), pa.array(values), mask=None if null is None else pa.array(null))


def tokens(asks: DataFrame) -> DataFrame:
    """From places and their segments (at, seg; copies close together): sid, the places (ats), and the ids and byte lengths
    of both tokenizers' tokens; a segment whose bytes differ has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tables = tokenizer().encode_ordinary, _bytes()
        lengths = [pc.binary_length(x).to_numpy().astype(np.int16) for x in tables]
        sid = TaskContext.get().partitionId() << 33
        for batch in batches:
            met = batch.column("seg").dictionary_encode()
            code, segs = met.indices.to_numpy(), met.dictionary
            texts = segs.to_pylist()
            ids = [encode(t) for t in texts], pieces().encode([t[1:] for t in texts], num_threads=1)
            n = [np.fromiter(map(len, x), np.int64, len(texts)) for x in ids]
            flat = [np.fromiter(chain.from_iterable(x), np.int32, k.sum()) for x, k in zip(ids, n, strict=True)]
            want, ok = segs.cast(pa.large_binary()), np.ones(len(texts), bool)
            for x, f, k in zip(tables, flat, n, strict=True):
                ok &= pc.equal(_joined(x, f, k), want).to_numpy(zero_copy_only=False)
            flat = [f[np.repeat(ok, k)] for f, k in zip(flat, n, strict=True)]
            n = [np.where(ok, k, 0) for k in n]
            ats = _lists(np.bincount(code, minlength=len(texts)), batch.column("at").to_numpy()[np.argsort(code, kind="stable")])
            told = [x for f, k, size in zip(flat, n, lengths, strict=True) for x in (_lists(k, f), _lists(k, size[f]))]
            yield pa.RecordBatch.from_arrays([pa.array(sid + np.arange(len(texts))), ats, *told], names=["sid", "ats", "a", "al", "b", "bl"])
            sid += len(texts)

    return asks.mapInArrow(run, "sid long, ats array<long>, a array<int>, al array<smallint>, b array<int>, bl array<smallint>")


def _placed(t: DataFrame, lengths: str) -> DataFrame:
    """sid, pos and end (bytes up to and with the token) of every token of one side."""
    at = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = t.select("sid", F.posexplode(lengths).alias("pos", "len"))
    return rows.select("sid", "pos", F.sum("len").over(at).alias("end"))


def cuts(t: DataFrame) -> DataFrame:
    """sid and its cuts in order: the places of the tokens of both sides (pos, there) that end at the same byte."""
    a, b = _placed(t, "al"), _placed(t, "bl")
    both = a.select("sid", "end", "pos").join(b.select("sid", "end", F.col("pos").alias("there")), ["sid", "end"])
    return both.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "there"))).alias("cuts"))


@cache
def _named() -> pa.Array:
    """Ids as text, with what stands behind them: at 3 * id, a comma, then a bar, then a semicolon."""
    return pa.array([f"{k}{x}" for k in range(1 << 16) for x in ",|;"], pa.large_string())


_FACTS = "sid long, ats array<long>, n_a int, n_b int, n_groups int, n_links long, groups string, pairs array<int>, ns array<long>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments, their tokens and cuts: groups as text (`a1,a2|b1;a3|b2,b3;`), and for each group its distinct pairs of ids
    with the number of token pairs they stand for. The k-th group holds the tokens of which k cuts lie before."""
    for batch in batches:
        ids, n = zip(*((x, k) for x, _, k in map(_flat, (batch.column("a"), batch.column("b")))), strict=True)
        places, first, n_groups = _flat(batch.column("cuts"), False)
        size, start = [], []  # of a group on either side
        for c in ("pos", "there"):
            at = places.field(c).to_numpy().astype(np.int64) + 1
            k = np.diff(at, prepend=0)
            k[first[n_groups > 0]] = at[first[n_groups > 0]]
            size.append(k)
            start.append(_edges(k))
        group = [np.repeat(np.arange(len(k)), k) for k in size]
        # the text: a token's place is its own on its side and that of the other side's tokens before it
        text = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, other in ((0, start[1][:-1]), (1, start[0][1:])):
            last = np.zeros(len(ids[side]), np.int64)
            last[start[side][1:] - 1] = 1 + side
            text[np.arange(len(last)) + other[group[side]]] = 3 * ids[side].astype(np.int64) + last
        # distinct ids of a group on either side, all of one with all of the other
        kinds = [np.unique(g << 16 | x, return_counts=True) for g, x in zip(group, ids, strict=True)]
        per = [np.bincount(key >> 16, minlength=len(size[0])) for key, _ in kinds]
        own = kinds[0][0] >> 16
        much = per[1][own]
        at = _ranges(_edges(per[1])[own], much)
        pairs = np.repeat((kinds[0][0] & 0xFFFF) * PAIR, much) + (kinds[1][0] & 0xFFFF)[at]
        ns = np.repeat(kinds[0][1], much) * kinds[1][1][at]
        null = n_groups == 0
        by_row = lambda x: _sums(x, n_groups)
        n_pairs = by_row(per[0] * per[1])
        groups = _joined(_named(), text, n[0] + n[1])
        groups = pc.if_else(pa.array(null), pa.scalar(None, groups.type), groups).cast(pa.string())
        numbers = [pa.array(x.astype(np.int32)) for x in (*n, n_groups)]
        told = [batch.column("sid"), batch.column("ats"), *numbers, pa.array(by_row(size[0] * size[1])), groups, _lists(n_pairs, pairs.astype(np.int32), null), _lists(n_pairs, ns, null)]
        yield pa.RecordBatch.from_arrays(told, names=["sid", "ats", *_NUMBERS[:4], "groups", "pairs", "ns"])


def aligned_segments(t: DataFrame, s: Scratch) -> DataFrame:
    """From distinct segments' tokens: sid, ats, n_a, n_b, n_groups, n_links, groups (text), pairs and ns (links); a segment
    whose bytes differ has null pairs."""
    conf, name = s.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    try:
        conf.set(name, "false")  # all lies by segment: the join on segment and end needs no other shuffle
        dealt = t.repartition(parts(s.spark), "sid")
        ends = dealt.select("sid", "ats", "a", "b").join(cuts(dealt), "sid", "left")
        return s.keep(ends.mapInArrow(_facts, _FACTS), "facts")
    finally:
        conf.set(name, before)


def _codes(planes: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(pa.decompress(planes, 3 * n, codec="zstd", asbytes=True), np.uint8).reshape(3, -1).astype(np.int64)
    return x[0] | x[1] << 8 | x[2] << 16


def _by_block(batches: Iterator[pa.RecordBatch], field: str) -> Iterator[tuple]:
    """For the rows of each block in order (segments by code, then texts): its segments' column, and one text row."""
    now, held, table = None, [], None
    for batch in batches:
        at = batch.column("at").to_numpy()
        owner, texts = at >> _CODE, (at & _TEXTS) == _TEXTS
        edges = np.flatnonzero(np.append(True, (texts[1:] != texts[:-1]) | (owner[1:] != owner[:-1]))) if len(at) else []
        for a, z in zip(edges, np.append(edges[1:], len(at)), strict=True):
            part = batch.slice(a, z - a)
            if owner[a] != now:
                now, held, table = owner[a], [], None
            if not texts[a]:
                held.append(part.column(field))
                continue
            if table is None:
                table, held = pa.chunked_array(held).combine_chunks() if held else None, []
            text = part.column("text")
            for ids, n, codes in zip(text.field("ids"), text.field("n"), text.field("codes"), strict=True):
                n = np.frombuffer(n.as_py(), "<i4").astype(np.int64)
                yield now, table, np.frombuffer(ids.as_py(), np.int64).reshape(2, -1), n, _codes(codes.as_py(), int(n.sum()))


def _flat(x: pa.Array, plain: bool = True) -> tuple:
    """Values (an array, if plain), starts and lengths of a list column; null is empty."""
    n = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = x.flatten()
    return values.to_numpy() if plain else values, np.cumsum(n) - n, n


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _valid(bad: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether no segment of a text is bad."""
    row = np.repeat(np.arange(len(n)), n)
    return np.bincount(row, bad[codes], len(n)) == 0


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a block hold a pair."""
    now, got = None, []
    ready = None

    def told() -> pa.RecordBatch:
        pair, at = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(at, np.concatenate([x for _, x in got])).astype(np.int64))], names=["pair", "n"])

    for block, table, _, n, codes in _by_block(batches, "pairs"):
        if block != now:
            if got:
                yield told()
            now, got, ready = block, [], None
        if not len(codes):
            continue
        if ready is None:
            ready = (*_flat(table), table.is_null().to_numpy(zero_copy_only=False))
        values, start, size, bad = ready
        row = np.repeat(np.arange(len(n)), n)
        mine = _valid(bad, n, codes)[row]
        # distinct segments of each text, then distinct pairs of each text
        key = np.unique(row[mine] << 24 | codes[mine])
        seg = key & (1 << 24) - 1
        pair = values[_ranges(start[seg], size[seg])].astype(np.int64)
        both = np.unique(np.repeat(key >> 24, size[seg]) << 31 | pair)
        got.append(np.unique(both & (1 << 31) - 1, return_counts=True))
    if got:
        yield told()


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, ready = None, None
    for block, table, ids, n, codes in _by_block(batches, "told"):
        if block != now or ready is None:
            now = block
            if table is None:
                table = pa.nulls(0, pa.struct([*((c, pa.int64()) for c in _NUMBERS), ("groups", pa.string())]))
            numbers = [table.field(c).fill_null(0).to_numpy() for c in _NUMBERS]
            ready = numbers, table.field("groups").fill_null("").cast(pa.large_binary()), table.is_null().to_numpy(zero_copy_only=False)
        numbers, texts, bad = ready
        mine = _valid(bad, n, codes) & (n > 0)
        sums = [np.where(mine, _sums(x[codes], n), 0) for x in numbers]
        joined = _joined(texts, codes, n)
        off, data = np.frombuffer(joined.buffers()[1], np.int64).tolist(), memoryview(joined.buffers()[2] or b"")
        # all but the last group's semicolon
        hashes = [hashlib.sha256(data[a : z - 1]).hexdigest() if good else "" for good, a, z in zip(mine.tolist(), off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[0], mask=ids[1] == 0), *(pa.array(x) for x in sums), pa.array(hashes)], names=["doc_id", *_NUMBERS, "groups_sha256"])


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n, in whole numbers, which may pass 2 ** 53."""
    upto = np.append(0, np.cumsum(x, dtype=np.int64))
    return np.diff(upto[_edges(n)])


def aligned(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    s = Scratch(spark, "align", tidy=True)
    n = parts(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = s.keep(cut(slim, dictionary), "cut", 1000)
    asks, texts = made.where("seg is not null").select("at", "seg"), made.where("seg is null")
    t = s.keep(tokens(asks.repartition(n, "seg").sortWithinPartitions(F.xxhash64("seg"))), "tokens")
    facts = aligned_segments(t, s)
    s.drop(t)

    def by_block(sent: DataFrame, field: str) -> DataFrame:
        """The answers of each block, then its texts."""
        text = F.struct("ids", "n", "codes")
        own_texts = texts.select("at", F.lit(None).cast(sent.schema[field].dataType).alias(field), text.alias("text"))
        void = F.lit(None).cast(own_texts.schema["text"].dataType)
        both = sent.select("at", field, void.alias("text")).union(own_texts)
        return both.repartition(n, F.shiftright("at", _CODE)).sortWithinPartitions("at")

    held = by_block(facts.select(F.explode("ats").alias("at"), "pairs"), "pairs").mapInArrow(_pair_counts, "pair long, n long")
    counts = s.keep(held.groupBy("pair").agg(F.sum("n").alias("docs")), "counts")
    most = counts.groupBy(F.expr(f"pair div {PAIR}").alias("a")).agg(F.max("docs").alias("most"))
    ranked = s.keep(counts.withColumn("a", F.expr(f"pair div {PAIR}")).join(most, "a").select(F.col("pair").cast("int"), "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")), "ranked")
    small = F.broadcast(ranked) if s.bytes(s.paths[-1]) <= SMALL else ranked
    linked = facts.select("sid", F.explode(F.arrays_zip("pairs", "ns")).alias("x")).select("sid", F.col("x.pairs").alias("pair"), F.col("x.ns").alias("n"))
    scored = linked.join(small, "pair").groupBy("sid").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    numbered = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _NUMBERS]
    full = s.keep(facts.drop("pairs", "ns").join(scored, "sid", "left").select("ats", *numbered, "groups"), "full")
    s.drop(facts)
    told = F.when(F.col("groups").isNotNull(), F.struct(*_NUMBERS, "groups"))
    sent = full.select(F.explode("ats").alias("at"), told.alias("told"))
    out = by_block(sent, "told").mapInArrow(_scored, f"doc_id long, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string")
    return s.sweep(out)
