"""Repeated passages by a logarithmic family of sparse suffix arrays.

A passage of MATCH bytes is looked at through its anchor: among its first WINDOW places, the one where the hash of GRAM
bytes is least (leftmost on ties). Equal passages have the same anchor, so only suffixes that begin at anchors need to be
indexed, about one in 80 places. Passages of one anchor share at least the PREFIX bytes from there on.

1. Documents are dealt into batches of about BATCH_BYTES. A batch gets a sparse suffix array, dealt by prefix: its anchors'
   suffixes in order of their first bytes (LEAD of them as they are, the rest of the PREFIX by fingerprint), so that equal
   prefixes are neighbours. It is merge-scanned against every level of the index for prefixes that occur there too, then
   becomes the newest level; levels of equal size merge, so a family over b batches has at most log2(b) + 1 levels and every
   entry moves as often.
2. Anchors whose prefix occurs twice are then settled exactly. Occurrences with the same reach to both sides and the same
   bytes there are one class: with two or more members, all its passages repeat. Only where a prefix has several classes,
   each class compares its single passages, by fingerprints of all MATCH bytes, dealt by prefix and distance to the anchor.
   Passages of a prefix that more than HOT classes share are counted by fingerprint instead, with partial sums, and joined
   back, so such a prefix is no hot group.
3. Repeated passages become byte spans, which are cut out of the texts.
4. If asked, passages of so many words that stand in two documents are found the same way, by arrays over words in place of
   bytes. They are cut from `clear_text` only, and not where the rest of the document also stands in others (VERSION).

Fingerprints have 64 bits; equal passages are never missed. Matches do not cross documents, are judged on the input, may
overlap and may lie in one document.

Defined results: a null text counts as empty; texts shorter than MATCH bytes are left alone; repeated rows are documents of
their own (all their passages repeat); a null doc_id is kept; empty tables give empty tables; cutting inside a character
leaves its other bytes in kept_bytes and drops them in kept_text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.minhash_dedup import _filter_bits, _probes
from scholia.llm.scratch import TEXTS, Scratch, parts
from scholia.llm.textblock import _BASE, Block, blocks, column, mix, powers, spans

MATCH = 400
WINDOW = 192
GRAM = 16
LEAD = 8
#: Size of a batch's anchors as written (about a third of its texts' bytes); there are LEAST_BATCHES at least (of words: one).
BATCH_BYTES, LEAST_BATCHES = 24 << 30, 4
CHUNK = 16
HOT = 256
#: Passages of this many words that stand in two documents; the window and the grams of their anchors, in words.
WORDS, WORD_WINDOW, WORD_GRAM = 50, 45, 4
#: If at least this share of a document's shingles outside such passages (SHINGLE words; one of EACH, by its hash) stands in
#: others that hold such passages, it is an edited version of them, not a text with a passage in it.
VERSION, SHINGLE, EACH = 0.5, 5, 4
_PLACE = np.uint64((1 << 31) - 1)
_SIGN = np.uint64(1 << 63)  # makes signed order the order of the bytes


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    out, span = v.copy(), 1
    while span * 2 <= w:
        out[: len(out) - span] = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if w > span:
        out[: len(out) - (w - span)] = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out


def _anchors(prefix: np.ndarray, off: np.ndarray, match: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last start of its passages (places in a sequence with rows at off), prefix and class fingerprints."""
    n = len(prefix) - 1
    long = np.diff(off) >= match
    if not long.any():
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - gram + 1)
    least = _sliding_min((spans(prefix, at, at + gram) & ~_PLACE) | at.astype(np.uint64), window)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - match + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    cut = np.flatnonzero(new)
    low, high, anchor = starts[cut], starts[np.append(cut[1:], len(starts)) - 1], anchor[cut]
    core = spans(prefix, anchor, anchor + match - window + 1)
    reach = mix((anchor - low).astype(np.uint64) * np.uint64(1009) + (high - anchor + window).astype(np.uint64))
    return anchor, low, high, core, mix(spans(prefix, low, high + match) ^ reach)


def _lead(b: Block, at: np.ndarray) -> np.ndarray:
    lead = np.zeros(len(at), np.uint64)
    for k in range(LEAD):
        lead = (lead << np.uint64(8)) | b.data[at + k].astype(np.uint64)
    return lead


def anchors(b: Block, match: int = MATCH, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchor, first and last start of its passages (places in the block), first bytes of the suffix there, prefix and class
    fingerprints."""
    anchor, low, high, core, ctx = _anchors(b.prefix(), b.off, match, window, GRAM)
    return anchor, low, high, _lead(b, anchor), core, ctx


def worded(b: Block) -> tuple[np.ndarray, ...]:
    """Start and end of each word of a block, where each row's words begin, and prefix sums over the words' fingerprints."""
    start, end = b.words()
    codes = spans(b.prefix(), start, end)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(_BASE, len(codes))[: len(codes)], out=prefix[1:])
    return start, end, np.searchsorted(start, b.off), prefix


def anchor_table(docs: DataFrame, match: int, window: int, words: bool = False) -> DataFrame:
    """key, th (naming a row's text), places of its anchors (bytes, or words), lead (in order of the bytes), core and ctx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches):
            if words:
                start, _, off, prefix = worded(b)
                at, low, high, core, ctx = _anchors(prefix, off, match, window, WORD_GRAM)
                lead = _lead(b, start[at])
            else:
                off = b.off
                at, low, high, lead, core, ctx = anchors(b, match, window)
            row = np.searchsorted(off, low, "right") - 1
            base = off[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k).take(take) for k in ("key", "th")), *(pa.array((x - base).astype(np.int32)) for x in (at, low, high)), *(pa.array(x.view(np.int64)) for x in (lead ^ _SIGN, core, ctx))],
                names=["key", "th", "at", "low", "high", "lead", "core", "ctx"],
            )

    return docs.select("key", "th", "text").mapInArrow(run, "key long, th long, at int, low int, high int, lead long, core long, ctx long")


class IndexFamily:
    """Levels of suffix arrays, newest last; a level is (number of batches in it, entries in order of lead and core)."""

    def __init__(self, s: Scratch):
        self.s, self.levels, self.matched = s, [], []

    def _ordered(self, entries: DataFrame, n: Column, name: str) -> DataFrame:
        # partial sums before entries are dealt: a prefix with a third of all entries is no hot group
        return self.s.keep(entries.groupBy("lead", "core").agg(n.cast("long").alias("n")).sortWithinPartitions("lead", "core"), name)

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch that has arrived (columns lead and core): merge-scan it against every level, insert it, merge
        levels of equal size."""
        array = self._ordered(suffixes, F.count("*"), "array")
        self.matched.append(array.where("n > 1").select("lead", "core"))
        for _, level in self.levels:
            # both sides are in order: a sort-merge join is the merge scan
            scan = array.select("lead", "core").hint("merge").join(level.select("lead", "core"), ["lead", "core"])
            self.matched.append(self.s.keep(scan, "scan"))
        self.levels.append((1, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (k, old), (j, new) = self.levels[-2:]
            self.levels[-2:] = [(k + j, self._ordered(old.union(new), F.sum("n"), "level"))]

    def repeated(self) -> DataFrame:
        """The prefixes (core) that occur twice or more in all batches so far."""
        return self.s.keep(reduce(DataFrame.union, self.matched).select("core").distinct(), "repeated")


def _passages(match: int):
    """Fingerprints of the single passages of contested classes, in rows of CHUNK distances to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches):
            prefix = b.prefix()
            lists = part.column("classes")
            row = np.repeat(np.arange(b.n), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = lists.flatten()
            at, low, high, core, single = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("at", "low", "high", "core", "single"))
            hot = flat.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            n = (high - low + 1).astype(np.int64)
            which = np.repeat(np.arange(len(n)), n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
            base = b.off[row[which]]
            h = spans(prefix, base + start, base + start + match)
            chunk = (at[which] - start) // CHUNK
            deal = mix(core[which].astype(np.int64).view(np.uint64) + chunk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            deal = np.where(hot[which], h.view(np.int64), deal)
            cut = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (chunk[1:] != chunk[:-1]) | hot[which[1:]])) if len(which) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(which))[: len(cut)]
            blobs = [h[x:y].tobytes() for x, y in zip(cut, ends, strict=True)]
            own = pa.array(row[which[cut]])
            yield pa.RecordBatch.from_arrays([pa.array(deal[cut]), part.column("key").take(own), part.column("th").take(own), pa.array(start[cut].astype(np.int32)), pa.array(single[which[cut]].astype(bool)), pa.array(hot[which[cut]]), pa.array(blobs, pa.binary())], names=["deal", "key", "th", "start", "single", "hot", "prints"])

    return run


def _settle(match: int):
    """Spans of passages that two classes share, of classes with one member; rows come in order of deal."""

    def done(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        deal, start = t.column("deal").to_numpy(), t.column("start").to_numpy().astype(np.int64)
        blobs = t.column("prints").to_pylist()
        n = np.array([len(x) // 8 for x in blobs])
        h = np.frombuffer(b"".join(blobs), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((h, deal[row]))
        same = (h[order][1:] == h[order][:-1]) & (deal[row[order]][1:] == deal[row[order]][:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice & t.column("single").to_numpy(zero_copy_only=False)[row])
        own, place = row[hit], place[hit]
        cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1))) if len(hit) else np.zeros(0, np.int64)
        last = np.append(cut[1:], len(hit)) - 1
        take = pa.array(own[cut])
        keys = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("key"), t.column("th"))]
        return pa.RecordBatch.from_arrays([*(k.take(take) for k in keys), pa.array(place[cut].astype(np.int32)), pa.array((place[last] + match).astype(np.int32) if len(hit) else np.zeros(0, np.int32))], names=["key", "th", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            deal = now.column("deal").to_numpy()
            cut = int(np.searchsorted(deal, deal[-1], "left"))
            rest = now.slice(cut)
            if cut:
                yield done(now.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield done(rest)

    return run


def _of_documents(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """key, th, classes, text: texts of the documents in rows, which a Bloom filter of bounded size picks at the scan."""
    shared = keyed.sparkSession.sparkContext.broadcast(_filter_bits(rows.select(F.col("key").alias("sid"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = shared.value
        bits = int(np.log2(len(filt))) + 6
        for batch in batches:
            one, two = _probes(batch.column("key").to_numpy(), bits)
            hit = (filt[one >> 6] >> (one & 63).astype(np.uint64)) & (filt[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    return keyed.select("key", "th", "text").mapInArrow(run, "key long, th long, text string").join(rows, ["key", "th"])


def _found(docs: DataFrame, s: Scratch, match: int, window: int, batches: int | None, words: bool = False) -> DataFrame:
    """The anchors whose prefix occurs twice or more."""
    every = s.keep(anchor_table(docs, match, window, words), "anchors", TEXTS)
    batches = batches or max(1 if words else LEAST_BATCHES, -(-s.bytes(s.paths[-1]) // BATCH_BYTES))
    family = IndexFamily(s)
    for k in range(batches):
        family.add(every.where(F.pmod(F.xxhash64("key", "th"), F.lit(batches)) == k))
    found = s.keep(every.join(family.repeated(), "core").drop("lead"), "found")
    return s.sweep(found)


def repeated_spans(docs: DataFrame, s: Scratch, match: int = MATCH, window: int = WINDOW, batches: int | None = None) -> DataFrame:
    """key, th, spans (array of start, end): where the texts of docs (key, th, text) repeat; unmerged."""
    n = parts(s.spark)
    found = _found(docs, s, match, window, batches)
    one = F.struct("key", "th", "at", "low", "high")
    classes = s.keep(found.groupBy("core", "ctx").agg(F.count("*").alias("n"), F.min(one).alias("one")), "classes")
    whole = found.join(classes.where("n > 1").select("core", "ctx"), ["core", "ctx"]).select("key", "th", F.col("low").alias("start"), (F.col("high") + match).alias("end"))
    whole = s.keep(whole.groupBy("key", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "whole")
    contested = s.keep(classes.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core", (F.col("k") > HOT).alias("hot")), "contested")
    members = classes.join(contested, "core").select("one.key", "one.th", "one.at", "one.low", "one.high", "core", (F.col("n") == 1).alias("single"), "hot")
    rows = s.keep(members.groupBy("key", "th").agg(F.collect_list(F.struct("at", "low", "high", "core", "single", "hot")).alias("classes")), "members")
    prints = s.keep(_of_documents(docs, rows).select("key", "th", "text", "classes").mapInArrow(_passages(match), "deal long, key long, th long, start int, single boolean, hot boolean, prints binary"), "prints", TEXTS)
    twice = s.keep(prints.where("hot").groupBy("deal").agg(F.count("*").alias("k")).where("k > 1").select("deal"), "twice")
    common = prints.where("hot and single").join(twice, "deal").select("key", "th", "start", (F.col("start") + match).cast("int").alias("end"))
    part = prints.where("not hot").drop("hot").repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(_settle(match), "key long, th long, start int, end int")
    part = s.keep(part.union(common).groupBy("key", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "part")
    out = whole.union(part).groupBy("key", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return s.sweep(s.keep(out, "spans"))


def _word_prints(words: int):
    """Fingerprints of the single passages of contested classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches):
            _, _, off, prefix = worded(b)
            lists = part.column("classes")
            row = np.repeat(np.arange(b.n), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = lists.flatten()
            low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("low", "high"))
            single = flat.field("single").to_numpy(zero_copy_only=False).astype(bool)
            n = high - low + 1
            which = np.repeat(np.arange(len(n)), n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
            at = off[row[which]] + start
            own = pa.array(row[which])
            yield pa.RecordBatch.from_arrays(
                [pa.array(spans(prefix, at, at + words).view(np.int64)), part.column("key").take(own), part.column("th").take(own), pa.array(start.astype(np.int32)), pa.array(single[which])],
                names=["print", "key", "th", "start", "single"],
            )

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One of EACH of a document's distinct shingles, and whether it stands outside its passages."""
    for part, b in blocks(batches):
        _, _, off, prefix = worded(b)
        lists = part.column("passages")
        row = np.repeat(np.arange(b.n), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        flat = lists.flatten()
        edge = np.zeros(len(prefix), np.int64)
        np.add.at(edge, off[row] + flat.field("start").to_numpy(), 1)
        np.add.at(edge, off[row] + flat.field("end").to_numpy(), -1)
        left = np.cumsum(edge) == 0
        of = np.searchsorted(off, np.arange(len(prefix) - 1), "right") - 1
        at = np.flatnonzero(of[SHINGLE - 1 :] == of[: len(of) - SHINGLE + 1]) if len(of) >= SHINGLE else np.zeros(0, np.int64)
        h = spans(prefix, at, at + SHINGLE)
        at, h = at[h % np.uint64(EACH) == 0], h[h % np.uint64(EACH) == 0]
        outside = left[at] | left[at + SHINGLE - 1]
        order = np.lexsort((~outside, h, of[at]))
        at, h, outside = at[order], h[order], outside[order]
        new = np.append(True, (h[1:] != h[:-1]) | (of[at[1:]] != of[at[:-1]]))[: len(h)]
        own = pa.array(of[at[new]])
        yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), part.column("key").take(own), part.column("th").take(own), pa.array(outside[new])], names=["print", "key", "th", "outside"])


def passage_spans(docs: DataFrame, s: Scratch, words: int = WORDS, window: int = WORD_WINDOW, batches: int | None = None) -> DataFrame:
    """key, th, passages (array of start, end, in words): where passages of docs (key, th, text) stand in another document
    too, unmerged; of documents which are no edited versions of others."""
    doc = F.xxhash64("key", "th")
    sides = F.min("doc").alias("lo"), F.max("doc").alias("hi")
    found = _found(docs, s, words, window, batches, True).withColumn("doc", doc)
    classes = s.keep(found.groupBy("core", "ctx").agg(*sides, F.min(F.struct("key", "th", "low", "high")).alias("one")), "classes")
    whole = found.join(classes.where("lo < hi").select("core", "ctx"), ["core", "ctx"]).select("key", "th", F.col("low").alias("start"), (F.col("high") + words).alias("end"))
    contested = s.keep(classes.groupBy("core").agg(F.count("*").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("k > 1 and lo < hi").select("core"), "several")
    marked = s.keep(classes.join(contested, "core"), "contested")
    # of a class within one document all members are told, since each is to be cut; of others one, which stands for two
    alone = found.join(marked.where("lo = hi").select("core", "ctx"), ["core", "ctx"]).select("key", "th", "low", "high", F.lit(True).alias("single"))
    members = alone.union(marked.where("lo < hi").select("one.key", "one.th", "one.low", "one.high", F.lit(False)))
    rows = s.keep(members.groupBy("key", "th").agg(F.collect_list(F.struct("low", "high", "single")).alias("classes")), "members")
    prints = s.keep(_of_documents(docs, rows).select("key", "th", "text", "classes").mapInArrow(_word_prints(words), "print long, key long, th long, start int, single boolean"), "prints", TEXTS)
    twice = prints.withColumn("doc", doc).groupBy("print").agg(*sides, F.min("single").alias("single")).where("lo < hi or not single").select("print")
    part = prints.where("single").join(twice, "print").select("key", "th", "start", (F.col("start") + words).cast("int").alias("end"))
    every = s.keep(whole.union(part).groupBy("key", "th").agg(F.collect_list(F.struct("start", "end")).alias("passages")), "passages")
    s.sweep(every)
    shingles = s.keep(_of_documents(docs, every).select("key", "th", "text", "passages").mapInArrow(_shingles, "print long, key long, th long, outside boolean"), "shingles", TEXTS)
    others = shingles.withColumn("doc", doc).groupBy("print").agg(*sides).where("lo < hi").select("print", F.lit(1).alias("other"))
    seen = shingles.where("outside").join(others, "print", "left").groupBy("key", "th").agg(F.count("*").alias("n"), F.count("other").alias("m"))
    out = every.join(seen.where(F.col("m") >= VERSION * F.col("n")).select("key", "th"), ["key", "th"], "left_anti")
    return s.sweep(s.keep(out, "spans"))


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, match: int = MATCH, window: int = WINDOW, batches: int | None = None, words: int = 0) -> DataFrame:
    """All columns of docs, with kept_bytes and kept_text (what remains of the text), n_bytes, n_removed and n_spans,
    which replace columns of these names. With `words`, also n_passages, runs of passages of so many words that stand in
    another document (another doc_id or text) too, and clear_text, the text without these and without the repeats."""
    made = {"kept_bytes": "binary", "kept_text": "string", "n_bytes": "long", "n_removed": "long", "n_spans": "long"} | ({"n_passages": "long", "clear_text": "string"} if words else {})
    docs = docs.drop(*made, "spans_", "passages_", "key_", "th_")
    s = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(key.alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = repeated_spans(keyed, s, match, window, batches).withColumnRenamed("spans", "spans_")
    if words:
        more = passage_spans(keyed, Scratch(docs.sparkSession, "passages"), words, words - WORDS + WORD_WINDOW, batches)
        found = found.join(more.withColumnRenamed("passages", "passages_"), ["key", "th"], "full")
    names, told = docs.columns, [c for c in ("spans_", "passages_") if c in found.columns]
    rows = docs.withColumns({"key_": key, "th_": F.xxhash64(text)}).join(found.withColumnsRenamed({"key": "key_", "th": "th_"}), ["key_", "th_"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in blocks(batches):
            out = []
            for t, *found in zip(*(part.column(c) for c in ("text", *told)), strict=True):
                data = (t.as_py() or "").encode()
                rest, kept, runs, cut = data, t.as_py(), [], []
                if found[0].is_valid:
                    v = found[0].values
                    runs = merged(v.field("start").to_numpy(), v.field("end").to_numpy())
                    rest = _without(data, runs)
                    kept = rest.decode("utf-8", "ignore")
                row = (rest, kept, len(data), len(data) - len(rest), len(runs))
                if words:
                    if found[1].is_valid:
                        v, (first, last) = found[1].values, column(pa.array([t.as_py()])).words()
                        cut = [(int(first[a]), int(last[b - 1])) for a, b in merged(v.field("start").to_numpy(), v.field("end").to_numpy())]
                    both = merged(*(np.array(x) for x in zip(*runs, *cut, strict=True))) if cut else []
                    row += (len(cut), _without(data, both).decode("utf-8", "ignore") if cut else kept)
                out.append(row)
            cols = [pa.array(c, {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[t]) for c, t in zip(zip(*out, strict=True), made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *cols], names=[*names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.select(*names, *told).mapInArrow(run, ", ".join([fields, *(f"{c} {t}" for c, t in made.items())]))
