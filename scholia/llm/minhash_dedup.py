"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens.

Method (chosen path; CPSJoin): a document's set of word shingles has TOKENS minwise tokens. Every tree starts with all
documents in one node; a node picks one or two token places by a hash of its path (100 / percent of them on average, and
MORE below the first two levels), and its children hold the documents that agree there. Two sets at the
threshold share more than one child on average below those levels, so a pair does not die out however deep the trees
get; independent trees raise recall (see Recall). A document's path depends on its own tokens only, so the first levels are
laid out without any shuffle; node sizes then decide who goes deeper.

* Equal sets are one set from the start: a group of copies, however large, is one row.
* Nodes of at most LEAF sets are compared exhaustively on tokens; only a spanning forest of the candidates leaves them.
* In larger nodes every set is held against PIVOTS of the node's sets. Sets closer than ABSORB to one of them leave the
  node; all that are closer than NEAR become candidates. As 1 - similarity is a metric, whatever is linked to an absorbed
  set is NEAR the pivot, so it stays in the same cluster of candidates, and a node of near copies shrinks at once.
* Candidate clusters are closed by connected components. Forest links are confirmed on full sets (recomputed from the
  texts of candidates alone, found with a Bloom filter of bounded size). Where a cluster still falls into several
  components, the members outside its largest one are held against the whole cluster in blocks. So no link that the
  candidates imply is lost, and none is kept unconfirmed.

Recall: a pair at the threshold shares a given second-level node of a tree with probability 0.64, and a tree has one at
least. Deeper, nodes pick 1.5 places, so the pair shares 1.2 children on average and its line of nodes goes on for ever with
probability 0.625 (1 - q, where q = (0.2 + 0.8 q) (1.2 + 0.8 q) / 2). So 16 trees miss a pair at the threshold with less than
(1 - 0.64 * 0.625) ** 16 < 3e-4 at any depth, whatever the size of the table; pairs at 0.85 with less than 3e-6, and 1e-7 where two
levels are enough. Pivots and clusters make up for part of that.

Defined results: a null or blank text has no set (0 shingles) and links with nothing; a text of fewer words than a shingle
has its whole sequence as one; repeated rows are copies; rows that share a doc_id are one node, linked by whichever of its texts is similar; a null
doc_id joins no component but the one of texts equal to its own, and is kept if it has none; empty tables give empty tables; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.components import components
from scholia.llm.scratch import TEXTS, Scratch, parts
from scholia.llm.textblock import Block, blocks, mix, spans

WORDS = 5
PERCENT = 80
TOKENS = 64
TREES = 16
#: Token places that a node picks beyond 100 / percent, below the first two levels.
MORE = 0.25
LEAF = 256
PIVOTS = 8
NEAR, ABSORB, LIKELY = 0.3, 0.65, 0.58
BLOCK = 128
SLICE = 256
FILTER_BITS = 27

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64)
_PLACE = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(b: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in order of row and hash."""
    low = b.lowered()
    starts, ends = low.words()
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = low.row_of(starts)
    h = spans(low.prefix(), starts, ends)
    n = np.bincount(row, minlength=b.n)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    acc = np.zeros(len(h), np.uint64)
    place = np.arange(len(h)) - first[row]
    for k in range(words):
        nxt = np.zeros_like(h)
        nxt[: max(0, len(h) - k)] = h[k:]
        inside = place + k < n[row]
        acc = np.where(inside, mix(acc * np.uint64(31) + nxt + np.uint64(k + 1)), acc)
    take = (place + words <= n[row]) | ((place == 0) & (n[row] < words))
    row, acc = row[take], acc[take]
    order = np.lexsort((acc, row))
    row, acc = row[order], acc[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (acc[1:] != acc[:-1])
    return row[new], acc[new]


def tokens(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a set, and their minwise tokens (rows x TOKENS, 32 bits)."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(first), TOKENS), np.uint32)
    for k in range(TOKENS) if len(first) else ():
        v = (((h ^ _ADD[k]) * _MULTIPLY[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(v, first)
    return row[first], out


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(x)
    off = np.arange(len(x) + 1, dtype=np.int32) * (data.strides[0] if data.ndim > 1 else data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TOKENS)


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, (h1, h2) naming the set, and its tokens (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches):
            row, h = shingles(b, words)
            n = np.bincount(row, minlength=b.n).astype(np.int64)
            at, sig = tokens(row, h)
            one, two = np.zeros(b.n, np.uint64), np.zeros(b.n, np.uint64)
            if len(at):
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                one[at] = np.add.reduceat(mix(h), first)
                two[at] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
            full = np.zeros((b.n, TOKENS), np.uint32)
            full[at] = sig
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _binary(full)], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _picks(node: np.ndarray, percent: int, more: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of node, token place) of what each node picks: 100 / percent places on average and one at least, and `more`."""
    rate = 100 / percent + more
    x = mix(node ^ np.uint64(0xA0761D6478BD642F))
    start = np.full(len(node), first, np.uint64) if first is not None else x >> np.uint64(58)
    step = (x >> np.uint64(50)) | np.uint64(1)  # odd, so that places differ
    extra = (x & np.uint64(0xFFFFFFFF)) < np.uint64(int((rate - int(rate)) * 2**32))
    n = np.minimum(int(rate) + extra, TOKENS)
    at = np.repeat(np.arange(len(node)), n)
    k = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    return at, ((start[at] + k * step[at]) % np.uint64(TOKENS)).astype(np.int64)


def _children(node: np.ndarray, sid: np.ndarray, sig: np.ndarray, percent: int, more: float = 0.0, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    at, place = _picks(node, percent, more, first)
    return mix(node[at] * np.uint64(31) + _PLACE[place] + sig[at, place].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), sid[at]


def _first_paths(percent: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        for batch in batches:
            sid, sig = batch.column("sid").to_numpy(), _matrix(batch.column("sig"))
            for k, root in enumerate(roots if len(sid) else ()):
                node, at = _children(np.full(len(sid), root), np.arange(len(sid)), sig, percent, first=13 * k % TOKENS)
                node, at = _children(node, at, sig[at], percent)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(sid[at])], names=["node", "sid"])

    return run


def _forest(sid: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of the likely links of a leaf."""
    found: list[tuple[int, int]] = []
    m = len(sid)
    if m < 2:
        return found
    same = np.zeros((m, m), np.int32)
    for k in range(0, TOKENS, 16):
        same += (sig[:, None, k : k + 16] == sig[None, :, k : k + 16]).sum(2, dtype=np.int32)
    i, j = np.nonzero(np.triu(same >= LIKELY * TOKENS, 1))
    order = np.argsort(-same[i, j], kind="stable")
    root = list(range(m))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = top(a), top(b)
        if ra != rb:
            root[rb] = ra
            if sid[a] != sid[b]:
                found.append((min(sid[a], sid[b]), max(sid[a], sid[b])))
    return found


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of whole leaves; rows come in order of node."""
    rest: tuple | None = None

    def done(node: np.ndarray, sid: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(cut, len(node)))
        two = cut[size == 2]
        likely = two[(sig[two] == sig[two + 1]).sum(1) >= LIKELY * TOKENS]
        links = [np.stack((np.minimum(sid[likely], sid[likely + 1]), np.maximum(sid[likely], sid[likely + 1])), 1)]
        for a, n in zip(cut[size > 2], size[size > 2], strict=True):
            if got := _forest(sid[a : a + n], sig[a : a + n]):
                links.append(np.array(got, np.int64))
        links = np.unique(np.concatenate(links), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = (batch.column("node").to_numpy(), batch.column("sid").to_numpy(), _matrix(batch.column("sig")))
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        rest = tuple(x[last:] for x in now)
        if last:
            yield done(*(x[:last] for x in now))
    if rest is not None and len(rest[0]):
        yield done(*rest)


def _against_pivots(percent: int):
    """Links of sets to the pivots of their nodes (kind 0), and the children of sets that stay (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, sid = (b.column(k).to_numpy() for k in ("node", "sid"))
            sig = _matrix(b.column("sig"))
            nodes, code = np.unique(node, return_inverse=True)
            first = np.full(len(nodes), b.num_rows)
            np.minimum.at(first, code, np.arange(b.num_rows))
            on = np.ones(b.num_rows, bool)
            links = []
            for k, at in enumerate(first):  # the pivots of a node are the same in all its rows
                mine, pivots = np.flatnonzero(code == k), b.column("pivots")[int(at)].as_py()
                psid, psig = np.array([x["sid"] for x in pivots]), np.stack([np.frombuffer(x["sig"], np.uint32) for x in pivots])
                like = np.stack([(sig[mine] == x).sum(1) for x in psig], 1) / TOKENS
                on[mine[(like >= ABSORB).any(1)]] = False
                near = like >= NEAR
                has = np.flatnonzero(near.any(1))
                one = near[has].argmax(1)  # a link to one pivot is enough if pivots that share a set are linked too
                links.append(np.stack((psid[one], sid[mine[has]]), 1))
                both = np.unique(np.concatenate([np.stack((one, np.full(len(has), j)), 1)[near[has][:, j]] for j in range(len(psid))]), axis=0)
                links.append(psid[both])
            a = np.concatenate(links)
            a = a[a[:, 0] != a[:, 1]]
            child, at = _children(node[on].view(np.uint64), sid[on], sig[on], percent, MORE)
            kind = np.concatenate((np.zeros(len(a), np.int32), np.ones(len(at), np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((a[:, 0], child.view(np.int64)))), pa.array(np.concatenate((a[:, 1], at)))], names=["kind", "a", "b"])

    return run


def candidates(sets: DataFrame, s: Scratch, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """Candidate links (a < b) between sets (sid, sig), found in the leaves and pivots of all trees."""
    leaves, links = [], []
    rows = s.keep(sets.mapInArrow(_first_paths(percent, trees), "node long, sid long"), "paths")
    while True:
        part = F.pmod(F.xxhash64("sid"), F.lit(PIVOTS))
        pivot = F.array_compact(F.array(*(F.min(F.when(part == k, F.col("sid"))) for k in range(PIVOTS))))
        nodes = s.keep(rows.groupBy("node").agg(F.count("*").alias("n"), pivot.alias("pivot")).where("n > 1"), "nodes")
        sized = s.keep(rows.join(nodes.select("node", "n"), "node"), "sized")
        leaves.append(sized.where(F.col("n") <= LEAF).select("node", "sid"))
        large = nodes.where(F.col("n") > LEAF)
        if large.limit(1).count() == 0:
            break
        # at most PIVOTS of a node
        pivots = large.select("node", F.explode("pivot").alias("sid")).join(sets, "sid").groupBy("node").agg(F.collect_list(F.struct("sid", "sig")).alias("pivots"))
        held = sized.where(F.col("n") > LEAF).select("node", "sid").join(sets, "sid").join(s.keep(pivots, "pivots"), "node")
        out = s.keep(held.mapInArrow(_against_pivots(percent), "kind int, a long, b long"), "pivoted")
        links.append(out.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        rows = out.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("sid"))
    # the leaves of all levels in one pass: nodes are named by their paths, so no two levels share one
    leaf = reduce(DataFrame.union, leaves).join(sets, "sid").select("node", "sid", "sig")
    found = leaf.repartition(parts(s.spark), "node").sortWithinPartitions("node").mapInArrow(_leaves, "a long, b long")
    return s.keep(reduce(DataFrame.union, links, found).distinct(), "candidates")


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A Bloom filter (two probes) of the long column sid, at most 2 ** FILTER_BITS bits, as words."""
    n = ids.count()
    bits = min(FILTER_BITS, max(10, int(np.ceil(np.log2(max(n, 1) * 24)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_probes(b.column("sid").to_numpy(), bits))
            word, code = np.unique(at >> 6, return_inverse=True)
            got = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(got, code, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(got.view(np.int64))], names=["word", "bits"])

    got = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _probes(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """sid, shingles (sorted 64-bit hashes, binary) and tokens of the documents in ids (sid)."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = shared.value
        bits = int(np.log2(len(filt))) + 6
        for batch in batches:
            one, two = _probes(batch.column("doc_id").to_numpy(), bits)
            hit = (filt[one >> 6] >> (one & 63).astype(np.uint64)) & (filt[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)
            for part, b in blocks(iter([batch.filter(pa.array(hit.astype(bool)))])):
                row, h = shingles(b, words)
                at, sig = tokens(row, h)
                cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, np.int64)
                sets = [h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(sets, pa.binary()), _binary(sig)], names=["sid", "shingles", "sig"])

    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "sid long, shingles binary, sig binary").join(ids, "sid", "left_semi")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """percent of the union is at most the intersection, on whole sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x.as_py(), y.as_py(), percent) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    x = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    return links.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")


def _rest_links(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("rest").to_numpy(zero_copy_only=False).astype(bool)
        outer, inner = np.flatnonzero(side), np.flatnonzero(~side)
        sid, comp = table.column("sid").to_numpy(), table.column("comp").to_numpy()
        sig = _matrix(table.column("sig"))
        blobs = [x.as_py() for x in table.column("shingles")]
        size = np.array([len(x) for x in blobs])
        out = []
        for i in outer:
            like = (sig[inner] == sig[i]).sum(1)
            near = (like >= LIKELY * TOKENS) & (100 * np.minimum(size[inner], size[i]) >= percent * np.maximum(size[inner], size[i])) & (comp[inner] != comp[i])
            joined = set()
            for j in inner[near][np.argsort(-like[near], kind="stable")]:
                if comp[j] not in joined and similar(blobs[i], blobs[j], percent):
                    joined.add(comp[j])
                    out.append((min(sid[i], sid[j]), max(sid[i], sid[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def similar_components(docs: DataFrame, sets: DataFrame, s: Scratch, words: int, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """node, component of all sets (sid, sig) that are linked with another one; sid is the doc_id of a text with that set."""
    links = candidates(sets, s, percent, trees)
    ids = s.keep(links.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "ids")
    full = s.keep(full_sets(docs, ids, words), "sets", TEXTS)
    sure = s.keep(confirmed(links, full, percent), "sure", TEXTS)
    comps = components(sure, s)
    clusters = components(links, s)
    # members of clusters that fall into several components, without each cluster's largest
    of = s.keep(clusters.withColumnRenamed("node", "sid").withColumnRenamed("component", "cluster").join(comps.withColumnRenamed("node", "sid").withColumnRenamed("component", "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "of")
    sizes = of.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("most")).where("k > 1 and m > 2")
    split = s.keep(split.select("cluster", F.col("most.comp").alias("main"), (F.ceil((F.col("m") - F.col("most.n")) / BLOCK)).alias("blocks"), F.ceil(F.col("m") / SLICE).alias("slices")), "split")
    if split.limit(1).count() == 0:
        return comps
    rows = of.join(split, "cluster").join(full, "sid").select("cluster", "sid", "comp", "shingles", "sig", "main", "blocks", "slices")
    hashed = F.xxhash64("sid")
    inner = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(hashed, F.col("slices")).alias("slice"), "sid", "comp", "shingles", "sig", F.lit(False).alias("rest"))
    outer = rows.where("comp <> main").select("cluster", F.pmod(hashed, F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "sid", "comp", "shingles", "sig", F.lit(True).alias("rest"))
    more = inner.union(outer).groupBy("cluster", "block", "slice").applyInArrow(_rest_links(percent), "a long, b long")
    more = s.keep(more.distinct(), "more")
    if more.limit(1).count() == 0:
        return comps
    star = comps.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return components(star.union(more), s)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, for every row."""
    s = Scratch(docs.sparkSession, "minhash")
    every = s.keep(document_sets(docs, words), "documents", TEXTS)
    # equal sets are one, named by its smallest doc_id; the minimum is taken in partial sums, so a group of copies is no hot group
    named = every.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig")).alias("one"))
    reps = s.keep(named.select("h1", "h2", F.col("one.doc_id").alias("rep"), F.col("one.sig").alias("sig")), "reps")
    comps = similar_components(docs, reps.select(F.col("rep").alias("sid"), "sig"), s, words, percent, trees)
    found = s.keep(reps.select("h1", "h2", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component")), "found")
    out = every.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return s.sweep(out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
