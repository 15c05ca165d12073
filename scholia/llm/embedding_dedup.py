"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one per half of the (normalised) vectors, are fitted to a bounded sample; a vector's cell is its nearest
centre in either half. A query visits cells in multi-sequence order: by the sum of its two distances. The centres of each
half are sorted once, and only pairs of ranks (i, j) with (i + 1) * (j + 1) <= visits are looked at, since all pairs of
smaller ranks come first: that staircase holds the first cells exactly, and the K x K grid is never laid out.

Every row is indexed and every row is a query, so a link is met when either end visits the other's cell. The number of
visits covers RECALL of pairs planted at exactly the limit around FIT_QUERIES sampled vectors (PLANTED each, in random
directions), and of those vectors' true links, found by brute force against all rows in blocks, whichever needs more.

Equal vectors are one vector with a count from the start, so a group of copies is no hot cell. Cells with more members than
BLOCK are split by salt and their visitors are sent to every part, so no task holds a whole cell. Candidates are verified
in double precision where they meet; what leaves a task is a count per query and part, and a spanning star of its links.

Contracts: links have cosine >= the limit, in double precision; n_links counts linked rows other than the row itself.
Defined results: null vectors, zero vectors, and vectors with a null or non-finite component, or of another length than
most, link with nothing, nor does a row with a null vec_id; repeated rows link with each other; where one vec_id stands on different
vectors, the one with the smallest hash counts for all its rows; an empty table gives an empty table; labels are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.components import components
from scholia.llm.scratch import Scratch
from scholia.llm.textblock import mix

LIMIT = 0.95
#: Rows of the sample to which codebooks are fitted, and queries of the sample that sets the number of visits.
FIT_ROWS, FIT_QUERIES, PLANTED = 8192, 256, 16
#: Centres a half: as many as leave about ROWS_A_CELL vectors a cell, within these bounds; so at most 65,536 cells.
CENTRES, ROWS_A_CELL = (16, 256), 32
RECALL = 0.995
#: Cells visited at least, whatever the sample says.
LEAST_VISITS = 4
#: Members of a part, and visitors of a wave, about.
BLOCK, WAVE = 256, 768
#: Numbers in the arrays of one step, about.
STEP = 1 << 20

Books = tuple[np.ndarray, np.ndarray]


def normal(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _unit(column: pa.Array, kind: str) -> np.ndarray:
    return normal(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def vectors(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """vec_id, raw (the vector's numbers as they came, as binary; null if it cannot link), and (h1, h2) naming its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            size = np.array([0 if x is None else x for x in v.value_lengths().to_pylist()])
            flat = v.flatten()
            ok = size == dim
            x = np.zeros((len(v), dim), kind)
            starts = np.concatenate(([0], np.cumsum(size)))[:-1]
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            if ok.any():
                x[ok] = values[starts[ok][:, None] + np.arange(dim)]
            ok &= np.isfinite(x).all(1) & (np.abs(np.where(np.isfinite(x), x, 0)).max(1, initial=0) > 0)
            x[~ok] = 1.0
            bits = mix((x.astype(np.float64) + 0.0).view(np.uint64))
            place = mix(np.arange(1, dim + 1, dtype=np.uint64))
            one, two = mix(bits ^ place).sum(1, dtype=np.uint64), mix(bits + place * np.uint64(3)).sum(1, dtype=np.uint64)
            data = pa.array([r.tobytes() if k else None for r, k in zip(x, ok, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), data, pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["vec_id", "raw", "h1", "h2"])

    wide = "float" if kind == "<f4" else "double"
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{wide}>").alias("v"))
    return slim.mapInArrow(run, "vec_id long, raw binary, h1 long, h2 long")


def codebook(x: np.ndarray, centres: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """k-means on the sample of one half."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(centres, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        for k in range(len(c)):
            mine = x[near == k]
            if len(mine):
                c[k] = mine.mean(0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T


def _halves(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return _distances(x[:, :half], books[0]), _distances(x[:, half:], books[1])


def _cells(x: np.ndarray, books: Books) -> np.ndarray:
    one, two = _halves(x, books)
    return one.argmin(1) * len(books[1]) + two.argmin(1)


def stairs(k1: int, k2: int, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ranks that can be among the first `visits` cells: (i + 1) * (j + 1) <= visits."""
    i = np.arange(min(k1, visits))
    n = np.minimum(visits // (i + 1), k2)
    return np.repeat(i, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def order(x: np.ndarray, books: Books, visits: int) -> np.ndarray:
    """The first `visits` cells of each row (fewer if there are not so many) in multi-sequence order."""
    k1, k2 = len(books[0]), len(books[1])
    visits = min(visits, k1 * k2)
    i, j = stairs(k1, k2, visits)
    out = np.empty((len(x), visits), np.int32)
    step = max(1, STEP // (len(i) + k1 + k2))
    for a in range(0, len(x), step):
        one, two = _halves(x[a : a + step], books)
        o1, o2 = one.argsort(1, kind="stable"), two.argsort(1, kind="stable")
        total = np.take_along_axis(one, o1, 1)[:, i] + np.take_along_axis(two, o2, 1)[:, j]
        first = np.argpartition(total, visits - 1, 1)[:, :visits] if visits < len(i) else np.broadcast_to(np.arange(len(i)), total.shape)
        first = np.take_along_axis(first, np.take_along_axis(total, first, 1).argsort(1, kind="stable"), 1)
        out[a : a + step] = np.take_along_axis(o1, i[first], 1) * k2 + np.take_along_axis(o2, j[first], 1)
    return out


def rank(x: np.ndarray, y: np.ndarray, books: Books) -> np.ndarray:
    """How many cells row k of x visits before that of row k of y."""
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), max(1, STEP // 64 // len(books[0]))):
        part = slice(a, a + max(1, STEP // 64 // len(books[0])))
        one, two = _halves(x[part], books)
        cell = _cells(y[part], books)
        at = np.arange(len(cell))
        least = one[at, cell // len(books[1])] + two[at, cell % len(books[1])]
        two.sort(1)
        out[part] = [np.searchsorted(t, m - o - 1e-9, "left").sum() for o, t, m in zip(one, two, least, strict=True)]
    return out


def planted(x: np.ndarray, limit: float, copies: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) at exactly the limit, in random directions."""
    x = np.repeat(x, copies, 0)
    g = np.random.default_rng(seed).normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    g /= np.maximum(np.sqrt((g * g).sum(1, keepdims=True)), 1e-300)
    return x, limit * x + np.sqrt(max(0.0, 1 - limit * limit)) * g


def needed_visits(queries: np.ndarray, base: DataFrame, books: Books, limit: float, recall: float, kind: str) -> int:
    """Cells to visit so that, with visits from both ends, `recall` of the planted pairs and of the queries' links are met."""
    x, y = planted(queries, limit, PLANTED)
    low = np.minimum(rank(x, y, books), rank(y, x, books))
    most = int(np.quantile(low, recall, method="higher")) + 1
    shared = base.sparkSession.sparkContext.broadcast((queries, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, books = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                x = _unit(batch.column("raw").slice(a, 2048), kind)
                like = q @ x.T
                i, j = np.nonzero((like >= limit) & (like < 1 - 1e-12))  # not the query itself
                low = np.minimum(rank(q[i], x[j], books), rank(x[j], q[i], books))
                at, n = np.unique(low, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["rank", "n"])

    got = base.select("raw").mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).toPandas().sort_values("rank")
    if len(got):
        share = got["n"].cumsum().to_numpy() / got["n"].sum()
        most = max(most, int(got["rank"].to_numpy()[np.searchsorted(share, recall)]) + 1)
    return max(LEAST_VISITS, most)


def _verify(limit: float, kind: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        node, copies, home = (table.column(k).to_numpy() for k in ("node", "copies", "home"))
        x = _unit(table.column("raw"), kind)
        visits = np.stack([np.frombuffer(v, "<i4") for v in table.column("visits").to_pylist()])
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(0, len(q), 256):
            part = q[k : k + 256]
            hit = x[part] @ x[m].T >= limit
            hit &= node[part][:, None] != node[m][None, :]
            n = hit @ copies[m]
            has = np.flatnonzero(n)
            if not len(has):
                continue
            # the smallest member each query links with, and a link from there to every other such member
            low = np.where(hit[has], node[m][None, :], np.iinfo(np.int64).max)
            best = low.min(1)
            out.append((node[part[has]], n[has], best))
            i, j = np.nonzero(hit[has])
            a, b = best[i], node[m][j]
            star = np.unique(np.stack((a[a != b], b[a != b]), 1), axis=0)
            out.append((star[:, 0], np.zeros(len(star), np.int64), star[:, 1]))
            # a member that does not visit the query's own cell never meets it: it is told here
            alone = np.concatenate([(visits[m[j[c : c + 8192]]] != home[part[has[i[c : c + 8192]]]][:, None]).all(1) for c in range(0, len(j), 8192)])
            if alone.any():
                more = np.bincount(j[alone], copies[part[has[i[alone]]]], len(m)).astype(np.int64)
                got = np.flatnonzero(more)
                out.append((node[m[got]], more[got], node[m[got]]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "b": pa.array(cols[2], pa.int64())})

    return run


def near_duplicates(rows: DataFrame, limit: float = LIMIT, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding)."""
    spark = rows.sparkSession
    s = Scratch(spark, "multi-index")
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    dims = rows.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = max(2, dims[0]["d"]) if dims else 2
    every = s.keep(vectors(rows, dim, kind), "vectors")
    good = every.where("raw is not null and vec_id is not null")
    base = s.keep(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "names")
    members = every.select("vec_id", "h1", "h2", (F.col("raw").isNotNull() & F.col("vec_id").isNotNull()).alias("ok")).join(base.select("h1", "h2", "node", "copies"), ["h1", "h2"], "left")
    members = s.keep(members, "members")
    # an id on several vectors: the one with the smallest hash stays
    named = F.struct("h1", "h2")
    clash = s.keep(base.groupBy("node").agg(F.count("*").alias("k"), F.min(named).alias("first")).where("k > 1"), "clash")
    if clash.limit(1).count():
        base = s.keep(base.join(clash, "node", "left").where(F.col("first").isNull() | (F.col("first") == named)), "base")
    base = base.select("node", "copies", "raw")
    sample = base.select("raw", F.xxhash64("node").alias("h")).orderBy("h").limit(FIT_ROWS).select("raw").toPandas()["raw"]
    if len(sample):
        x = normal(np.stack([np.frombuffer(v, kind) for v in sample]))
        half = dim // 2
        centres = min(CENTRES[1], max(CENTRES[0], int(np.ceil(np.sqrt(base.count() / ROWS_A_CELL)))))
        books = (codebook(x[:, :half].copy(), centres), codebook(x[:, half:].copy(), centres))
        visits = needed_visits(x[:FIT_QUERIES], base, books, limit, recall, kind)
        stars = s.keep(_met(base, s, books, visits, limit, kind), "met")
        counts = s.keep(stars.groupBy("a").agg(F.sum("n").alias("links")).where("links > 0").withColumnRenamed("a", "node"), "counts")
        comps = components(stars.select("a", "b"), s)
        out = members.join(counts, "node", "left").join(comps, "node", "left")
    else:
        out = members.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    n = F.when(F.col("ok"), F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies"), F.lit(1)) - 1).otherwise(0)
    comp = F.when(F.col("ok"), F.coalesce("component", "node", "vec_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", n.cast("long").alias("n_links"), comp.alias("component_id"))
    return s.sweep(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _met(base: DataFrame, s: Scratch, books: Books, visits: int, limit: float, kind: str) -> DataFrame:
    """(a, n, b): vector a has n links told by some part of a cell, among them to b; n is 0 where a - b only spans a group."""
    shared = base.sparkSession.sparkContext.broadcast(books)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                x = _unit(part.column("raw"), kind)
                cells = order(x, shared.value, visits)
                # the nearest cell is a vector's home; it is the first that it visits
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[:, 0].copy()), lists, pa.array([r.tobytes() for r in cells.astype("<i4")], pa.binary())], names=[*part.schema.names, "home", "cells", "visits"])

    rows = s.keep(base.mapInArrow(index, "node long, copies long, raw binary, home int, cells array<int>, visits binary"), "index")
    salt, kept = F.xxhash64("node"), ["node", "copies", "raw", "home", "visits"]
    sizes = s.keep(rows.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "sizes")
    asked = rows.select("node", F.explode("cells").alias("cell")).join(sizes, "cell")
    # visitors of a part come in waves of bounded size, each with the part's members
    waves = asked.groupBy("cell").agg(F.first("parts").alias("parts"), F.ceil(F.count("*") / WAVE).cast("int").alias("waves"))
    # at most 256 ** 2 rows of a few numbers: a proven bound
    waves = F.broadcast(s.keep(waves, "waves"))
    outer = rows.select(F.explode("cells").alias("cell"), *kept).join(waves, "cell")
    outer = outer.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.hash("node"), F.col("waves")).cast("int").alias("wave"), *kept, F.lit(True).alias("query"))
    inner = rows.join(waves, F.col("home") == F.col("cell"))
    inner = inner.select("cell", F.pmod(salt, F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("waves") - 1)).alias("wave"), *kept, F.lit(False).alias("query"))
    return outer.union(inner).groupBy("cell", "part", "wave").applyInArrow(_verify(limit, kind), "a long, n long, b long")
