"""Keywords over numbered words: TF-IDF, collocations, trigrams and PageRank (M03-M05, M08) of tables whose words are many.

Words get numbers by their counts, greatest first, so texts are tokenised once and what is counted and dealt are whole numbers. A vocabulary of
more than MOST words doesn't fit an executor's memory; the functions of `keywords`, which give the same results, do its work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import keywords as K
from scholia.sources.tables import written

# Most words that get numbers (12 bytes each in every Python worker), and numbers of a segment of sums that is dealt as one row.
MOST = 1 << 24
SEGMENT = 1 << 10
# What stands for the third word where two are counted: neighbours, and words two apart.
NEXT, APART = -1, -2


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of texts: sums of their bytes times random numbers of the bytes' places."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    many = np.diff(ends)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    times = np.random.default_rng(seed).integers(0, 1 << 64, int(many.max(initial=0)) + 1, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * times[np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], many)], dtype=np.uint64)))
    return sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]


class Numbered:
    """docs: doc, words; ids: doc, ids, the same with numbers for words; names: word, n; counts: n by number, on the driver."""

    def __init__(self, docs: DataFrame, names: DataFrame, known: Broadcast, counts: np.ndarray, seed: int):
        self.docs, self.names, self.known, self.counts, self.seed = docs, names, known, counts, seed
        self.spark = docs.sparkSession

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, number = known.value
            for part, flat, row in K._slices(batches):
                coded = flat.dictionary_encode()
                ids = number[np.searchsorted(h, hashes(coded.dictionary, seed))][coded.indices.to_numpy()]
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(row, minlength=len(part)))))
                yield pa.RecordBatch.from_pydict({"doc": part["doc"], "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))})

        kind = docs.schema["doc"].dataType.simpleString()
        self.ids = written(docs.select("doc", "words").mapInArrow(encode, f"doc {kind}, ids array<int>"), "ids")

    def named(self) -> DataFrame:
        """id, word."""
        known, seed = self.known, self.seed

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, ids = known.value
            for b in batches:
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[np.searchsorted(h, hashes(b["word"], seed))]), "word": b["word"].cast(pa.string())})

        return self.names.select("word").mapInArrow(number, "id int, word string")

    def with_names(self, df: DataFrame, columns: str) -> DataFrame:
        """df, which is small, with words in place of numbers."""
        df = written(df, "unnamed")
        asked = df.select(F.explode(F.array(*columns)).alias("id")).distinct()
        words = written(self.named().join(F.broadcast(asked), "id"), "named")
        for c in columns:
            df = df.join(words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_")), c).drop(c).withColumnRenamed(f"{c}_", c)
        return df

    def sums(self, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], width: int) -> np.ndarray:
        """`add(sums, numbers, rows)` of all slices: a task has one vector of sums, and tasks' vectors are added up by segments."""
        spark = self.spark

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = None
            for _, flat, row in K._slices(batches, "ids"):
                y = np.zeros(-(-width // SEGMENT) * SEGMENT) if y is None else y
                add(y, flat.to_numpy(zero_copy_only=False), row)
            if y is not None:
                yield from rows(y.reshape(-1, SEGMENT), None)

        def rows(y: np.ndarray, of: list[int] | None) -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(y.any(1))
            for k in range(0, len(some), 256):
                at = some[k : k + 256]
                yield pa.RecordBatch.from_pydict({"segment": pa.array([int(i) if of is None else of[i] for i in at], pa.int32()), "sums": pa.array([y[i].tobytes() for i in at], pa.binary())})

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for s, x in zip(b["segment"].to_pylist(), b["sums"], strict=True):
                    y = np.frombuffer(x.as_buffer())
                    out[s] = out[s] + y if s in out else y.copy()
            if out:
                yield from rows(np.array(list(out.values())), list(out))

        tasks = spark.sparkContext.defaultParallelism
        t = self.ids.select("ids").coalesce(tasks).mapInArrow(own, "segment int, sums binary").repartition(tasks, "segment").mapInArrow(total, "segment int, sums binary").toArrow()
        y = np.zeros(-(-width // SEGMENT) * SEGMENT)
        for b in t.to_batches():
            for s, x in zip(b["segment"].to_pylist(), b["sums"], strict=True):
                y[s * SEGMENT : (s + 1) * SEGMENT] = np.frombuffer(x.as_buffer())
        return y[:width]

    def beyond(self, least: int) -> int:
        """How many words have `least` occurrences; their numbers are below it."""
        return int(np.searchsorted(-self.counts, -least, "right"))

    @cached_property
    def grams(self) -> DataFrame:
        """ab, c, n: three words in a row, two (c is NEXT) and two words two apart (APART) of at least two occurrences. Their
        words have as many, so that n-grams of a rarer word are left out before they are dealt."""
        few = self.beyond(2)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, flat, row in K._slices(batches, "ids"):
                w = flat.to_numpy(zero_copy_only=False).astype(np.int64)
                common = w < few
                near, far = ((row[k:] == row[: len(row) - min(k, len(row))]) & common[k:] & common[: len(w) - min(k, len(w))] for k in (1, 2))
                two = (w[:-1] << 32) | w[1:]
                three = near[1:] & near[:-1]
                for ab, c in ((two[near], NEXT), (((w[:-2] << 32) | w[2:])[far], APART), (two[:-1][three], w[2:][three])):
                    yield pa.RecordBatch.from_pydict({"ab": pa.array(ab), "c": pa.array(np.broadcast_to(c, len(ab)).astype(np.int32))})

        return written(self.ids.select("ids").mapInArrow(rows, "ab long, c int").groupBy("ab", "c").agg(F.count("*").alias("n")).where("n >= 2"), "grams")

    def looked_up(self, df: DataFrame, columns: dict[str, tuple[str, np.ndarray]]) -> DataFrame:
        """df with numbers from vectors: new column by name with the column of the words' numbers."""
        have = self.spark.sparkContext.broadcast({k: x for k, (_, x) in columns.items()})
        of = {k: c for k, (c, _) in columns.items()}

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, c in of.items():
                    b = b.append_column(k, pa.array(have.value[k][b[c].to_numpy(zero_copy_only=False)].astype(np.float64)))
                yield b

        return df.mapInArrow(find, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *(f"{k} double" for k in of)]))


def numbered(docs: DataFrame) -> Numbered | None:
    """The words of docs (doc, words) with numbers, or None if they are more than MOST. Hashes stand for words where those are
    looked up; that no two words have the same one is checked, and else others are taken."""
    spark = docs.sparkSession
    docs = written(docs, "words")
    names = written(K.gram_counts(docs, {"w": (1, 0)}).select(F.col("gram").alias("word"), "n"), "names")
    if names.count() > MOST:
        return None
    for seed in range(100):

        def tally(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({"h": pa.array(hashes(b["word"], seed).view(np.int64)), "n": b["n"]})

        t = names.mapInArrow(tally, "h long, n long").toArrow()
        h, n = (t[c].to_numpy() for c in ("h", "n"))
        h = h.view(np.uint64)
        by = np.argsort(h)
        if not (h[by][1:] == h[by][:-1]).any():
            break
    else:
        return None
    order = np.lexsort((h, -n))
    number = np.empty(len(h), np.int32)
    number[order] = np.arange(len(h), dtype=np.int32)
    return Numbered(docs, names, spark.sparkContext.broadcast((h[by], number[by])), n[order], seed)


def pagerank(t: Numbered, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100, every: int = 5, k: int = 20) -> DataFrame:
    """Node, rank: the k greatest of `keywords.pagerank` over `keywords.cooccurrence`. What a word gets is added up over all
    places where words are together, whose sums are those over edges, so that edges are neither made nor dealt."""
    m = len(t.counts)

    def given(x: np.ndarray) -> np.ndarray:
        seen = t.spark.sparkContext.broadcast(x)

        def add(y: np.ndarray, w: np.ndarray, row: np.ndarray) -> None:
            x = seen.value[w]
            inner = np.zeros(len(w))  # as in cooccurrence
            inner[1:] += row[1:] == row[:-1]
            inner[:-2] += row[:-2] == row[2:]
            for step, weight in ((1, inner), (2, np.ones(len(w)))):
                a, b = slice(0, max(0, len(w) - step)), slice(step, None)
                each = np.where((row[a] == row[b]) & (w[a] != w[b]), weight[a], 0.0)
                np.add.at(y, w[a], each * x[b])
                np.add.at(y, w[b], each * x[a])

        out = t.sums(add, m)
        seen.unpersist()
        return out

    total = given(np.ones(m)) if m else np.zeros(0)
    node = total > 0
    n = int(node.sum())
    rank = np.where(node, 1.0 / max(n, 1), 0.0)
    total[~node] = 1.0
    for r in range(1, most + 1 if n else 0):
        old, rank = rank, np.where(node, (1 - damping) / n + damping * given(rank / total), 0.0)
        if r % every == 0 and np.abs(rank - old).sum() < n * tolerance:
            break
    best = np.flatnonzero(node & (rank >= np.partition(rank[node], max(0, n - k))[max(0, n - k)])) if n else np.zeros(0, int)
    found = t.spark.createDataFrame(pa.table({"a": pa.array(best, pa.int32()), "rank": pa.array(rank[best], pa.float64())}))
    return t.with_names(found, "a").select(F.col("a").alias("node"), "rank").orderBy(F.desc("rank"), "node").limit(k)


def trigrams(t: Numbered, k: int = 10) -> DataFrame:
    """`keywords.trigrams` of at least two occurrences."""
    low = F.lit(0xFFFFFFFF)
    pairs = lambda kind, name: t.grams.where(F.col("c") == kind).select(F.col("ab").alias("g_"), F.col("n").cast("double").alias(name))
    found = t.grams.where("c >= 0").select("ab", F.shiftright("ab", 32).cast("int").alias("a"), F.col("ab").bitwiseAND(low).cast("int").alias("b"), "c", F.col("n").cast("double").alias("iii"))
    key = lambda x, y: F.shiftleft(F.col(x).cast("long"), 32).bitwiseOR(F.col(y).cast("long"))
    for words, kind, name in ((F.col("ab"), NEXT, "iix"), (key("b", "c"), NEXT, "xii"), (key("a", "c"), APART, "ixi")):
        found = found.withColumn("g_", words).join(pairs(kind, name), "g_").drop("g_")
    few = t.counts[: t.beyond(2)]
    found = t.looked_up(found, {"ixx": ("a", few), "xix": ("b", few), "xxi": ("c", few)})
    scored = K.trigram_scores(found, float(t.counts.sum()))
    return _best(t, scored.select("a", "b", "c", F.col("iii").cast("long").alias("n"), "score"), "abc", k)


def _best(t: Numbered, scored: DataFrame, columns: str, k: int) -> DataFrame:
    """The first k by score and names; ties at the last score are named too."""
    scored = written(scored, "scored")
    last = scored.select(F.round("score", 6).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.min("s")).first()[0]
    kept = scored.where(F.round("score", 6) >= last) if last is not None else scored
    return t.with_names(kept, columns).select(*columns, "n", "score").orderBy(F.desc(F.round("score", 6)), *columns).limit(k)


def collocations(t: Numbered, least: int = 3, k: int = 10) -> DataFrame:
    """`keywords.collocations`. A word is as often the first of two as it stands in texts, their last places left out."""
    m = len(t.counts)

    def ends(y: np.ndarray, w: np.ndarray, row: np.ndarray) -> None:
        new = np.concatenate((np.ones(min(1, len(row)), bool), row[1:] != row[:-1]))
        np.add.at(y, w[new], 1.0)
        np.add.at(y, w[np.roll(new, -1)] + m, 1.0)

    e = t.sums(ends, 2 * m)
    few = t.beyond(2)
    n = float(t.counts.sum() - e[:m].sum())
    both = t.grams.where((F.col("c") == NEXT) & (F.col("n") >= max(least, 2))).select(F.shiftright("ab", 32).cast("int").alias("a"), F.col("ab").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), F.col("n").alias("nab"))
    found = t.looked_up(both, {"na": ("a", (t.counts - e[m:])[:few]), "nb": ("b", (t.counts - e[:m])[:few])})
    return _best(t, K.pair_scores(found, n).select("a", "b", F.col("nab").alias("n"), "score"), "ab", k)


def tfidf_keywords(t: Numbered, features: int = 100, k: int = 20) -> DataFrame:
    """`keywords.tfidf_keywords` of words and neighbours: counts by document are those of the `features` most frequent terms."""
    pairs = t.grams.where(F.col("c") == NEXT)
    n = [r[0] for r in pairs.select("n").orderBy(F.desc("n")).limit(features).collect()]
    n = sorted([*n, *(int(x) for x in t.counts[:features])], reverse=True)[:features]
    if len(n) < features or n[-1] < 2:  # n-grams that stand once are among them
        return K.tfidf_keywords(t.docs, features, k, 2)
    few = t.beyond(n[-1])
    words = t.spark.range(few).select(F.col("id").cast("int").alias("a"))
    words = t.with_names(t.looked_up(words, {"n": ("a", t.counts[:few])}), "a").select(F.col("a").alias("gram"), F.col("n").cast("long").alias("n"))
    two = pairs.where(F.col("n") >= n[-1]).select(F.shiftright("ab", 32).cast("int").alias("a"), F.col("ab").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n")
    every = words.union(t.with_names(two, "ab").select(F.concat_ws(" ", "a", "b"), "n"))
    top = [r["gram"] for r in every.orderBy(F.desc("n"), "gram").limit(features).collect()]
    return K.top_keywords(t.docs, features, k, 2, top)
