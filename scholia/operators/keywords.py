"""Keywords: TF-IDF, co-occurrence and PageRank, collocations, fusion.

A document's tokens stay one array: n-grams and windows are made inside it, so that the first shuffle is that of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.sources.tables import written


def token_arrays(df: DataFrame, doc: str, words: Column) -> DataFrame:
    """doc, words: one row per document."""
    return df.select(F.col(doc).alias("doc"), words.alias("words"))


def grams(words: Column, n: int, skip: int = 0) -> Column:
    """The n-grams of an array of words, in order, as texts; `skip` words between the first and the others are left out."""
    last = F.size(words) - n - skip
    rest = F.array() if n == 1 else F.transform(F.sequence(F.lit(2), F.lit(n)), lambda k: k + skip)
    text = lambda i: F.array_join(F.concat(F.slice(words, i + 1, 1), F.transform(rest, lambda k: F.get(words, i + k - 1))), " ")
    if not skip:
        text = lambda i: F.array_join(F.slice(words, i + 1, n), " ")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), text)).otherwise(F.array().cast("array<string>"))


# Fixed value: words of a batch that are counted together (a document at least).
WORDS = 200_000


def _slices(batches: Iterator[pa.RecordBatch], column: str = "words") -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows of some WORDS words, their words in a row, and of each word the row."""
    for b in batches:
        many = pc.fill_null(pc.list_value_length(b[column]), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(many, dtype=np.int64), 0
        while at < len(b):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")) - at)
            part = b.slice(at, n)
            yield part, part[column].flatten(), np.repeat(np.arange(n), many[at : at + n])
            at += n


def _apart(flat: pa.Array, row: np.ndarray, places: list[int]) -> tuple[list[pa.Array], np.ndarray]:
    """The words at given places from each word on, where all are of one row, and that row."""
    m = max(0, len(flat) - places[-1])
    same = row[places[-1] :][:m] == row[:m]
    return [flat.slice(k, m).filter(pa.array(same)) for k in places], row[:m][same]


def _texts(flat: pa.Array, row: np.ndarray, n: int, skip: int) -> tuple[pa.Array, np.ndarray]:
    parts, row = _apart(flat, row, [0, *(k + skip for k in range(1, n))])
    return (pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]), row


def gram_counts(docs: DataFrame, kinds: dict[str, tuple[int, int]]) -> DataFrame:
    """kind, gram, n over all documents: n-grams by name with their length and how many words are left out after the first. A
    task counts by slices first, so that what is shuffled are counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, row in _slices(batches):
            for kind, of in kinds.items():
                c = pc.value_counts(_texts(flat, row, *of)[0])
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(c), pa.string()), "gram": c.field("values"), "n": c.field("counts")})

    return docs.select("words").mapInArrow(count, "kind string, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n"))


def term_counts(docs: DataFrame, longest: int = 1, of: list[str] | None = None) -> DataFrame:
    """doc, term, tf of the words and, for a longest above 1, of the n-grams up to it; of given terms only if there are any."""
    if of is None:
        terms = F.concat(F.col("words"), *(grams(F.col("words"), n) for n in range(2, longest + 1)))
        return docs.select("doc", F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    kept = pa.array(of, pa.string())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, row in _slices(batches):
            for n in range(1, longest + 1):
                text, at = _texts(flat, row, n, 0)
                among = pc.is_in(text, kept)
                yield pa.RecordBatch.from_pydict({"doc": part["doc"].take(pa.array(at[among.to_numpy(zero_copy_only=False)])), "term": text.filter(among)})

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "words").mapInArrow(find, f"doc {kind}, term string").groupBy("doc", "term").agg(F.count("*").alias("tf"))


def _top_counts(docs: DataFrame, longest: int, most: int) -> tuple[DataFrame, int]:
    """Counts by document of the `most` most frequent terms, and the number of documents with any term. All terms are counted
    over the corpus first, so that only those few are counted by document."""
    every = gram_counts(docs, {str(n): (n, 0) for n in range(1, longest + 1)})
    return _counts_of(docs, longest, [r["gram"] for r in every.orderBy(F.desc("n"), "gram").limit(most).collect()])


def _counts_of(docs: DataFrame, longest: int, top: list[str]) -> tuple[DataFrame, int]:
    n = docs.where(F.size("words") > 0).select("doc").distinct().count()
    return written(term_counts(docs, longest, top), "term-counts"), n


def tfidf(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Doc, term, weight: tf times smooth idf (ln((1 + n) / (1 + df)) + 1), rows of unit length; of the `most` terms with
    the greatest counts in the corpus (ties: by term)."""
    if most:
        docs = written(docs, "words")  # texts are tokenised once
        return _weights(*_top_counts(docs, 1, most), most)
    counts = written(term_counts(docs), "term-counts")
    n = counts.select("doc").distinct().count()
    return _weights(counts, n, most)


def _weights(counts: DataFrame, n: int, most: int | None) -> DataFrame:
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if most:
        terms = terms.orderBy(F.desc("cf"), "term").limit(most)
    raw = counts.join(terms, "term").withColumn("w", F.col("tf") * (F.log((F.lit(1.0) + n) / (F.col("df") + 1)) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("weight"))


def tfidf_keywords(docs: DataFrame, features: int = 100, k: int = 20, longest: int = 1) -> DataFrame:
    """The k terms with the greatest mean weight over all documents; terms are words and n-grams up to `longest`."""
    return _mean_weights(*_top_counts(written(docs, "words"), longest, features), features, k)


def top_keywords(docs: DataFrame, features: int, k: int, longest: int, top: list[str]) -> DataFrame:
    """`tfidf_keywords` where the most frequent terms are known."""
    return _mean_weights(*_counts_of(docs, longest, top), features, k)


def _mean_weights(counts: DataFrame, n: int, features: int, k: int) -> DataFrame:
    return _weights(counts, n, features).groupBy("term").agg((F.sum("weight") / n).alias("score")).orderBy(F.desc("score"), "term").limit(k)


def cooccurrence(docs: DataFrame) -> DataFrame:
    """Undirected edges (src < dst, weight) of windows of three tokens; neighbours inside count for both windows they
    are in, equal tokens not at all."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, row in _slices(batches):
            m, place = len(flat), np.arange(len(flat))
            inner = np.zeros(m, np.int64)  # windows that word k and its next are both in
            inner[1:] += row[1:] == row[:-1]
            inner[:-2] += row[:-2] == row[2:]
            for step in (1, 2):
                (a, b), _ = _apart(flat, row, [0, step])
                k = place[: max(0, m - step)][row[step:] == row[: max(0, m - step)]]
                weight = inner[k] if step == 1 else np.ones(len(k), np.int64)
                low = pc.less(a, b)
                t = pa.table({"src": pc.if_else(low, a, b), "dst": pc.if_else(low, b, a), "n": weight})
                t = t.filter(pc.and_(pc.not_equal(a, b), pa.array(weight > 0))).group_by(["src", "dst"]).aggregate([("n", "sum")])
                yield from t.rename_columns({"n_sum": "n"}).select(["src", "dst", "n"]).combine_chunks().to_batches()

    return docs.select("words").mapInArrow(edges, "src string, dst string, n long").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100, every: int = 5) -> DataFrame:
    """Node, rank of an undirected weighted graph; stops when the summed change of a round is below n * tolerance, which
    is looked at every few rounds, when the ranks are written (that cuts the lineage too)."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("total"))
    links = written(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    rank = written(links.select(F.col("src").alias("node")).distinct(), "nodes")
    n = rank.count()
    rank = rank.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(1, most + 1 if n else 0):
        got = links.join(rank, links.src == rank.node).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = rank.withColumnRenamed("rank", "old").join(got, F.col("node") == F.col("dst"), "left").select("node", "old", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % every == 0:
            new = written(new, "rank")
            if new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
                return new.select("node", "rank")
        rank = new.select("node", "rank")
    return rank


def _term(o: Column, e: Column) -> Column:
    return F.when(o > 0, o * F.when(e == 0, F.lit(float("inf"))).otherwise(F.log(o / e))).otherwise(0.0)


def collocations(docs: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    """Neighbours by log-likelihood ratio, of at least `least` occurrences."""
    pairs = gram_counts(docs, {"p": (2, 0)}).select("gram", F.col("n").alias("nab"))
    parts = F.split("gram", " ")
    every = written(pairs.select(parts[0].alias("a"), parts[1].alias("b"), "nab"), "pairs")  # texts are tokenised once
    n = every.agg(F.sum("nab")).first()[0] or 0
    both = every.where(F.col("nab") >= least)
    na = every.groupBy("a").agg(F.sum("nab").alias("na"))
    nb = every.groupBy("b").agg(F.sum("nab").alias("nb"))
    t = both.join(na, "a").join(nb, "b")
    return pair_scores(t, float(n)).select("a", "b", F.col("nab").alias("n"), "score").orderBy(F.desc(F.round("score", 6)), "a", "b").limit(k)


def pair_scores(t: DataFrame, n: float) -> DataFrame:
    """t (nab, na, nb) with the log-likelihood ratio of n pairs as score."""
    o11 = F.col("nab").cast("double")
    o12, o21 = F.col("na") - o11, F.col("nb") - o11
    o22 = F.lit(n) - o11 - o12 - o21
    rows, cols = (F.col("na"), F.lit(n) - F.col("na")), (F.col("nb"), F.lit(n) - F.col("nb"))
    llr = 2 * (_term(o11, rows[0] * cols[0] / n) + _term(o12, rows[0] * cols[1] / n) + _term(o21, rows[1] * cols[0] / n) + _term(o22, rows[1] * cols[1] / n))
    return t.withColumn("score", llr)


def trigrams(docs: DataFrame, least: int = 2, k: int = 10) -> DataFrame:
    """Three words in a row by log-likelihood ratio against independence (eight cells of words present or not), of at
    least `least` occurrences. One pass counts words, neighbours, words two apart and trigrams."""
    counts = written(gram_counts(docs, {"w": (1, 0), "p": (2, 0), "s": (2, 1), "t": (3, 0)}), "grams")
    total = float(counts.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0)
    p = F.split("gram", " ")
    t = counts.where((F.col("kind") == "t") & (F.col("n") >= least)).select(*(p[i].alias(x) for i, x in enumerate("abc")), F.col("n").cast("double").alias("iii"))

    def with_count(t: DataFrame, kind: str, words: str, name: str) -> DataFrame:
        found = counts.where(F.col("kind") == kind).select(F.col("gram").alias("g_"), F.col("n").cast("double").alias(name))
        return t.withColumn("g_", F.concat_ws(" ", *words)).join(found, "g_").drop("g_")

    for kind, words, name in (("w", "a", "ixx"), ("w", "b", "xix"), ("w", "c", "xxi"), ("p", "ab", "iix"), ("p", "bc", "xii"), ("s", "ac", "ixi")):
        t = with_count(t, kind, list(words), name)
    return trigram_scores(t, total).select("a", "b", "c", F.col("iii").cast("long").alias("n"), "score").orderBy(F.desc(F.round("score", 6)), "a", "b", "c").limit(k)


def trigram_scores(t: DataFrame, total: float) -> DataFrame:
    """t (counts of three words, of two of them and of one) with the log-likelihood ratio as score."""
    c = {k: F.col(k) for k in ("iii", "iix", "ixi", "xii", "ixx", "xix", "xxi")}
    o = {"iii": c["iii"], "oii": c["xii"] - c["iii"], "ioi": c["ixi"] - c["iii"], "iio": c["iix"] - c["iii"]}
    o["ooi"] = c["xxi"] - o["iii"] - o["oii"] - o["ioi"]
    o["oio"] = c["xix"] - o["iii"] - o["oii"] - o["iio"]
    o["ioo"] = c["ixx"] - o["iii"] - o["ioi"] - o["iio"]
    o["ooo"] = F.lit(total) - sum(o.values())
    share = {("i", 0): c["ixx"], ("i", 1): c["xix"], ("i", 2): c["xxi"]}
    share |= {("o", j): F.lit(total) - share["i", j] for j in range(3)}
    llr = 2 * sum((_term(n, share[x[0], 0] * share[x[1], 1] * share[x[2], 2] / (total * total)) for x, n in o.items()), F.lit(0.0))
    return t.withColumn("score", llr)


def fused(lists: list[tuple[DataFrame, float]], k: int = 15, most: int = 1000) -> DataFrame:
    """Ranked lists (term, score) summed by (n - i) / n of their places, or by a fixed weight where one is given. A list
    is its first `most` terms."""
    out = None
    for df, fixed in lists:
        top = df.orderBy(F.desc("score"), "term").limit(most).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))).alias("l"))
        ranked = top.select(F.size("l").alias("n"), F.posexplode("l").alias("i", "x"))
        part = ranked.select("x.term", (F.lit(float(fixed)) if fixed else (F.col("n") - F.col("i")) / F.col("n")).alias("w"))
        out = part if out is None else out.union(part)
    return out.groupBy("term").agg(F.sum("w").alias("score")).orderBy(F.desc("score"), "term").limit(k)
