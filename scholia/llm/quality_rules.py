"""Quality rules judged by host: rule failures, shrunk by an empirical beta prior, decide about whole hosts.

1. Each text gets its counts and the document rule (``base_failed``).
2. Failures are summed by host with map-side partial sums, so a host with a third of all rows costs one row a task.
3. A beta prior is fitted to all hosts' rates by moments; each host's rate is shrunk to it.
4. Verdicts are joined back on slim rows (no texts); Spark broadcasts them only below its size limit and otherwise
   sort-merges, where AQE splits a hot host.

Defined results: a null text has no words (and so fails the document rule); a null host has no host verdict; an empty
table gives an empty table; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.scratch import TEXTS, Scratch
from scholia.llm.textblock import Block, blocks, mix, per_row, spans

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_MAX_RATE = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dup_lines(b: Block, prefix: np.ndarray, starts: np.ndarray) -> np.ndarray:
    cut = np.flatnonzero(b.data == 10)
    full = b.off[:-1][np.diff(b.off) > 0]
    begin = np.union1d(full, cut + 1)
    begin = begin[begin < len(b.data)]
    if not len(begin):
        return np.zeros(b.n, np.int64)
    row = b.row_of(begin)
    nxt = np.append(begin[1:], len(b.data))
    end = np.minimum(nxt, b.off[row + 1])
    end = end - ((end > begin) & (b.data[np.maximum(end - 1, 0)] == 10))
    word = np.searchsorted(starts, begin, "left") < np.searchsorted(starts, end, "left")
    # a word that begins before the line cannot reach into it: lines begin after a space or with the text
    begin, end, row = begin[word], end[word], row[word]
    h = spans(prefix, begin, end)
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=b.n).astype(np.int64)


def _repeats(b: Block, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) < 3:
        return np.zeros(b.n, np.int64)
    row = b.row_of(starts)
    h = spans(prefix, starts, ends)
    w = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
    at = np.flatnonzero(row[:-2] == row[2:])
    order = at[np.lexsort((w[at], row[at]))]
    same = (w[order][1:] == w[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(starts), bool)
    for k in range(3):
        hit[order[twice] + k] = True
    return np.bincount(row[hit], minlength=b.n).astype(np.int64)


def counts(b: Block) -> dict[str, np.ndarray]:
    """The five counts of each text of a block."""
    starts, ends = b.words()
    prefix = b.prefix()
    points = np.concatenate(([0], np.cumsum((b.data & 0xC0) != 0x80)))
    row = b.row_of(starts)
    return {
        "n_words": np.bincount(row, minlength=b.n).astype(np.int64),
        "word_chars": np.bincount(row, points[ends] - points[starts], b.n).astype(np.int64),
        "n_symbols": per_row(b, np.flatnonzero(_SYMBOL[b.data])),
        "n_dup_lines": _dup_lines(b, prefix, starts),
        "n_repeat_words": _repeats(b, prefix, starts, ends),
    }


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five counts of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches):
            got = counts(b)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *(pa.array(got[k]) for k in _METRICS)], names=["doc_id", "host", *_METRICS])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{k} long" for k in _METRICS))


def host_quality(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, host_max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """doc_id, host, counts, base_failed, the host's shrunk failure rate, and kept."""
    spark = docs.sparkSession
    s = Scratch(spark, "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = s.keep(document_counts(docs, host).withColumn("base_failed", failed), "rows", TEXTS)
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    hosts = s.keep(hosts, "hosts")
    # Beta prior by moments over hosts: three sums, however many hosts there are
    rate = F.col("f") / F.col("n")
    m, v, k = hosts.agg(F.avg(rate), F.var_pop(rate), F.count("*")).first()
    alpha, beta = beta_prior(m, v) if k else (1.0, 1.0)
    verdict = hosts.select(F.col("host"), ((F.col("f") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))).alias("host_rate"))
    out = rows.join(verdict, "host", "left")
    return s.sweep(out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= host_max_rate)))


def beta_prior(mean: float, var: float) -> tuple[float, float]:
    """Alpha and beta with these moments; a strength of 2 to 1000 rows, and never a mean of exactly 0 or 1."""
    mean = min(max(mean, 0.01), 0.99)
    strength = mean * (1 - mean) / var - 1 if var > 0 else 1000.0
    strength = min(max(strength, 2.0), 1000.0)
    return mean * strength, (1 - mean) * strength
