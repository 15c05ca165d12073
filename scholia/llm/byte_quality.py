"""Quality from bytes: a convolutional network in numpy over overlapping chunks of the whole text.

Network: bytes are embedded (EMBED numbers); FILTERS learned filters of WIDTH bytes move over each chunk in steps of STRIDE;
their rectified answers are max-pooled within the chunk and go through a layer of HIDDEN rectified units. Chunks have CHUNK
bytes and begin every CHUNK - WIDTH bytes up to the text's end, so every window of a filter lies in some chunk and no byte
is left out. A document is the mean and the maximum of its chunks' units, and one logistic unit turns them into the
probability of label 1. Only bytes enter: no label, language, source or id.

Fitting: at most FIT_ROWS labelled rows, chosen by hash, each with at most FIT_CHUNKS chunks spread evenly over its whole
text (a bounded sample: under FIT_ROWS * FIT_CHUNKS * CHUNK bytes reach the driver). Adam steps with a fixed seed minimise
the log loss, weighted so that the rarer label counts RARE times its share's root; the weights are then frozen. Scoring
takes whole texts, chunk by chunk in blocks, so memory does not grow with a text's length.

Defined results: a null or empty text is one chunk of padding and gets a score like any other; labels that are null or
neither 0 nor 1 do not train, and several labels of a document count once (the greatest); without labelled rows, or with
one label alone, the score is the smoothed share of label 1 (0.5 with none); a null doc_id is not held out; repeated rows are
scored one by one; empty tables give empty tables; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.scratch import Scratch
from scholia.llm.textblock import Block, blocks

CHUNK, WIDTH, STRIDE = 256, 12, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
FIT_ROWS, FIT_CHUNKS = 4000, 16
EPOCHS, BATCH, RATE, SEED = 10, 64, 4e-3, 7
#: Chunks of a document in one step of the fit, drawn anew each time.
DRAWN = 6
#: Chunks scored at once.
GROUP = 512


def chunk_starts(size: int) -> np.ndarray:
    """Places of the chunks of a text of `size` bytes: every window of WIDTH bytes lies in one of them."""
    step = CHUNK - WIDTH
    return np.arange(max(1, -(-(size - WIDTH) // step)), dtype=np.int64) * step


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks (rows of CHUNK bytes, zeros behind `end`) that begin at these places."""
    at = start[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        self.embed = rng.standard_normal((256, EMBED)).astype(np.float32)
        self.filters, self.bias = normal(WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32)
        self.dense, self.lift = normal(FILTERS, HIDDEN), np.full(HIDDEN, 0.1, np.float32)
        self.out, self.prior = normal(2 * HIDDEN) * np.float32(0.1), np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.lift, self.out, self.prior]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """A view (chunks, places, WIDTH * EMBED) of the embedded bytes."""
        e = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)
        return w[:, :: STRIDE * EMBED]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filters' maxima over each chunk, their places, and the windows."""
        w = self.windows(chunks)
        a = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(*w.shape[:2], FILTERS)
        best = a.argmax(1)
        return np.maximum(np.take_along_axis(a, best[:, None], 1)[:, 0] + self.bias, 0), best, w

    def units(self, chunks: np.ndarray) -> np.ndarray:
        w = self.windows(chunks)
        a = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(*w.shape[:2], FILTERS).max(1)
        return np.maximum(np.maximum(a + self.bias, 0) @ self.dense + self.lift, 0)

    def probability(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = np.concatenate((mean, most), 1) @ self.out + self.prior
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, chunks: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss of documents (rows) with equally many chunks each: chunks (documents, k, CHUNK)."""
        n, k, _ = chunks.shape
        flat = chunks.reshape(n * k, CHUNK)
        pooled, best, w = self.pooled(flat)
        h = np.maximum(pooled @ self.dense + self.lift, 0)
        by = h.reshape(n, k, HIDDEN)
        top = by.argmax(1)
        doc = np.concatenate((by.mean(1), by.max(1)), 1)
        p = 1 / (1 + np.exp(-(doc @ self.out + self.prior)))
        dz = ((p - label) * weight / n).astype(np.float32)
        g_out, g_prior = doc.T @ dz, dz.sum(keepdims=True)
        d_doc = dz[:, None] * self.out
        dh = np.repeat(d_doc[:, None, :HIDDEN] / k, k, 1)
        rows, cols = np.arange(n)[:, None], np.arange(HIDDEN)[None]
        dh[rows, top, cols] += d_doc[:, HIDDEN:]
        dh = dh.reshape(n * k, HIDDEN) * (h > 0)
        g_dense, g_lift = pooled.T @ dh, dh.sum(0)
        dp = (dh @ self.dense.T) * (pooled > 0)
        chosen = w[np.arange(n * k)[:, None], best]  # (chunks, FILTERS, WIDTH * EMBED)
        g_filters, g_bias = np.einsum("cf,cfw->wf", dp, chosen), dp.sum(0)
        d_window = (dp[:, :, None] * self.filters.T).reshape(n * k, FILTERS, WIDTH, EMBED)
        at = best[:, :, None] * STRIDE + np.arange(WIDTH)
        seen = np.take_along_axis(flat[:, None], at, 2)
        g_embed = np.zeros_like(self.embed)
        for d in range(EMBED):
            g_embed[:, d] = np.bincount(seen.ravel(), d_window[..., d].ravel(), 256)
        return [g_embed, g_filters, g_bias, g_dense, g_lift, g_out, g_prior]


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam steps over documents (their chunks) with labels 0 and 1, both of which occur."""
    net, rng = Network(seed), np.random.default_rng(seed)
    w = net.weights()
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    share = labels.mean()
    weight = np.where(labels > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share))).astype(np.float32)
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            now = order[a : a + BATCH]
            drawn = np.stack([texts[i][np.sort(rng.permutation(max(DRAWN, len(texts[i])))[:DRAWN] % len(texts[i]))] for i in now])
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for x, g, m, v in zip(w, net.gradients(drawn, labels[now].astype(np.float32), weight[now]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, s: Scratch, fit_rows: int = FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Chunks and labels of at most fit_rows labelled rows that are not held out, in a fixed order."""
    named = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = named.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows rows of an id and a label: a proven bound
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(s.keep(chosen, "labels")), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches):
            told = []
            for a, z in zip(b.off[:-1], b.off[1:], strict=True):
                starts = a + chunk_starts(int(z - a))
                if len(starts) > FIT_CHUNKS:
                    starts = starts[np.linspace(0, len(starts) - 1, FIT_CHUNKS).round().astype(np.int64)]
                told.append(_cut(b.data, starts, np.full(len(starts), z)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(told, pa.binary())], names=["doc_id", "quality", "chunks"])

    made = rows.mapInArrow(cut, "doc_id long, quality int, chunks binary")
    # repeated rows of one doc_id: the first of them in byte order, so that the bound holds
    got = made.groupBy("doc_id").agg(F.min(F.struct("chunks", "quality")).alias("x")).select("x.*").toPandas()
    got = got.sort_values(["chunks", "quality"])
    return [np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x in got["chunks"]], got["quality"].to_numpy(np.int64)


def score_block(net: Network, b: Block) -> np.ndarray:
    """The probability of every row, from all chunks of its text."""
    starts = [chunk_starts(int(n)) for n in np.diff(b.off)]
    n = np.array([len(x) for x in starts])
    row = np.repeat(np.arange(b.n), n)
    start = np.concatenate(starts) + b.off[row]
    total, most = np.zeros((b.n, HIDDEN)), np.zeros((b.n, HIDDEN))  # units are never negative
    for a in range(0, len(row), GROUP):
        at = slice(a, a + GROUP)
        h = net.units(_cut(b.data, start[at], b.off[row[at] + 1]))
        np.add.at(total, row[at], h)
        np.maximum.at(most, row[at], h)
    return net.probability(total / n[:, None], most)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text); labels (doc_id, quality) train."""
    spark = docs.sparkSession
    s = Scratch(spark, "bytes")
    texts, marks = sample(docs, labels, s, fit_rows)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    s.sweep(slim)
    if len(set(marks.tolist())) < 2:
        share = (float(marks.sum()) + 1) / (len(marks) + 2)
        return slim.select("doc_id", F.lit(share).alias("score"))
    shared = spark.sparkContext.broadcast(train(texts, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_block(shared.value, b).astype(float))], names=["doc_id", "score"])

    return slim.mapInArrow(run, "doc_id long, score double")
