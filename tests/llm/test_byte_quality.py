"""The byte network against plain loops, numeric gradients, held-out accuracy and edge cases."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import byte_quality as quality
from scholia.llm.textblock import column


def brute_score(net, text):
    data = text.encode()
    starts, at = [], 0
    while True:  # chunks until every window of the text lies in one
        starts.append(at)
        if at + quality.CHUNK >= len(data):
            break
        at += quality.CHUNK - quality.WIDTH
    units = []
    for a in starts:
        chunk = data[a : a + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            x = np.concatenate([net.embed[c] for c in chunk[p : p + quality.WIDTH]])
            best = np.maximum(best, x @ net.filters)
        units.append(np.maximum(np.maximum(best + net.bias, 0) @ net.dense + net.lift, 0))
    z = np.concatenate((np.mean(units, 0), np.max(units, 0))) @ net.out + net.prior[0]
    return 1 / (1 + np.exp(-z))


def network(seed=1):
    net = quality.Network(seed)
    net.out[:] = np.random.default_rng(seed).standard_normal(len(net.out))
    return net


def test_scores_equal_plain_loops():
    rnd = random.Random(1)
    texts = ["", "a", "é" * 60, "x" * 256, "y" * 257, "z" * 500, "w" * 501] + ["".join(rnd.choice("ab &|é\n") for _ in range(rnd.randint(1, 1500))) for _ in range(12)]
    net = network()
    got = quality.score_block(net, column(pa.array(texts)))
    assert np.allclose(got, [brute_score(net, t) for t in texts], atol=1e-4)


def test_every_window_lies_in_a_chunk():
    for n in range(0, 1400):
        starts = quality.chunk_starts(n)
        assert starts[0] == 0 and (starts[1:] < max(1, n)).all()
        assert all(any(s <= p and min(n, p + quality.WIDTH) <= s + quality.CHUNK for s in starts) for p in range(0, max(1, n - quality.WIDTH + 1)))


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = network(2)
    for x in net.weights():
        x *= np.float32(0.5)
    chunks, label, weight = rng.integers(0, 256, (3, 4, quality.CHUNK)).astype(np.uint8), np.array([1, 0, 1], np.float32), np.array([1, 2, 0.5], np.float32)

    def loss():
        h = net.units(chunks.reshape(-1, quality.CHUNK)).reshape(3, 4, -1).astype(float)
        p = net.probability(h.mean(1), h.max(1))
        return float((-weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean())

    for x, g in zip(net.weights(), net.gradients(chunks, label, weight), strict=True):
        flat, grad = x.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(grad))[:3]:
            old, e = flat[k], np.float32(2e-3)
            flat[k] = old + e
            up = loss()
            flat[k] = old - e
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * e) - grad[k]) < 0.05 * abs(grad[k]) + 2e-3


def rows(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    out = []
    for k in range(n):
        good = k % 3 > 0
        words = [word() + ("" if good else rnd.choice(["###", "&&&"])) for _ in range(rnd.randint(5, 120))]
        out.append((k, " ".join(words), int(good)))
    return out


def test_held_out_accuracy_and_edges(spark):
    data = rows(5, 420)
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, quality int")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "é" * (3 << 20)), (None, "abc def"), (1003, "abc"), (1003, "abc")], "doc_id long, text string")
    more = spark.createDataFrame([(0, 1), (7, None), (8, 5), (None, 1), (1, 1)], "doc_id long, quality int")
    clash = docs.union(odd).withColumns({c: F.lit("x") for c in ("quality", "score", "chunks", "held_out", "label")})
    got = quality.classify(clash, labels.union(more)).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(data) + 6 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [(by[k]["score"] >= 0.5) == bool(y) for k, _, y in data if by[k]["held"]]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert by[1000]["score"] == by[1001]["score"] and not by[None]["held"]
    # no label of a held-out row is used: turning them all over changes nothing
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    same = {r["doc_id"]: r["score"] for r in quality.classify(docs, turned).collect()}
    plain = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert same == plain
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {round(r["score"], 3) > 0.9 for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {True}
    assert quality.classify(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_quality_of_a_whole_table(spark):
    from scholia.llm.queries import op11_quality_classifier

    out = op11_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) >= 0.92
