"""Similarity joins and order statistics against plain loops, on inputs with hot groups."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scholia.operators import clauses as L
from scholia.operators import stats as S
from scholia.operators import vectors as V


def brute_similarity(x, y):
    (wx, px, sx), (wy, py, sy) = x, y
    a, b = set(wx.split()), set(wy.split())
    if not a or not b:
        return 0.0
    return min(1.0, len(a & b) / len(a | b) + 0.3 * (px == py) + 0.2 * bool(set(sx) & set(sy)))


def test_similar_clauses_equal_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{min(int(rnd.paretovariate(0.6)), 400)}" for _ in range(20_000)]
    rows = []
    for doc, n in ((1, 700), (2, 60), (3, 1)):
        for o in range(n):
            w = [rnd.choice(words) for _ in range(rnd.randint(0, 9))]
            if rows and rnd.random() < 0.2:
                w = rows[-1][2].split()[: rnd.randint(0, 9)]
            rows.append((doc, o, " ".join(w), w[1] if len(w) > 1 else None, w[:1]))
    df = spark.createDataFrame(rows, "doc long, ord int, normalized_form string, predicate string, subjects array<string>")
    for limit in (0.7, 0.4):
        got = {(r["doc"], r["a_ord"], r["b_ord"]): round(r["similarity"], 9) for r in L.similar_pairs(df, limit).collect()}
        want = {}
        for i, (d, o, *x) in enumerate(rows):
            for e, p, *y in rows[i + 1 :]:
                if d == e and (s := brute_similarity(x, y)) > limit:
                    want[d, o, p] = round(s, 9)
        assert got == want


def test_a_long_document_does_not_pair_all_its_clauses(spark):
    rnd = random.Random(2)
    rows = [(1, o, "the of " + " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(8)), f"p{o}", [f"s{o}"]) for o in range(5000)]
    df = spark.createDataFrame(rows, "doc long, ord int, normalized_form string, predicate string, subjects array<string>")
    assert L.similar_pairs(df).count() < 50  # ended at all: 12.5 million pairs share words


def test_quantiles_of_hot_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.integers(0, 4000, 9000)] + [("few", float(x)) for x in (3, 1, 2, 2)] + [(None, 5.0), ("none", None), ("one", -2.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in S.quantiles(df, ["g"], "v", {"q1": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    for g in ("hot", "few", None, "one"):
        v = [x for h, x in rows if h == g and x is not None]
        assert np.allclose([got[g]["q1"], got[g]["mid"], got[g]["top"]], [np.quantile(v, q) for q in (0.25, 0.5, 1.0)])
    assert "none" not in got
    told = {r["g"]: r for r in S.summary(df, ["g"], "v").collect()}
    assert told["few"]["median"] == 2.0 and told["none"]["median"] is None and told[None]["median"] == 5.0
    whole = S.summary(df, [], "v").first()
    assert whole["median"] == np.median([x for _, x in rows if x is not None])


def test_chains_meet_on_two_words(spark):
    rnd = random.Random(4)
    rows = [(o % 3, o, " ".join(rnd.choice("abcdefghij") for _ in range(3)), " ".join(rnd.choice("abcdefghij") for _ in range(4))) for o in range(120)]
    got = {(r["i"], r["j"]): round(r["strength"], 9) for r in L.chains(spark.createDataFrame(rows, "doc int, ord int, conclusion string, premise string")).collect()}
    want = {}
    for d, i, c, _ in rows:
        for e, j, _, p in rows:
            n = len(set(c.split()) & set(p.split()))
            if d == e and i < j and n >= 2:
                want[i, j] = round(n / max(len(set(c.split())), len(set(p.split()))), 9)
    assert got == want


def test_chain_links_count_the_pairs(spark, monkeypatch):
    """Many arguments of a few texts: their pairs are counted, not made."""
    monkeypatch.setattr(L, "RANGE", 7)
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    texts = [(text(3), text(4)) for _ in range(9)]
    rows = [(o % 3, o, *rnd.choice(texts)) for o in range(150)]
    df = spark.createDataFrame(rows, "doc int, ord int, conclusion string, premise string")
    pairs = [(r["i"], r["j"], r["strength"]) for r in L.chains(df).collect()]
    got = L.chain_links(df).collect()
    assert len(got) == len(rows)
    for r in got:
        after = [s for i, _, s in pairs if i == r["ord"]]
        assert (r["n_next"], r["n_prev"]) == (len(after), sum(j == r["ord"] for _, j, _ in pairs)) and abs(r["strength"] - sum(after)) < 1e-9
        assert r["class_id"] == min(o for d, o, *x in rows if d == r["doc"] and x == [*rows[r["ord"]][2:]])


def test_similar_clauses_shuffle_no_words(spark):
    """The clauses are dealt once; words and pairs stay in the task."""
    c = spark.createDataFrame([(1, 0, "a b c", "b", ["a"])], "doc long, ord int, normalized_form string, predicate string, subjects array<string>")
    plan = L.similar_pairs(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_neighbours_of_many_vectors(spark):
    """The nearest rows of 12,000 vectors with copies, without sorting every block of products."""
    import time

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(12_000, 16)).round(2)
    x[rnd.choice(12_000, 4000, replace=False)] = x[rnd.integers(0, 50, 4000)]
    x[77] = 0
    d = spark.createDataFrame(pa.table({"vec_id": np.arange(12_000), "embedding": pa.array(list(x))})).repartition(4).cache()
    assert d.count() == 12_000
    began = time.time()
    got = {}
    for r in V.top_neighbours(d, d, "vec_id", "embedding", 5, held=3000).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    assert time.time() - began < 15
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    assert len(got) == 12_000
    for k in [77, *range(0, 12_000, 60)]:
        s = (unit * unit[k]).sum(1)  # equal vectors have equal sums
        s[k] = -3
        assert [v for _, v in sorted(got[k])] == np.lexsort((np.arange(12_000), -s))[:5].tolist()
