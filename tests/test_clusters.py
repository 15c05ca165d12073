"""Sweeps, splits, label flows and centres against plain versions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import clusters as L
from scholia.operators import vectors as V


def brute_density(xy, eps, least):
    """Labels as positions: the smallest core point of the component; -1 for noise."""
    n = len(xy)
    near = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(n), n)
    links = near & core[None]
    while True:
        low = np.where(core, np.where(links, label[None], n).min(1), n)
        if (low == label).all():
            break
        label = low
    out = np.where(links, label[None], n).min(1)
    return np.where(out == n, -1, out)


def plane(n, seed=0):
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, s, (n // 8, 2)) for c, s in (((0, 0), 0.3), ((9, 1), 0.4), ((0, 9), 0.2), ((9, 9), 1.5))]
    few = [rng.normal(rng.uniform(-30, 30, 2), 0.2, (k, 2)) for k in (6, 7, 8, 9, 12, 20, 5, 3, 4)]
    rest = rng.uniform(-40, 40, (n - sum(map(len, blobs)) - sum(map(len, few)), 2))
    xy = np.concatenate((*blobs, *few, rest))
    xy[5] = xy[6] = xy[7]
    return xy[rng.permutation(len(xy))]


@pytest.fixture(scope="module")
def points(spark):
    xy = plane(2000)
    return xy, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double").cache()


def test_sweep_equals_brute_force_in_every_run(spark, points):
    xy, df = points
    scaled = (xy - xy.mean(0)) / xy.std(0)
    got = {}
    for r in L.density_sweep(V.standardised(df.withColumnRenamed("id", "key"), ["x", "y"]).repartition(3)).collect():
        got[r["run"], r["key"]] = -1 if r["cluster"] is None else r["cluster"]
    suitable = []
    for run, (eps, least) in enumerate(L.SETTINGS):
        want = brute_density(scaled, eps, least)
        assert [got[run, k] for k in range(len(xy))] == want.tolist(), run
        ids, n = np.unique(want[want >= 0], return_counts=True)
        suitable.append(int(((n >= 5) & (n <= 25)).sum()))
    # small settings, so that cells are halved and borders met
    small = ((0.05, 3), (0.02, 4), (0.11, 5))
    got = {(r["run"], r["key"]): -1 if r["cluster"] is None else r["cluster"] for r in L.density_sweep(df.selectExpr("id AS key", "x / 20 AS x", "y / 20 AS y"), small).collect()}
    for run, (eps, least) in enumerate(small):
        assert [got[run, k] for k in range(len(xy))] == brute_density(xy / 20, eps, least).tolist(), run


def test_chosen_run(spark):
    rng = np.random.default_rng(4)
    far = np.concatenate([rng.normal(c, 0.05, (n, 2)) for c, n in zip(((0, 0), (40, 0), (0, 40), (40, 40), (20, 20)), (8, 12, 12, 30, 6), strict=True)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(far)], "id long, x double, y double")
    told, members = L.spatial_clusters(df, "id", "x", "y")
    rows = told.orderBy(F.desc("n"), "cluster").collect()
    scaled = (far - far.mean(0)) / far.std(0)
    runs = []
    for eps, least in L.SETTINGS:
        ids, n = np.unique(brute_density(scaled, eps, least), return_counts=True)
        runs.append([(-int(k), int(i)) for i, k in zip(ids, n, strict=True) if i >= 0 and 5 <= k <= 25])
    best = max(range(len(runs)), key=lambda k: (len(runs[k]), -k))
    assert {(r["method"], r["eps"], r["points"]) for r in rows} == {("density", *L.SETTINGS[best])}
    assert [(-r["n"], r["cluster"]) for r in rows] == sorted(runs[best])[:10]
    assert members.count() == sum(r["n"] for r in rows)
    tight = spark.createDataFrame([(i, float(i % 6), float(i // 6)) for i in range(48)], "id long, x double, y double")
    assert {r["method"] for r in L.spatial_clusters(tight, "id", "x", "y")[0].collect()} == {"k-means"}


def brute_split(rows, parts, rounds=25):
    """rows: (key, x, y) of one cluster."""
    rows = sorted(rows)
    xy = np.array([r[1:] for r in rows], float)
    off = lambda c: ((xy - c) ** 2).sum(1)
    centres = [xy[off(xy.mean(0)).argmin()]]
    while len(centres) < parts:
        centres.append(xy[np.min([off(c) for c in centres], 0).argmax()])
    for _ in range(rounds):
        part = np.argmin([off(c) for c in centres], 0)
        new = [xy[part == k].mean(0) if (part == k).any() else c for k, c in enumerate(centres)]
        done, centres = np.allclose(new, centres, rtol=0, atol=1e-12), new
        if done:
            break
    return {r[0]: int(p) for r, p in zip(rows, np.argmin([off(c) for c in centres], 0), strict=True)}


def test_splits_of_many_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(100 * c + k, f"c{c}", float(x), float(y)) for c, n in enumerate((3, 20, 60, 95)) for k, (x, y) in enumerate(rng.normal(0, 3, (n, 2)))]
    rows += [(900 + k, "ties", 1.0, 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "key long, cluster string, x double, y double").repartition(5)
    parts = F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.col("n") / 15))).cast("int")
    for held in (L.HELD, 30):  # 30: the larger ones by rounds of sums
        got = {}
        for r in L.split_many(df, parts, held=held).collect():
            got.setdefault(r["cluster"], {})[r["key"]] = r["part"]
        for c in {r[1] for r in rows}:
            own = [(k, x, y) for k, d, x, y in rows if d == c]
            assert got[c] == brute_split(own, min(4, max(2, len(own) // 15))), (held, c)


LABELS = ["dna repair pathway", "Mixed Research Topic", "Label: protein kinase signaling", "general words"]


def namer(members, kind):
    """A stand-in for a model: the label follows from the cluster's name and the kind of call."""
    k = (F.crc32(F.concat("cluster", F.lit(":" + kind))) % len(LABELS)).cast("int")
    return members.select("cluster").distinct().withColumn("label", F.get(F.array(*map(F.lit, LABELS)), k))


def brute_flow(rows, labels):
    """rows: (key, cluster, x, y). The flow cluster by cluster: cluster -> (label, how, size)."""
    technical = lambda x: x is not None and ("dna" in x or "protein" in x)

    def asked(c, kind):
        x = LABELS[zlib.crc32(f"{c}:{kind}".encode()) % len(LABELS)].removeprefix("Label: ")
        return x if technical(x) else None

    now = {c: [[(k, x, y) for k, d, x, y in rows if d == c], labels[c], "given"] for c in labels}

    def split(c, size, parts, least, kinds, mark):
        own = now[c][0]
        if len(own) < size:
            return False
        part, good = brute_split(own, parts(len(own))), {}
        for j in range(parts(len(own))):
            mine = [r for r in own if part[r[0]] == j]
            label = next((x for x in (asked(f"{c}_{mark}_{j}", kind) for kind in kinds) if x), None)
            if len(mine) >= least and label:
                good[f"{c}_{mark}_{j}"] = [mine, label, mark]
        if len(good) < 2:
            return False
        del now[c]
        now.update(good)
        return True

    for c in sorted(now):
        if technical(now[c][1]):
            continue
        if asked(c, "synthesis"):
            now[c][1:] = [asked(c, "synthesis"), "synthesis"]
        elif not split(c, 15, lambda n: min(4, max(2, n // 15)), 5, ["topic", "synthesis"], "split"):
            now[c][1:] = [None, "place"]
    for c in sorted(now):
        if technical(now[c][1]):
            continue
        if asked(c, "deep"):
            now[c][1:] = [asked(c, "deep"), "deep"]
        else:
            split(c, 10, lambda n: min(6, max(3, n // 8)), 3, ["deep", "topic"], "finer")
    return now


def test_label_flow(spark):
    rng = np.random.default_rng(8)
    sizes = {f"k{c}": n for c, n in enumerate((4, 30, 80, 12, 45, 60, 17, 9, 11, 33, 70, 25, 16, 40))}
    rows = [(1000 * i + k, c, float(x), float(y)) for i, (c, n) in enumerate(sizes.items()) for k, (x, y) in enumerate(rng.normal(0, 9, (n, 2)))]
    labels = {c: "dna repair pathway" if i % 7 == 0 else "Mixed Research Topic" for i, c in enumerate(sizes)}
    df = spark.createDataFrame(rows, "key long, cluster string, x double, y double")
    told, members = L.refined_clusters(df, spark.createDataFrame(list(labels.items()), "cluster string, label string"), namer)
    got = {r["cluster"]: r for r in told.collect()}
    want = brute_flow(rows, labels)
    assert set(got) == set(want)
    for c, (own, label, how) in want.items():
        assert got[c]["n"] == len(own)
        if label is None:  # named after its neighbours or its place
            assert got[c]["how"] in ("place", "neighbour", "place and size") and got[c]["label"]
        else:
            assert (got[c]["label"], got[c]["how"]) == (label, how)
    assert {(r["key"], r["cluster"]) for r in members.collect()} == {(k, c) for c, (own, *_) in want.items() for k, *_ in own}
    assert {"split", "synthesis", "deep", "given"} <= {r["how"] for r in got.values()}


def test_centres_are_the_greedy_choice(spark):
    rng = np.random.default_rng(5)
    near = {d: set(rng.integers(0, 300, rng.integers(0, 5)).tolist()) - {d} for d in range(300)}
    near = {d: x or {(d + 1) % 300} for d, x in near.items()}
    groups = spark.createDataFrame([(d, e) for d, x in near.items() for e in x], "doc long, near long")
    order = lambda d: (zlib.crc32(str(d).encode()), d)
    taken, used = [], set()
    for d in sorted(near, key=order):
        if not ({d} | near[d]) & used:
            taken.append(d)
            used |= {d} | near[d]
    for most in (5, 1000):
        got = L.disjoint_centres(groups, F.crc32(F.col("doc").cast("string")), most)
        assert [r["doc"] for r in got.orderBy("place").collect()] == taken[:most]
    centres = L.disjoint_centres(groups, F.crc32(F.col("doc").cast("string")), 5)
    want = {}
    for i, c in enumerate(taken[:5]):
        for d in {c} | near[c]:
            want.setdefault(d, i)
    docs = spark.range(300).withColumnRenamed("id", "doc")
    assert {r["doc"]: r["cluster"] for r in L.assigned(docs, groups, centres).collect()} == {d: want.get(d, -1) for d in range(300)}


def test_centres_drop_what_comes_too_late(spark, monkeypatch):
    """The first five of the greedy choice among 3,000 documents; after the first round only documents before the fifth stay."""
    import random

    from scholia.operators import clusters

    rnd, sizes, write = random.Random(4), [], clusters.written
    near = {k: [k, *rnd.sample(range(3000), 3)] for k in range(3000)}
    order = {k: k * 7919 % 3001 for k in near}

    def told(df, name="t"):
        out = write(df, name)
        if name == "groups":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(clusters, "written", told)
    groups = spark.createDataFrame([(k, e) for k, v in near.items() for e in v if e != k], "doc long, near long")
    got = clusters.disjoint_centres(groups, F.col("doc") * 7919 % 3001, 5).collect()
    taken, used = [], set()
    for k in sorted(near, key=order.get):
        if len(taken) < 5 and not used & set(near[k]):
            taken.append(k)
            used |= set(near[k])
    assert [r["doc"] for r in sorted(got, key=lambda r: r["place"])] == taken
    assert max(sizes[1:]) < 0.02 * sizes[0]
