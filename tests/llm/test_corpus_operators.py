"""Near duplicates, embeddings, mixing, language-model scores and the pipeline against brute-force versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import embedding_dedup, lm_scoring, minhash_dedup, mixing
from scholia.llm.components import components
from scholia.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in rows], DOCS)


def words(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice("bcdfgh") + rnd.choice("aeiou") + str(rnd.randint(0, 400)) for _ in range(n)]


def varied(base, seed, edits):
    rnd = random.Random(seed)
    out = list(base)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = "e" + str(rnd.randint(0, 10**6))
    return " ".join(out)


def brute_components(rows, n, percent):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(k, []).append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    flat = [(k, s) for k, ss in sets.items() for s in ss]
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {k: top(k) for k in sets}


@pytest.mark.parametrize("leaf,block", [(128, 128), (3, 2)])
@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, monkeypatch, leaf, block, n):
    monkeypatch.setattr(minhash_dedup, "LEAF", leaf)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    base, other = words(1, 200), words(2, 40)
    rows = [(k, varied(base, k, k % 12)) for k in range(40)] + [(100 + k, " ".join(words(50 + k, 60))) for k in range(20)]
    rows += [(200 + k, varied(other, k, k % 4)) for k in range(12)] + [(300, "one"), (301, "ONE"), (302, None), (303, ""), (304, " \n"), (305, "a b"), (306, "A  b")]
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs(spark, rows), words=n).collect()}
    want = brute_components(rows, n, 80)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (k == want[k]) for k, r in got.items())
    assert got[302]["n_shingles"] == 0 and got[300]["n_shingles"] == 1


def test_near_duplicates_edges(spark):
    out = minhash_dedup.near_duplicates(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in out) == [(-1, 1), (1, 1), (1, 1)]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_at_depth(spark, monkeypatch):
    """Many levels deep (documents that share most of their tokens, leaves of two) no pair near the threshold is lost."""
    monkeypatch.setattr(minhash_dedup, "LEAF", 2)
    monkeypatch.setattr(minhash_dedup, "ABSORB", 0.99)
    common = words(5, 120)
    rows = []
    for k in range(40):
        own = common + words(1000 + k, 90)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:105] + ["e" + str(k)] + own[106:]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs(spark, rows), words=5).collect()}
    assert got == brute_components(rows, 5, 80)


def test_near_duplicates_share_an_id(spark):
    """Two texts under one doc_id are one node; a null id with a text of its own stays."""
    a, b = " ".join(words(1, 30)), " ".join(words(2, 30))
    rows = [(7, a), (7, b), (8, a), (9, b), (None, "quite another text of some words")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(7, 7, True), (8, 7, False), (9, 7, False), (None, None, True)}


def test_components_in_rounds(spark):
    links = [(k, k + 1) for k in range(90)] + [(200, 200 + k) for k in range(1, 30)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t"), one_task=0).collect()}
    assert got == {k: 0 for k in range(91)} | {200 + k: 200 for k in range(30)}


def test_components(spark):
    rnd = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(200, 200 + k) for k in range(1, 50)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    root = {x: x for e in links for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


@pytest.mark.parametrize("block,wave", [(256, 768), (5, 7)])
def test_embeddings(spark, monkeypatch, block, wave):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "WAVE", wave)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = [centres[k % 30] + rng.normal(size=16) * 0.12 for k in range(240)] + [centres[0]] * 9
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, [math.inf] * 16)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = np.float32(np.stack(x)).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    want = link.sum(1) - 1
    found = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and want.sum() > 100
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(900, 906))
    assert len({got[240 + k]["component_id"] for k in range(9)}) == 1
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id in (900, 901)")).count() == 2


def test_cells_are_visited_in_multi_sequence_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12))
    books = (rng.normal(size=(9, 6)), rng.normal(size=(7, 6)))
    one, two = embedding_dedup._halves(x, books)
    grid = (one[:, :, None] + two[:, None, :]).reshape(40, -1)
    want = grid.argsort(1, kind="stable")
    for visits in (1, 5, 17, 63, 200):
        assert (embedding_dedup.order(x, books, visits) == want[:, :visits]).all()
    y = rng.normal(size=(40, 12))
    cell = embedding_dedup._cells(y, books)
    assert embedding_dedup.rank(x, y, books).tolist() == [int(np.flatnonzero(want[k] == cell[k])[0]) for k in range(40)]
    p, q = embedding_dedup.planted(embedding_dedup.normal(x), 0.95, 3)
    assert np.allclose((p * q).sum(1), 0.95) and np.allclose((q * q).sum(1), 1)


def test_embedding_recall_of_every_hundredth_row(spark):
    """Recall against brute force, with links as rare and as far as they may be."""
    rng = np.random.default_rng(11)
    x = embedding_dedup.normal(rng.normal(size=(3000, 32)))
    _, near = embedding_dedup.planted(x[::10], 0.952, 1)
    x = np.concatenate((x, near))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    u = embedding_dedup.normal(x)
    want = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.985 * want.sum() and want.sum() >= 600
    asked = np.arange(0, len(x), 100)
    assert found[asked].sum() >= 0.9 * want[asked].sum() > 0


def test_one_vec_id_on_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()]
    assert len(out) == 5 and (None, 0, None, True) in out
    assert sum(c == 1 and v in (2, 3) for v, _, c, _ in out) == 1  # the one like the vector that stands for id 1


def test_mixing_meets_targets(spark):
    rows, labels = [], []
    for k in range(600):
        toxic, poor = k % 10 == 0, k % 5 == 1
        text = " ".join(words(k, 40)) + (" scum idiot" if toxic else "") + (" ### $$$ ||| &&&" * 8 if poor else "")
        rows.append((k, text))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(not poor), int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, [*rows, (700, None), (701, "")])
    target = {"1/0": 0.8, "0/0": 0.15, "1/1": 0.05}
    out = mixing.mix(df, lab, target).collect()
    total = sum(r["n_tokens"] for r in out)
    domains = sorted({"0/0", "1/0", "1/1"} | {f"{q}/{t}" for _, q, t in labels})
    for i, d in enumerate(domains):
        got = sum(r["n_tokens"] * r["parts"][i] / mixing.PARTS * r["rate"] for r in out)
        assert abs(got - target.get(d, 0) * total) < 0.01 * max(target.get(d, 0), 0.01) * total
    assert all(r["rate"] >= 0 and sum(r["parts"]) == mixing.PARTS and abs(r["copies"] - r["rate"]) < 1 for r in out)
    plain = mixing.mix(df, lab.limit(0), target).collect()
    assert {r["rate"] for r in plain} == {1.0} and {r["domain"] for r in plain} == {mixing.UNLABELLED}
    assert mixing.mix(docs(spark, []), lab, target).count() == 0


def test_mixing_posteriors_match_brute_force(spark):
    rows = [(k, " ".join(words(k, 30)) + (" scum idiot" if k % 7 == 0 else "")) for k in range(120)]
    model = mixing.Classifier(["a", "b", "c"], [-0.2, -1.5, -6.0], {"scum": [-2.0, 3.0, 0.0], words(3, 30)[0]: [0.5, 0.0, 1.0], "\x00length2": [0.1, 0.0, 0.3]})
    feats = mixing.features(docs(spark, rows))
    out = {r["doc_id"]: r["parts"] for r in model.with_posteriors(feats).collect()}
    for k, t in rows:
        present = set(t.split()) | {f"\x00length{sum(len(t.split()) >= c for c in (1, 20, 100, 400))}"}
        score = np.array(model.prior) + sum((np.array(v) for f, v in model.weights.items() if f in present), np.zeros(3))
        p = np.exp(score - score.max())
        p /= p.sum()
        assert np.abs(np.array(out[k]) / mixing.PARTS - p).max() <= 1.5 / mixing.PARTS and min(out[k]) > 0


def test_mixing_targets_out_of_reach(spark):
    groups = spark.createDataFrame([([mixing.PARTS // 2, mixing.PARTS // 2], 100)], "parts array<int>, tokens long")
    found = mixing.fit(groups, [90.0, 10.0], Scratch(spark, "t"))
    steps = found.steps
    assert np.allclose(found.misses, [-40, 40]) and 0 <= found.residual < 1e-6
    r = groups.select(mixing.rate(F.col("parts"), steps).alias("r")).first()["r"]
    assert abs(r - 1.0) < 1e-6  # the nearest totals are 50 and 50


def test_mixing_steps_match_numpy(spark):
    rng = np.random.default_rng(2)
    p = (rng.dirichlet([0.4] * 3, 50) * mixing.PARTS).astype(int)
    p[:, 0] += mixing.PARTS - p.sum(1)
    t = rng.integers(1, 50, 50)
    goal = np.array([0.2, 0.5, 0.3]) * t.sum()
    groups = spark.createDataFrame([(row.tolist(), int(n)) for row, n in zip(p, t, strict=True)], "parts array<int>, tokens long")
    found = mixing.fit(groups, goal.tolist(), Scratch(spark, "t"))
    steps = found.steps
    r = np.ones(50)
    for e in steps:
        r = np.maximum(0, r - p / mixing.PARTS @ np.array(e))
    got = [x["r"] for x in groups.select(mixing.rate(F.col("parts"), steps).alias("r")).collect()]
    assert np.allclose(r, got)
    assert found.residual == 0 and np.allclose(found.misses, (p / mixing.PARTS).T @ (t * r) - goal)
    assert (np.abs((p / mixing.PARTS).T @ (t * r) - goal) < 0.006 * goal).all()


@pytest.mark.parametrize("top", [5, 1 << 18])
def test_lm_base_scores_are_exact(spark, top):
    rows = [(k, " ".join(words(k % 37, 30))) for k in range(120)] + [(500, None), (501, ""), (502, "Zzz zzz ZZZ"), (None, "no id"), (7, "again again")]
    df = docs(spark, rows)
    training = ~lm_scoring.held_out(F.col("doc_id"))
    out = lm_scoring.score(df, training, top=top).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    toks = [(k, [*(t or "").encode().lower().split(), None]) for k, t in rows]
    c = {}
    for k, w in toks:
        if not held(k):
            for x in w:
                c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted((k if k is not None else -1, len(w), sum(x in c for x in w), round(sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for k, w in toks)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_lm_scores_do_not_depend_on_how_the_filter_is_reached(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEAST_RANGES", 8)
    rows = [(k, " ".join(words(k % 90, 60))) for k in range(200)] + [(500, None), (501, ""), (None, "no id"), (7, "again again")]
    df = docs(spark, rows).repartition(3, "doc_id")
    training = ~lm_scoring.held_out(F.col("doc_id"))
    told = lambda out: sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in out.collect())
    # too few bits to broadcast: nothing may be dropped to make them fit
    assert told(lm_scoring.score(df, training, max_bits=12)) == told(lm_scoring.score(df, training))


def test_lm_pairs_seen_once_count_and_unseen_ones_are_rarely_found(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEAST_RANGES", 8)
    rows = [(k, " ".join(words(k, 60))) for k in range(300)]
    s = Scratch(spark, "t")
    counted, shift = lm_scoring.counts(docs(spark, rows), s, sum(len(r[1] or "") for r in rows))
    size = lm_scoring.segment_size(counted, shift)
    f = lm_scoring.build_filter(lm_scoring.segments(counted, size), size, shift)
    once = np.concatenate([np.frombuffer(r["h"], np.uint64)[np.frombuffer(r["c"], "<i8") == 1] for r in counted.where("kind = 2").collect()])
    assert len(once) > 10000 and (f.levels(once) > 0).all()
    unseen = np.random.default_rng(0).integers(0, 2**63, 100000, np.uint64) * np.uint64(2) + np.uint64(1)
    assert (f.levels(unseen) > 0).mean() < 0.01


def test_lm_scores_match_brute_force(spark, monkeypatch):
    """The model with its counts read from a table instead of the filter: false positives apart, the same scores."""
    monkeypatch.setattr(lm_scoring, "LEAST_RANGES", 8)
    rows = [(k, " ".join(words(k % 23, 25))) for k in range(70)]
    training = ~lm_scoring.held_out(F.col("doc_id"))
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    one, two, begun = {}, {}, 0
    toks = {k: [None, *t.lower().split(), "\n"] for k, t in rows}
    for k, w in toks.items():
        if not held(k):
            begun += 1
            for a, b in zip(w, w[1:], strict=False):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
    n, v = sum(one.values()), len(one)
    value = lm_scoring.values(1)
    read = lambda c: (int(lm_scoring.level(np.array([c]), 1)[0]), float(value[lm_scoring.level(np.array([c]), 1)[0]]))
    at = {x: read(c) for x, c in {**one, None: begun}.items()}
    both = {x: read(c)[1] for x, c in two.items()}
    zero = (0, 0.0)
    grid = np.zeros((lm_scoring.LEVELS, len(lm_scoring.WEIGHTS)))
    for k, w in toks.items():
        for a, b in zip(w, w[1:], strict=False):
            if not held(k):
                (q, c1), c2, c = at[a], both[a, b], at[b][1]
                high = min(1.0, max(c2 - 1, 0) / (c1 - 1)) if c1 > 1 else 0.0
                low = max(c, 1) / (n + v + 1)
                grid[q] += [math.log10(x * high + (1 - x) * low) for x in lm_scoring.WEIGHTS]
    weight = lm_scoring.WEIGHTS[grid.argmax(1)]
    want = {}
    for k, w in toks.items():
        total = 0.0
        for a, b in zip(w, w[1:], strict=False):
            (q, c1), c2, c = at.get(a, zero), both.get((a, b), 0.0), at.get(b, zero)[1]
            high = min(1.0, c2 / c1) if c1 > 0 else 0.0
            total += math.log10(weight[q] * high + (1 - weight[q]) * (c + 1) / (n + v + 1))
        want[k] = total
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs(spark, rows), training).collect()}
    off = [abs(got[k] - want[k]) for k in want]
    assert sum(x < 1e-6 for x in off) >= 0.9 * len(off) and max(off) < 3


def test_lm_edges(spark):
    df = docs(spark, [(1, "a b"), (2, None)])
    none = lm_scoring.score(df, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in none} == {(0, 0, 0.0)}
    assert lm_scoring.score(docs(spark, []), F.lit(True)).count() == 0


def test_filter_reads_levels_back():
    c = np.array([1, 2, 3, 7, 50, 1000])
    for least in (1, 2):
        v = lm_scoring.values(least)
        got = v[lm_scoring.level(c, least)]
        assert all(g == 0 if x < least else 0.6 < g / x < 1.6 for g, x in zip(got, c, strict=True))


def brute_pipeline(rows):
    """The first three stages on rows (doc_id, text) of one language, by definition."""
    kept = [(k, t) for k, t in rows if t and any(x.isalpha() for x in t)]
    comp = brute_components(kept, 5, 80)
    kept = [(k, t) for k, t in kept if comp[k] == k]
    seen = {}
    for _, t in kept:
        b = t.encode()
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] = seen.get(b[i : i + 400], 0) + 1
    out = []
    for k, t in kept:
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                hit[i : i + 400] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~hit]).decode("utf-8", "ignore")
        if not hit.any() or rest.split():
            out.append((k, rest))
    return out


def test_pipeline(spark, tmp_path):
    base, common = words(1, 150), " ".join(words(2, 110))
    rows = [(k, varied(base, k, k % 5)) for k in range(15)] + [(100 + k, " ".join(words(10 + k, 50)) + " " + common + " " + " ".join(words(60 + k, 30))) for k in range(8)]
    rows += [(200, "1234 ###"), (201, None), (202, " ".join(words(99, 90)))]
    d = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        frame = Scratch(spark, "t").keep(out)
    assert sorted((r["doc_id"], r["text"]) for r in frame.collect()) == sorted(brute_pipeline(rows))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == {k for k, _ in brute_pipeline(rows)}


def brute_word_passages(rows, n=50):
    """rows (doc_id, text) with the runs of n words that stand in another row too cut out, unless half of the five-word
    shingles outside them stands in another such row."""
    split = [[(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    told = [[t[a:b] for a, b in w] for (_, t), w in zip(rows, split, strict=True)]

    def where(k, chosen):
        out = {}
        for i in chosen:
            for j in range(len(told[i]) - k + 1):
                out.setdefault(tuple(told[i][j : j + k]), set()).add(i)
        return out

    seen, cut = where(n, range(len(rows))), {}
    for i, w in enumerate(told):
        hit = [any(len(seen[tuple(w[j : j + n])]) > 1 for j in range(max(0, k - n + 1), min(k, len(w) - n) + 1)) for k in range(len(w))]
        if any(hit):
            cut[i] = hit
    seen, out = where(5, cut), []
    for i, (k, t) in enumerate(rows):
        if i in cut:
            rest = {tuple(told[i][j : j + 5]) for j in range(len(told[i]) - 4) if not all(cut[i][j : j + 5])}
            if not rest or sum(len(seen[s]) > 1 for s in rest) < 0.5 * len(rest):
                runs = [j for j, x in enumerate(cut[i]) if x and not (j and cut[i][j - 1])]
                ends = [j for j, x in enumerate(cut[i]) if x and not (j + 1 < len(cut[i]) and cut[i][j + 1])]
                for a, b in reversed(list(zip(runs, ends, strict=True))):
                    t = t[: split[i][a][0]] + t[split[i][b][1] :]
        out.append((k, t))
    return out


def test_passages_of_fifty_words(spark, tmp_path):
    """Passages of fewer than 400 bytes that stand in several documents; edited versions and repeats within one text stay."""
    from scholia.llm import queries

    common, accents, base = words(500, 66), ["é" + w for w in words(501, 50)], words(502, 140)
    inside = lambda k, p: "\n".join([" ".join(words(510 + k, 70)), " ".join(p), " ".join(words(540 + k, 50))])
    rows = [(k, inside(k, common[k : 58 + k])) for k in range(8)] + [(10, inside(10, accents)), (11, inside(11, accents)), (12, inside(12, common[:49]))]
    rows += [(20, " ".join(words(570, 55) + words(571, 20) + words(570, 55))), (21, " ".join(["of"] * 90)), (22, " ".join(["of"] * 70 + words(572, 40)))]
    rows += [(30, " ".join(base)), (31, " ".join(base[:30] + ["x1"] + base[31:60] + ["x2"] + base[61:]).replace(base[120], "x3")), (40, None), (41, ""), (42, " ".join(common[4:58]))]
    want = brute_word_passages(rows)
    assert {k for (k, t), (_, u) in zip(rows, want, strict=True) if t != u} == {*range(8), 10, 11, 21, 22, 42}
    assert max(len(" ".join(p).encode()) for p in (common, accents)) < 400 <= len(rows[0][1])
    d = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.where("doc_id not in (20, 30, 31)").write.parquet(f"{tmp_path}/documents.parquet")
    short = [r for r in rows if r[0] not in (20, 30, 31)]
    got = queries.op8_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["clear_text"] or "" for r in got} == {k: t or "" for k, t in brute_word_passages(short)}
    assert all(r["n_removed"] == 0 and r["kept_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(sorted(got), short, strict=True))
    left = corpus_pipeline.repeated_passages(spark, d, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left} == {k: (t, len(t or "")) for k, t in want if k not in (21, 42)}


def test_pipeline_mixture_and_sequences(spark, tmp_path):
    """Documents as often as their rates say, tokens by domain near their targets, and sequences that hold each copy whole."""
    from scholia.llm import packing
    from scholia.llm.queries import WEIGHTS

    rows = [(k, " ".join(words(k, 40)) + (" scum idiot" if k % 10 == 0 else "") + (" ### $$$ ||| &&&" * 8 if k % 5 == 1 else "")) for k in range(300)]
    d = spark.createDataFrame([(k, t, "en", "s", len(t), "x", 7) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, th_ string, copies_ int")
    spark.createDataFrame([(k, int(k % 5 != 1), int(k % 10 == 0)) for k in range(0, 300, 2)] + [(1, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    mixed = corpus_pipeline.mixture(spark, d, str(tmp_path))
    assert mixed.columns == d.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(d, labels, WEIGHTS).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    packed = corpus_pipeline.sequences(spark, mixed, str(tmp_path)).collect()
    held, at = {}, {}
    for r in packed:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert held == {k: got[k] * (len(packing.encode(t)) + 1) for k, t in rows if k in got}
    for spans in at.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= packing.CAPACITY
    assert len(at) <= -(-sum(held.values()) // packing.CAPACITY) + 1


@pytest.mark.parametrize("rows", [[], [(1, None), (2, None), (None, None), (3, "")]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    fields = "doc_id long, text string, lang string, source string, n_chars long, th_ string, n_ long, copies_ int, row string"
    spark.createDataFrame([(k, t, None, None, None, "x", 1, 2, "y") for k, t in rows], fields).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        frame = Scratch(spark, "t").keep(out)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ranges_follow_measured_bytes():
    assert lm_scoring.ranges(19 * 900, 4) == lm_scoring.LEAST_RANGES
    assert lm_scoring.ranges(0, 300) == 1024
    assert lm_scoring.ranges(40 << 30, 4) == 8192
    assert lm_scoring.ranges(1 << 60, 4) == lm_scoring.MOST_RANGES
