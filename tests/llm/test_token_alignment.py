"""Token alignment against whole-text encodings, spans compared one by one."""

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import token_alignment as align
from scholia.llm.packing import tokenizer
from scholia.llm.textblock import column

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """One tuple of COLUMNS a text, from encodings of whole texts and the definition of groups and links."""
    named, held, holds = align.piece_bytes(), [], defaultdict(set)
    for d, t in enumerate(texts):
        groups = []
        if t:
            want = (" " + t).encode()
            a, b = tokenizer().encode_ordinary(" " + t), align.pieces().encode(t)
            xa, xb = tokenizer().decode_tokens_bytes(a), [named[i] for i in b]
            if b"".join(xa) == want and b"".join(xb) == want:
                ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (xa, xb)]
                both, sides = ends[0] & ends[1], []
                for ids, xs in ((a, xa), (b, xb)):
                    at, now, out = 0, [], []
                    for i, x in zip(ids, xs, strict=True):
                        at += len(x)
                        now.append(i)
                        if at in both:
                            out.append(now)
                            now = []
                    sides.append(out)
                groups = list(zip(*sides, strict=True))
        held.append(groups)
        for ga, gb in groups:
            for i in ga:
                for j in gb:
                    holds[i, j].add(d)
    most = defaultdict(int)
    for (i, _), ds in holds.items():
        most[i] = max(most[i], len(ds))
    out = []
    for groups in held:
        links = [(i, j) for ga, gb in groups for i in ga for j in gb]
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), len(links), sum(len(holds[x]) == most[x[0]] for x in links), sum(len(holds[x]) for x in links), hashlib.sha256(told.encode()).hexdigest() if groups else ""))
    return out


ODD = [None, "", " ", "  ", "x", " x", "x ", "a  b", "a b", "a \n b\nc", "a\xa0 b", "a  b c", "a　 b", "▁", "a ▁b c", "a\x00 b", "汉字 漢 字", "é é ﬁ ①", "🙂 🙂🙂 x", "<s> </s> <unk> <|endoftext|> x", "don't I'll x's 's", "1234 5,678.90 a1b2", "\t\ta\tb", "a.b , c ;d", "x" * 700, "ab" * 300 + " " + "ba" * 200, "  lead", "trail  ", "\r\n\r\n x"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["th", "on", "é", "ung", "ción", "a", "s", "B", "-", "9", "汉"]) for _ in range(rnd.randint(1, 5))) + rnd.choice(["", "", ",", ".\n", "!"]) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def told(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = ODD + [prose(rnd, rnd.randint(1, 80)) for _ in range(40)]
    texts += [texts[-1], texts[-1], texts[-2] + " " + texts[-3]]
    assert told(align.aligned(table(spark, texts).repartition(3))) == dict(enumerate(brute(texts)))


def test_small_dictionaries_and_joins_change_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    texts = ODD + [prose(rnd, 60) for _ in range(30)] + [prose(rnd, 90_000)]  # the last is longer than a block
    df = table(spark, texts)
    want = told(align.aligned(df))
    assert want == dict(enumerate(brute(texts)))
    monkeypatch.setattr(align, "SMALL", -1)
    monkeypatch.setattr(align, "cuts_are_safe", lambda: False)
    assert told(align.aligned(df.where("doc_id < 59"), dictionary=8)) == dict(enumerate(brute(texts[:59])))


def test_segments_never_cross_tokens():
    rnd = random.Random(7)
    spaces = [" ", "  ", "\n", "\xa0", " ", "　", "\x85", "\t ", " \r"]
    for _ in range(300):
        t = "".join(rnd.choice(["a", "é", "9", ".", "'s", "汉", "🙂", "A"]) + rnd.choice(["", "", *spaces, " ", " "]) for _ in range(12))
        s = " " + t
        starts = align.segments(column(pa.array([s])), True).tolist()
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) | {0} for side in (tokenizer().decode_tokens_bytes(tokenizer().encode_ordinary(s)), [align.piece_bytes()[i] for i in align.pieces().encode(t)])]
        assert set(starts) <= ends[0] & ends[1], t
        raw = s.encode()
        parts = [raw[a:z].decode() for a, z in zip(starts, starts[1:] + [len(raw)], strict=True)]
        assert sum((tokenizer().encode_ordinary(p) for p in parts), []) == tokenizer().encode_ordinary(s)
        assert sum((align.pieces().encode(p[1:]) for p in parts), []) == align.pieces().encode(t)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (2, None), (3, "")], "doc_id long, text string")
    clash = df.withColumns({c: F.lit(3) for c in ("seg", "sid", "k", "block", "kind", "n_a", "pair", "ids", "groups")})
    got = sorted(map(str, align.aligned(clash).collect()))
    assert len(got) == 5 and got == sorted(map(str, align.aligned(df).collect()))
    assert align.aligned(df.limit(0)).count() == 0
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in align.aligned(df.where("doc_id > 1")).collect())


def test_copies_are_aligned_once_and_keep_their_places(spark):
    rnd = random.Random(9)
    segs = list(dict.fromkeys([" " + t for t in ODD if t and t[0] != " "] + [" " + x for x in prose(rnd, 300).split(" ")] + [" " + "aé" * 400]))
    asks = [(k, segs[k % len(segs)]) for k in range(3 * len(segs))]
    dealt = spark.createDataFrame(asks, "at long, seg string").repartition(2, "seg").sortWithinPartitions(F.xxhash64("seg"))
    t = align.tokens(dealt)
    found = align.aligned_segments(t, align.Scratch(spark, "test")).collect()
    assert sorted(at for r in found for at in r["ats"]) == [at for at, _ in asks] and len(found) == len(segs)
    want = dict(zip(segs, brute([x[1:] for x in segs]), strict=True))
    for r in found:
        own = {segs[at % len(segs)] for at in r["ats"]}
        n_a, n_b, n_groups, n_links, _, _, sha = want[own.pop()]
        assert not own and (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, n_links)
        assert (hashlib.sha256(r["groups"][:-1].encode()).hexdigest() if r["groups"] else "") == sha
        assert (r["pairs"] is None) == (sha == "") and sum(r["ns"] or []) == n_links


def test_answers_are_not_looked_up_by_joins(spark, monkeypatch):
    kept, keep = [], align.Scratch.keep
    monkeypatch.setattr(align.Scratch, "keep", lambda self, df, name="t", batch=None: kept.append(name) or keep(self, df, name, batch))
    texts = [prose(random.Random(k), 20) for k in range(5)]
    assert told(align.aligned(table(spark, texts))) == dict(enumerate(brute(texts)))
    assert kept == ["cut", "tokens", "facts", "counts", "ranked", "full"]  # before: cuts too, and what blocks asked for, twice


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_a_whole_table(spark):
    from scholia.llm.queries import op12_token_alignment

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert told(op12_token_alignment(spark, "/root/testdata/sf0.001")) == {r["doc_id"]: x for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True)}
