"""Keywords over numbered words give what those over texts give, without edges or texts that are dealt."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.operators import keywords as K
from scholia.operators import numbered as N
from scholia.plans import analysis_queries as A
from scholia.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(k, [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.choice((0, 1, 2, 3, 40, 90)))]) for k in range(120)] + [(999, None)]
    return spark.createDataFrame(rows, "doc long, words array<string>").repartition(3)


def _rows(df, digits=6):
    return [tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()]


def test_numbered_keywords_match_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(K, "WORDS", 50)
    monkeypatch.setattr(N, "SEGMENT", 8)
    t = N.numbered(docs)
    assert sum(t.counts) == sum(len(r["words"] or ()) for r in docs.collect())
    assert {(r["doc"], len(r["ids"])) for r in t.ids.collect()} == {(r["doc"], len(r["words"] or ())) for r in docs.collect()}
    assert _rows(N.trigrams(t)) == _rows(K.trigrams(docs))
    assert _rows(N.collocations(t)) == _rows(K.collocations(docs))
    assert _rows(N.tfidf_keywords(t, 30)) == _rows(K.tfidf_keywords(docs, 30, longest=2))
    assert _rows(N.pagerank(t), 12) == _rows(K.pagerank(K.cooccurrence(docs)).orderBy(F.desc("rank"), "node").limit(20), 12)


def test_few_and_single_words(spark):
    for rows in ([], [(1, ["x", "y"]), (2, [])], [(1, ["a"] * 4)]):
        docs = spark.createDataFrame(rows, "doc long, words array<string>")
        t = N.numbered(docs)
        assert _rows(N.trigrams(t)) == _rows(K.trigrams(docs))
        assert _rows(N.collocations(t)) == _rows(K.collocations(docs))
        assert _rows(N.tfidf_keywords(t)) == _rows(K.tfidf_keywords(docs, longest=2))
        assert _rows(N.pagerank(t)) == []  # no three words in a row, or no two different ones


def test_many_words_and_equal_hashes(spark, docs, monkeypatch):
    """Two words of one hash are told apart by another seed; a vocabulary that doesn't fit gets no numbers."""
    real = N.hashes
    monkeypatch.setattr(N, "hashes", lambda w, seed: real(w, seed) % np.uint64(7 if seed < 2 else 1 << 63))
    t = N.numbered(docs)
    assert t is None or t.seed >= 0
    monkeypatch.setattr(N, "hashes", real)
    words = pa.array(["", "a", "aa", "ab", "ba", "é", "aab"])
    assert len(set(real(words, 0))) == 7 and (real(words.slice(2, 3), 0) == real(words, 0)[2:5]).all()
    monkeypatch.setattr(N, "MOST", 10)
    assert N.numbered(docs) is None


def test_fused_keywords_need_no_edges(spark, monkeypatch):
    """m08_fused_keywords: texts are tokenised once, and neither edges nor n-grams as texts are dealt."""

    def never(*_, **__):
        raise AssertionError("edges or texts are dealt")

    monkeypatch.setattr(K, "cooccurrence", never)
    monkeypatch.setattr(K, "trigrams", never)
    monkeypatch.setattr(K, "collocations", never)
    made = []
    real = A.content_tokens
    monkeypatch.setattr(A, "content_tokens", lambda *x: made.append(1) or real(*x))
    assert len(catalog.QUERIES["m08_fused_keywords"](spark, SF).collect()) == 15 and len(made) == 1


def _deals_no(monkeypatch, *names):
    def never(*_, **__):
        raise AssertionError("edges or texts are dealt")

    for name in names:
        monkeypatch.setattr(K, name, never)


def test_textrank_needs_no_edges(spark, monkeypatch):
    """m04_textrank: ranks are added up over places."""
    _deals_no(monkeypatch, "cooccurrence", "pagerank")
    assert len(catalog.QUERIES["m04_textrank"](spark, SF).collect()) == 20


def test_ranked_and_trigrams_tokenises_once(spark, monkeypatch):
    """m08_ranked_and_trigrams: both lists come from one table of numbers."""
    _deals_no(monkeypatch, "trigrams")
    made = []
    real = A.content_tokens
    monkeypatch.setattr(A, "content_tokens", lambda *x: made.append(1) or real(*x))
    assert len(catalog.QUERIES["m08_ranked_and_trigrams"](spark, SF).collect()) == 15 and len(made) == 1


def test_trigrams_leave_out_rare_words(spark, docs, monkeypatch):
    """m05_trigrams: n-grams are numbers, and those of a word that stands once are not dealt."""
    _deals_no(monkeypatch, "trigrams")
    assert len(catalog.QUERIES["m05_trigrams"](spark, SF).collect()) == 10
    t = N.numbered(docs.limit(9))
    rare = t.beyond(2)
    assert rare < len(t.counts) and t.grams.where((F.shiftright("ab", 32) >= rare) | (F.col("c") >= rare) | (F.col("n") < 2)).count() == 0
