"""Literal rows: what fixed values and patterns give, written out, so that a wrong constant cannot pass on both sides."""

import pytest
from pyspark.sql import functions as F

from scholia.functions import choices as R
from scholia.functions import extraction as X
from scholia.functions import reasoning as C
from scholia.functions import text as T
from scholia.operators import keywords as K
from scholia.operators import positional
from scholia.operators import vectors as V
from scholia.plans import providers
from scholia.sources import files, search


def values(spark, f, texts):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r["y"] for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_flow_labels(spark):
    texts = ["Let me see the data", "First we look", "But this is odd", "Hmm, odd", "Therefore it holds", "I believe it", "Because of that", "Unlike others", "Plain words", "I should say but"]
    want = ["INITIAL_APPROACH", "OPTION_INTRODUCTION", "COUNTER_CONSIDERATION", "RECONSIDERATION", "LOGICAL_INFERENCE", "CONCLUSION", "CAUSAL_REASONING", "COMPARISON", "ELABORATION", "INITIAL_APPROACH"]
    assert values(spark, C.flow_label, texts) == want


def test_clause_features(spark):
    assert values(spark, C.certainty, ["It must be", "It probably is", "It might be", "It is"]) == [0.9, 0.6, 0.3, 0.7]
    assert values(spark, C.quantifier, ["Every cell", "Some cells", "Nothing", "Cells grow"]) == ["universal:every", "existential:some", "negative:no", None]
    assert values(spark, C.temporal_marker, ["After that", "It never ends", "Blue"]) == ["after", "never", None]
    assert values(spark, C.conditional_type, ["If so then yes", "It is specific", "Unless it is", "Assuming x", "None"]) == ["if_then", "if_implicit", "unless", "assuming", None]
    assert values(spark, C.negated, ["It isn't", "It is not", "It is"]) == [True, True, False]


def test_clause_parts(spark):
    s = ["The valve is open, and Bob quickly ran.", "They will go", "blue sky", "Heat causes strong growth."]
    assert values(spark, X.predicate, s) == ["open", "go", "relates", "causes"]
    assert values(spark, X.objects, s) == [["open"], [], [], ["strong growth"]]
    assert values(spark, X.modifiers, s) == [["quickly"], [], [], []]
    assert values(spark, X.subjects, s[1:2]) == [["They", "they"]]
    assert values(spark, X.simple_verb, ["cats runs is", "a bed sang", "the testing"]) == ["cats", "relates", "testing"]
    assert values(spark, X.entities, ["Ann met Bob2 and Carl Dora"]) == [["Ann", "Carl"]]
    assert values(spark, X.relation, ["; thus", " if ", " but ", " and ", " or ", " due to ", " . "]) == ["implies", "conditional", "contrast", "conjunction", "disjunction", "causation", None]


def test_choices(spark):
    q = "Which?\n\n1) one (*)\n2. two\nx) three\n12) no\n3)no"
    assert values(spark, R.line_options, [q, "1) none"]) == [["one", "two", "three"], []]
    kinds = values(spark, lambda c: R.choice(c, "A-J", "1-9"), ["The answer is H.", "option 7", "J", "maybe"])
    assert [k and (k["kind"], k["id"]) for k in kinds] == [("letter", "H"), ("number", "7"), ("letter", "J"), None]


def test_grades(spark):
    g = values(spark, lambda c: R.normalised_grade(F.from_json(c, R.GRADE), F.lit("mc")), ['{"match": true, "model_choice": "B"}', '{"score": 0.5}', "{}"])
    assert [(x["score"], x["model_letter"], x["format"]) for x in g] == [(1.0, "B", "mc"), (0.5, None, "mc"), (0.0, None, "mc")]
    g = values(spark, lambda c: R.normalised_grade(F.from_json(c, R.GRADE), F.lit("qa")), ['{"match": false, "correct_letter": "B"}', "{}"])
    assert [(x["score"], x["correct_letter"]) for x in g] == [(0.0, None), (None, None)]


def test_labels(spark):
    texts = ['Topic label: "Gene editing"\nmore', "Here are the topic labels for each paper: is related to cells", "The common theme", "Papers on x", "***Immune response***", "abc"]
    want = ["Gene editing", "cells", "Research Topic 3 papers", "Research Topic 3 papers", "Immune response", "Research Topic 3 papers"]
    assert values(spark, lambda c: T.long_label(c, F.lit(3)), texts) == want
    at = spark.createDataFrame([(0.0, 0.0, 120), (16.0, 1.0, 60), (-9.0, -1.0, 30), (4.0, 9.0, 1)], "x double, y double, n int")
    got = at.select(V.specific_label(F.col("x"), F.col("y"), F.col("n")), V.position_label(F.col("x"), F.col("y"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("Major Core Mechanisms", "Core Biomedical Research"),
        ("Advanced Therapeutics Studies", "Advanced Medical Studies"),
        ("Specialized Diagnostic Methods", "General Research Topic"),
        ("Targeted Pathway Analysis", "General Specialized Studies"),
    ]


def test_pdf_structure():
    import zlib

    page = b"%PDF-1.7\n<</Type /Page>>"
    packed = zlib.compress(b"BT (hello) Tj ET")
    assert files.structure(page + b" stream\n" + packed + b"\nendstream\n%%EOF")[:5] == (True, False, False, True, 1)
    assert files.structure(page + b"\n%%EOF")[2:4] == (True, False)
    assert files.structure(page + b"/Encrypt %%EOF")[1:4] == (True, False, False)
    assert files.structure(page)[5] == "no end mark" and files.structure(b"<html>")[5] == "bad header"


def test_registry():
    text = "servers:\n  - shortname: a\n    key: ${TOKEN}\n    # x: y\n  - shortname: 'b'\n    key: ${OTHER}\n"
    assert files.registry(text, {"TOKEN": "t"}) == [{"shortname": "a", "key": "t"}, {"shortname": "b", "key": "${OTHER}"}]


def test_no_call_is_paid_twice(spark, tmp_path):
    marks = str(tmp_path / "calls")
    import os

    os.makedirs(marks)

    def provider(prompts):
        import uuid

        for _ in prompts:
            open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return [None if "bad" in p else p.upper() for p in prompts]

    empty = spark.createDataFrame([], "prompt_hash string, response string")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "bad")], "k int, prompt string")
    path = str(tmp_path / "responses")
    out, _ = providers.respond(asked, empty, provider, path=path)
    assert {r["k"]: r["response"] for r in out.collect()} == {1: "A", 2: "A", 3: "B", 4: None}
    assert out.count() == 4 and len(os.listdir(marks)) == 3
    again, _ = providers.respond(asked, spark.read.parquet(path), provider)
    assert again.count() == 4 and len(os.listdir(marks)) == 4  # the failure alone is asked again


def test_numbers_and_neighbours(spark):
    rows = spark.createDataFrame([(k * 7 % 50,) for k in range(50)], "key int").repartition(6)
    assert sorted((r["key"], r["i"]) for r in positional.numbered(rows, "key").collect()) == [(k, k) for k in range(50)]
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert V.top_neighbours(e.limit(0), e, "id", "v").count() == 0
    one = V.top_neighbours(e, e, "id", "v", 1, held=1).collect()
    assert sorted((r["src"], r["dst"]) for r in one) == [(1, 2), (2, 1)]


def test_grams(spark):
    rows = spark.createDataFrame([(list("abcd"),), (["a"],), ([],)], "w array<string>")
    got = rows.select(K.grams(F.col("w"), 2).alias("two"), K.grams(F.col("w"), 3).alias("three"), K.grams(F.col("w"), 2, 1).alias("apart")).collect()
    assert [tuple(r) for r in got] == [(["a b", "b c", "c d"], ["a b c", "b c d"], ["a c", "b d"]), ([], [], []), ([], [], [])]


def test_a_missing_page_is_an_error():
    reader = search.SearchReader({"endpoint": "http://127.0.0.1:9/none", "keyword": "x", "wait": "0"})
    with pytest.raises(OSError):
        list(reader.read(search.Page(0)))
