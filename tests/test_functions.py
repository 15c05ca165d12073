"""Scalars and operators on hand-made rows: the traps, against plain Python."""

import json
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import choices as R
from scholia.functions import jsonx as N
from scholia.functions import reasoning as C
from scholia.functions import text as X
from scholia.operators import evaluation as E
from scholia.operators import keywords as K
from scholia.operators import stats as S
from scholia.operators import vectors as V
from scholia.plans import pipelines, providers
from scholia.sources import files, search, sinks
from scholia.streaming import incremental as I


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int' if not isinstance(v, bool) else 'boolean'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("A) yes", ("letter", "A")), ("The correct answer is c.", ("letter", "C")), ("option 3 then", ("number", "3")), ("B", ("letter", "B")), ("4 apples and more", ("number", "4")), ("xyz", None), ("A protein folds", ("letter", "A")), ("I pick\n2. two", ("number", "2"))],
)
def test_choice_cascade(spark, text, want):
    got = one(spark, R.choice(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "fmt,score,c,m,hc,hm,strict,compat",
    [
        ("mc", 0.0, "A", "A", True, True, 1.0, 1.0),
        ("mc", 1.0, "A", "B", True, True, 0.0, 0.0),
        ("mc", 0.0, None, None, False, False, 0.0, 1.0),
        ("mc", 0.0, None, None, True, True, 0.0, 0.0),
        ("mc", 1.0, "1", "a", True, True, 0.0, 0.0),
        ("qa", 0.5, "A", "B", True, True, 0.5, 0.5),
    ],
)
def test_score_repair(spark, fmt, score, c, m, hc, hm, strict, compat):
    args = dict(f=fmt, s=score, c=c, m=m, hc=hc, hm=hm)
    cols = [F.col(k) for k in args]
    assert one(spark, R.repaired_score(*cols[:4]), **args) == strict
    assert one(spark, R.repaired_score(*cols, mode="compat"), **args) == compat


def test_readings_of_wrong(spark):
    p, c = F.col("p"), F.col("c")
    for pred, lenient, strict in ((None, False, True), ("", False, True), (" 2 ", False, True), ("3", True, True)):
        assert one(spark, E.wrong(p, c), p=pred, c="x (Option 2)") is lenient
        assert one(spark, E.wrong(p, c, missing_is_wrong=True), p=pred, c="x (Option 2)") is strict


def test_pattern_hits_equal_finditer(spark):
    text = "Hmm, but maybe it is likely. Still, I think\nperhaps NOT; hold on: however it could be so."
    got = one(spark, C.pattern_hits(F.col("t"), "uncertainty"), t=text)
    want = []
    for p in C.PATTERNS["uncertainty"]:
        for m in re.finditer(p, text, re.I):
            want.append((m.group(), min(1, len(m.group()) / 20), m.start() / len(text), text[max(0, m.start() - 50) : m.end() + 50].replace("\n", " ")))
    assert [(h["text"], h["confidence"], h["position"], h["context"]) for h in got] == want


def test_boundary_chunks_advance():
    text = "\n\n" + "a" * 30 + ". " + "b" * 30 + "\n" + "c" * 90
    got = X.boundary_cut(text, 20)
    assert "".join(got) == text and all(0 < len(x) <= 20 for x in got)


def test_strip_marker_everywhere(spark):
    df = spark.sql("SELECT 'a(*)' AS a, array(named_struct('b', 'x(*)y')) AS n, map('k(*)', 'v(*)') AS m, 1 AS i")
    assert X.without_literal(df).first().asDict(True) == {"a": "a", "n": [{"b": "xy"}], "m": {"k": "v"}, "i": 1}


@pytest.mark.parametrize(
    "raw,want,conf",
    [('{"is_correct": true, "confidence": 0.8}', True, 0.8), ('```json\n{"is_correct": false}\n```', False, 0.5), ("It is incorrect", False, 0.5), ('x "is_correct": true y', True, 0.5), (r'{"is_correct": true, "confidence": 0.7, "r": "a\d"}', True, 0.7)],
)
def test_grades(spark, raw, want, conf):
    got = one(spark, N.grade(F.col("t")), t=raw)
    assert (got["is_correct"], got["confidence"]) == (want, conf)
    assert one(spark, N.grade(F.col("t"), compat=True), t="It is incorrect")["is_correct"] is True


def test_labelled_fields_are_anchored(spark):
    text = "CORRECT ANSWER: 2\nANSWER: four\nSCORE: 7.9"
    assert one(spark, X.labelled_field(F.col("t"), "ANSWER", ("SCORE",)), t=text) == "four"
    assert one(spark, X.score_field(F.col("t"), "SCORE", 5), t=text) == 7
    assert one(spark, X.score_field(F.col("t"), "SCORE", 5), t="none") == 5


def test_stream_body(spark):
    text = "QUESTION\nSTREAM OF THOUGHT:\n" + "-" * 40 + "\nbody\n" + "=" * 80 + "\nend"
    assert one(spark, C.stream_body(F.col("t")), t=text) == "body"
    assert one(spark, C.stream_body(F.col("t")), t="no sentinel") == ""
    assert one(spark, C.stream_body(F.col("t")), t="STREAM OF THOUGHT:\nopen end") == "open end"


def test_mann_whitney_exact_and_normal():
    assert S.u_p_value(0, 3, 3, 0) == pytest.approx(0.1)
    assert S.u_p_value(4.5, 3, 3, 0) == pytest.approx(1.0)
    assert 0 < S.u_p_value(100, 20, 30, 6) < 0.01
    assert np.isnan(S.u_p_value(0, 0, 3, 0))


def test_pagerank_matches_dense(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "d", 1), ("a", "d", 3), ("d", "e", 1)]
    got = {r["node"]: r["rank"] for r in K.pagerank(spark.createDataFrame(edges, "src string, dst string, weight long"), tolerance=1e-10).collect()}
    names = sorted(got)
    a = np.zeros((5, 5))
    for x, y, w in edges:
        i, j = names.index(x), names.index(y)
        a[i, j] = a[j, i] = w
    p = a / a.sum(1, keepdims=True)
    r = np.full(5, 0.2)
    for _ in range(300):
        r = 0.03 + 0.85 * r @ p
    assert np.allclose([got[n] for n in names], r, atol=1e-6)


def test_cooccurrence_weights(spark):
    toks = spark.createDataFrame([(1, list("abcda")), (2, ["x", "y"]), (3, ["x"]), (4, [])], "doc int, words array<string>")
    got = {(r["src"], r["dst"]): r["weight"] for r in K.cooccurrence(toks).collect()}
    want = {}
    s = "abcda"
    for i in range(len(s) - 2):
        w = s[i : i + 3]
        for x in range(3):
            for y in range(x + 1, 3):
                if w[x] != w[y]:
                    k = tuple(sorted((w[x], w[y])))
                    want[k] = want.get(k, 0) + 1
    assert got == want


def test_density_clusters(spark):
    pts = [(k, 0.01 * k, 0.0) for k in range(6)] + [(10 + k, 5 + 0.01 * k, 5.0) for k in range(6)] + [(99, 50.0, 50.0)]
    got = {r["k"]: r["cluster"] for r in V.density_clusters(spark.createDataFrame(pts, "k long, x double, y double"), "k", "x", "y", 0.05, 3).collect()}
    assert {got[k] for k in range(6)} == {0} and {got[k] for k in range(10, 16)} == {10} and got[99] is None


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == 0.0


def test_provider_cache_is_used(spark):
    calls = []

    prompts = spark.createDataFrame([(k, f"p{k % 3}") for k in range(9)], "k int, prompt string")
    empty = spark.createDataFrame([], "prompt_hash string, response string")
    out, new = providers.respond(prompts, empty, providers.stub)
    assert new.count() == 3 and out.where("response is null").count() == 0
    cached = spark.createDataFrame(new.collect(), new.schema)
    again, none = providers.respond(prompts, cached, lambda p: calls.append(p) or [None] * len(p))
    assert none.count() == 0 and again.where("response is null").count() == 0


def test_retrying_gives_up(monkeypatch):
    monkeypatch.setattr(providers.time, "sleep", lambda s: None)
    tries = []

    def fail(p):
        tries.append(1)
        raise OSError

    assert providers.retrying(fail)(["a", "b"]) == [None, None] and len(tries) == 5
    assert providers.retrying(lambda p: (_ for _ in ()).throw(PermissionError()))(["a"]) == [None]


def test_files_and_envelopes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "c.json").write_text(json.dumps({"results": [{"question": "q", "answer": "a"}]}))
    (tmp_path / "d.json").write_text(json.dumps([{"question": "r", "answer": "b"}]))
    (tmp_path / "e.json").write_text("not json")
    assert {r["text"] for r in files.texts(spark, str(tmp_path)).collect()} == {"héllo", "bad � byte"}
    assert files.listing(spark, str(tmp_path)).count() == 2
    raw = spark.read.text(f"{tmp_path}/*.json", wholetext=True)
    assert {r["question"] for r in files.read_envelopes(raw, "question string, answer string").collect()} == {"q", "r"}
    assert {r["question"] for r in files.read_lists(raw, "question string, answer string").collect()} == {"r"}


def test_search_source(spark):
    spark.dataSource.register(search.SearchSource)
    pages = {"0": {"data": [{"paperId": "1", "title": "t", "year": 2020, "openAccessPdf": {"url": "u"}}, {"paperId": None}]}, "2": {"data": [{"paperId": "2"}]}}
    got = spark.read.format("search").option("recorded", json.dumps(pages)).option("limit", 2).option("most", 6).load()
    assert {(r["paper_id"], r["pdf"]) for r in got.collect()} == {("1", "u"), ("2", None)}


def test_streaming_resume(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    schema = "k long, ts timestamp_ntz, event_type string"
    spark.sql("SELECT id AS k, timestamp_ntz'2024-01-01 00:00:00' AS ts, 'click' AS event_type FROM range(5)").write.parquet(src)
    run = lambda: I.append_new(I.event_stream(spark, src, schema), out, ck, "k", "ts", "30 days", lambda df: df.select("k"))
    run()
    run()
    spark.sql("SELECT id AS k, timestamp_ntz'2024-01-02 00:00:00' AS ts, 'view' AS event_type FROM range(3, 8)").write.mode("append").parquet(src)
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_windows_with_watermark(spark, tmp_path):
    spark.sql("SELECT id AS k, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id AS int)) AS ts, 'click' AS event_type FROM range(5)").write.parquet(f"{tmp_path}/s")
    w = I.windowed_counts(I.event_stream(spark, f"{tmp_path}/s", "k long, ts timestamp_ntz, event_type string"))
    q = w.writeStream.format("memory").queryName("days_").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days_").count() == 5


def test_sinks(spark):
    q = spark.createDataFrame([("What? <b>", "a & b")], "q string, a string")
    assert q.select(sinks.html_card(F.col("q"), F.col("a")).alias("h")).first()["h"] == '<div class="card"><h2>What? &lt;b&gt;</h2><p>a &amp; b</p></div>'
    name, text = sinks.stream_file(F.col("q"), F.lit(3), F.col("a"))
    r = q.select(name.alias("n"), C.stream_body(text).alias("b")).first()
    assert (r["n"], r["b"]) == ("003_What_b", "a & b")
    refs = F.array(*(F.lit(f"r{k}") for k in range(12)))
    assert q.select(sinks.markdown(F.col("q"), {}, refs).alias("m")).first()["m"].endswith("… and 2 more")
    assert [r["value"] for r in sinks.report("T", spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int"), ["k"]).collect()] == ["T", "k: a  n: 1", "k: b  n: 2"]


def test_scoring_pipeline(spark):
    q = spark.createDataFrame([(k, f"q{k}?\n1) a\n2) b", "2") for k in range(12)], "id int, question string, answer string")
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    out = pipelines.benchmark(pipelines.score_answers(q, models, spark.createDataFrame([], "prompt_hash string, response string"), providers.stub)).collect()
    assert {r["model"] for r in out} == {"m1", "m2"} and all(r["total"] == 12 and r["mc_count"] == 12 for r in out)


def test_patterns_are_linear(spark):
    """Long lines of many openings without an end, and many hits in a text: neither is met pair by pair."""
    text = "the more " * 20_000 + ". " + "maybe " * 4_000
    began = time.time()
    made = spark.createDataFrame([(text,), (None,)], "t string").select(*(C.pattern_count(F.col("t"), k).alias(k) for k in ("evidence", "logical_connector")), C.pattern_hits(F.col("t"), "uncertainty").alias("h"), C.outline(F.col("t")).alias("s"))
    got = made.select("evidence", "logical_connector", "h", C.features(F.col("s"))["uncertainty_std_position"]).collect()
    assert got[0][:2] == (0, 0) and len(got[0][2]) == 4_000 and got[0][2][-1]["position"] == (len(text) - 6) / len(text) and got[0][3] > 0
    assert got[1][:3] == (None, None, None) and time.time() - began < 60


def test_large_envelopes_come_in_parts(spark):
    rows = spark.range(1000).select(F.col("id").alias("q"), F.when(F.col("id") % 10 > 0, "m").alias("model"))
    docs = [(r["model"], json.loads(r["json"])) for r in sinks.envelope(rows, "model", {"kind": F.lit("k")}, most=64).collect()]
    assert all(len(d["results"]) <= 64 and d["metadata"]["total"] == (900 if m else 100) for m, d in docs)
    assert sorted(x["q"] for _, d in docs for x in d["results"]) == list(range(1000))


def test_grams_are_counted_before_they_are_dealt(spark, monkeypatch):
    """Counts by slices of a batch equal those of all n-grams, also where slices end, for rows without words and of one."""
    monkeypatch.setattr(K, "WORDS", 5)
    rows = [(k, [f"w{(k * k + i * i) % 7}" for i in range(k % 9)]) for k in range(60)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc long, words array<string>").repartition(3)
    got = {(r["kind"], r["gram"]): r["n"] for r in K.gram_counts(docs, {"w": (1, 0), "p": (2, 0), "s": (2, 1), "t": (3, 0)}).collect()}
    want = {}
    for _, w in rows:
        for kind, places in (("w", [0]), ("p", [0, 1]), ("s", [0, 2]), ("t", [0, 1, 2])):
            for i in range(len(w or ()) - places[-1]):
                g = kind, " ".join(w[i + p] for p in places)
                want[g] = want.get(g, 0) + 1
    assert got == want
    assert "Generate" not in K.gram_counts(docs, {"t": (3, 0)})._jdf.queryExecution().optimizedPlan().toString()


def test_label_expressions_do_not_repeat_each_other(spark):
    plan = spark.range(1).select(X.is_technical_label(X.cleaned_label(F.col("id").cast("string"))))._jdf.queryExecution().analyzed().toString()
    assert plan.count("after analyzing") < 10


def test_embeddings_of_single_calls(spark):
    """Calls of one text each, some of which fail: every key with its own vector, and no frame a row (which took 2 ms each)."""

    def embed(texts):
        if "7" in texts[0]:
            raise RuntimeError("no embedding")
        return [[float(x), 1.0] for x in texts]

    rows = spark.range(0, 20_000, 1, 1).select("id", F.col("id").cast("string").alias("text"))
    began = time.time()
    got = {r["id"]: list(r["embedding"]) for r in providers.embedded(rows, "id", "text", embed, 2, batch=1).collect()}
    assert time.time() - began < 15
    assert got == {k: [0.0, 0.0] if "7" in str(k) else [float(k), 1.0] for k in range(20_000)}


def test_json_forms_are_made_once(spark):
    """Every form of a model's JSON, and a plan that holds each step once (before, the search for the fence was there 48 times)."""
    texts = {' {"a": 1} ': 1, "7": None, "null": None, "Sure.\n```json\n{\"a\": 2}\n```\nDone": 2, "x {\"a\": 3} y": 3, "```\n{\"a\": 4, \"b\": \"\\alpha\\q\"}\n```": 4, "I can't say": None, "no json": None, "": None, "{": None, "\n\t[{\"a\": 6}]": None, "say {\"a\": 5, \"b\": \"\\s\"}": 5}
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", N.parsed(F.col("t"), "struct<a:int,b:string>").alias("p"))
    got = {r["t"]: r["p"] and r["p"]["a"] for r in d.collect()}
    assert got == {**texts, None: None}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("```") == 2  # begin and end of one pattern


def test_heads_of_texts(spark, tmp_path):
    """At most `limit` characters of each file, decoded as Python does (malformed bytes too), and no file passes a Python worker."""
    made = {"a": "😀".encode() * 9, "b": b"\xf0\x9f\x98" * 9 + b"x", "c": "aé€😀".encode() * 5, "d": b"\xff" * 4 + "é".encode() * 40, "f": b"ab"}
    for name, data in made.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    for limit in (1, 3, 5, 9, None):
        out = files.texts(spark, str(tmp_path), limit=limit)
        got = {r["path"].rsplit("/", 1)[1][0]: r["text"] for r in out.collect()}
        assert got == {k: v.decode("utf-8", "replace")[:limit] for k, v in made.items()}
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_full_trace_makes_each_step_once(spark):
    """The result reads what the last steps wrote; their own steps are not in its plan."""
    q = spark.createDataFrame([(k, f"What is {k}?\n\n1) a\n2) b (*)\n3) c", "2") for k in range(20)], "doc_id long, question string, answer string")
    out = pipelines.full_trace(q, spark.createDataFrame([], "prompt_hash string, response string"), providers.stub)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(20)) and all((r["fault"] is None) == r["one_correct"] for r in rows)
