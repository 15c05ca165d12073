"""Queries of scans, sinks, model calls, clause extraction, resumption and PDF states (the rest of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import choices as R
from scholia.functions import extraction as X
from scholia.functions import jsonx as N
from scholia.functions import reasoning as C
from scholia.functions import text as T
from scholia.operators import clauses as L
from scholia.operators import evaluation as E
from scholia.operators import keywords as K
from scholia.operators import vectors as V
from scholia.plans import pipelines, providers
from scholia.plans.analysis_queries import _SE, _TFIDF, _TOK, _tokens
from scholia.plans.base import ITEMS_SQL, QA_SQL, RESULTS_SQL, items, query, questions, results, spread
from scholia.plans.text_queries import FLOW_SQL, REASONED_SQL, reasoned
from scholia.sources import files, sinks
from scholia.sources.tables import shared_folder
from scholia.streaming import incremental as I


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark, folder: str, texts: dict[str, str]) -> str:
    """Small files of fixed names, written by the driver through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in texts.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    return folder


def _nations(t) -> dict[str, str]:
    return {r["n_name"]: r["n_name"].lower() * 3 for r in t("nation").select("n_name").collect()}


def _name():
    return F.element_at(F.split("path", "/"), -1)


def _laid_out(rows, folder: str, value) -> str:
    """One text file for each source, `folder`/source=.../part-*.txt, written by the tasks that hold the rows: a line (value) a
    row in order of doc_id."""
    lines = rows.select("source", "doc_id", value.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id")
    lines.select("source", "value").write.partitionBy("source").text(folder)
    return folder


def _source():
    return F.regexp_extract("path", "source=([^/]+)", 1)


@query("s01_s05_listing", "SELECT source AS name, sum(length(doc_id::VARCHAR) + length(lang) + 2)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(spark, t):
    d = t("documents").where("source is not null")
    folder = _laid_out(d, _folder(spark, "listing"), F.concat(F.col("doc_id").cast("string"), F.lit(" "), "lang"))
    return files.listing(spark, folder).select(_source().alias("name"), F.col("length").alias("n"))


@query("s07_s08_s11_texts", "SELECT source AS name, substr(string_agg(coalesce(regexp_replace(text, '[\r\n]+', ' ', 'g'), '') || chr(10), '' ORDER BY doc_id), 1, 200000) AS text FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(spark, t):
    d = t("documents").where("source is not null")
    folder = _laid_out(d, _folder(spark, "texts"), F.coalesce(F.regexp_replace("text", r"[\r\n]+", " "), F.lit("")))
    return files.texts(spark, folder, limit=200_000).select(_source().alias("name"), "text")


@query("s13_question_files", "SELECT text AS question, 'a' || item_id AS answer FROM benchmark")
def _(spark, t):
    one = F.struct(F.col("text").alias("question"), F.concat(F.lit("a"), "item_id").alias("answer"))
    sets = t("benchmark").groupBy((F.col("item_id") % 7).alias("source")).agg(F.to_json(F.sort_array(F.collect_list(one))).alias("value"), F.min("item_id").alias("doc_id"))
    folder = _laid_out(sets, _folder(spark, "sets"), F.col("value"))
    spark.range(1).selectExpr("'not' AS source", "0 AS doc_id", """'{"x": 1}' AS value""").select("source", "value").write.mode("append").partitionBy("source").text(folder)
    return files.read_question_sets(spark, [folder]).select("question", "answer")


@query("s18_s19_s27_five_fields", f"WITH {ITEMS_SQL} SELECT doc_id, option AS fault, k::VARCHAR AS severity, NULL::VARCHAR AS missing, '0.5' AS accuracy, 'x: y' AS note FROM items")
def _(spark, t):
    text = F.concat(F.lit("Run\nfault: "), "option", F.lit("\nseverity: 9\nnote: x: y\naccuracy: 0.1\naccuracy: 0.5\nseverity: "), F.col("k").cast("string"))
    return files.report_fields(items(t).select("doc_id", text.alias("text")), "doc_id", "text", ("fault", "severity", "missing", "accuracy", "note"))


@query("s22_search_pages", "SELECT 'p' || n_nationkey AS paper_id, n_name AS title FROM nation")
def _(spark, t):
    import json

    from scholia.sources.search import SearchSource

    rows = [{"paperId": f"p{r['n_nationkey']}", "title": r["n_name"]} for r in t("nation").orderBy("n_nationkey").collect()]
    pages = {str(k): {"data": [*rows[k : k + 10], {"paperId": None, "title": "none"}]} for k in range(0, len(rows), 10)}
    spark.dataSource.register(SearchSource)
    return spark.read.format("search").option("recorded", json.dumps(pages)).option("limit", 10).option("most", 100).load().select("paper_id", "title")


def _fetch(url: str) -> bytes:
    k = int(url.rsplit("/", 1)[1])
    if k % 3 == 0:
        raise ConnectionError(url)
    return b"%PDF-" + b"x" * 200 if k % 3 == 1 else b"<html>" + b"x" * 200


@query("s23_downloads", "SELECT 'h/' || n_nationkey AS url, CASE n_nationkey % 3 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'ok' ELSE 'no pdf' END AS state, CASE n_nationkey % 3 WHEN 1 THEN 205 END AS n FROM nation")
def _(spark, t):
    got = files.downloads(t("nation").select(F.concat(F.lit("h/"), "n_nationkey").alias("url")), _fetch)
    return got.select("url", "state", F.octet_length("content").alias("n"))


@query("s24_s25_registry", "SELECT 'm' || n_nationkey AS shortname, CASE WHEN n_nationkey % 2 = 0 THEN 'secret' ELSE '${UNSET}' END AS key FROM nation")
def _(spark, t):
    text = "servers:\n" + "".join(f"  - shortname: m{r['n_nationkey']}\n    # a note\n    key: {'${KEY}' if r['n_nationkey'] % 2 == 0 else '${UNSET}'}\n" for r in t("nation").collect())
    return spark.createDataFrame([(m["shortname"], m["key"]) for m in files.registry(text, {"KEY": "secret"})], "shortname string, key string")


@query("s26_guidance", "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || lower(n_name) || lower(n_name) ELSE '' END AS text FROM nation")
def _(spark, t):
    keys = {r["n_name"]: r["n_nationkey"] for r in t("nation").collect()}
    names = _nations(t)
    folder = _put(spark, _folder(spark, "guidance"), {f"{keys[k]}.txt": v for k, v in names.items() if keys[k] % 2 == 0})
    got = files.guidance(spark, {k: f"{folder}/{keys[k]}.txt" for k in names})
    return spark.createDataFrame(sorted(got.items()), "name string, text string")


@query("s29_s30_i08_resume", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def _(spark, t):
    done = t("documents").where("doc_id % 3 = 0").select(F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit(" ")).alias("value"))
    return files.unprocessed(t("documents").select(F.col("doc_id").cast("string").alias("id")), "id", done).select(F.col("id").cast("long").alias("doc_id"))


@query("k01_k25_folders", "SELECT source AS topic, count(*) AS n FROM documents GROUP BY 1")
def _(spark, t):
    path = _folder(spark, "topics")
    sinks.write_partitioned(t("documents").select("doc_id", "source"), path, F.col("source"), "topic")
    return spark.read.parquet(path).groupBy(F.col("topic").cast("string").alias("topic")).agg(F.count("*").alias("n"))


@query("k02_appended_items", "SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def _(spark, t):
    path = _folder(spark, "items")
    for k in (0, 1):
        sinks.append_items(t("part").where(F.col("p_partkey") % 2 == k).select("p_partkey", "p_brand", "p_size"), path)
    return sinks.json_array(spark, path, "p_partkey long, p_brand string, p_size int").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("k03_k04_envelopes", f"WITH {RESULTS_SQL} SELECT model, count(*) AS total, sum(score) AS score FROM r WHERE NOT skipped AND CASE WHEN format = 'mc' THEN score < 1 ELSE score < 0.5 END GROUP BY model")
def _(spark, t):
    bad = results(t).where(~F.col("skipped") & E.incorrect(F.col("format"), F.col("score"))).select("question_id", "model", "score")
    env = sinks.envelope(bad, "model", {"kind": F.lit("incorrect")})
    e = F.from_json("json", "struct<metadata:struct<model:string,total:bigint,kind:string>,results:array<struct<question_id:bigint,model:string,score:double>>>")
    parts = env.select(e.alias("e")).select("e.metadata.model", "e.metadata.total", F.aggregate("e.results", F.lit(0.0), lambda s, x: s + x["score"]).alias("score"))
    return parts.groupBy("model", "total").agg(F.sum("score").alias("score"))


@query("k06_k13_k15_papers", "SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '## Methods' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '- r1' || chr(10) || '- r2' || CASE WHEN p_size % 5 > 0 THEN chr(10) || '- … and ' || (p_size % 5) || ' more' ELSE '' END AS md FROM part")
def _(spark, t):
    refs = F.transform(F.sequence(F.lit(1), 2 + F.col("p_size") % 5), lambda k: F.concat(F.lit("r"), k.cast("string")))
    return t("part").select("p_partkey", sinks.markdown(F.col("p_name"), {"Methods": F.col("p_type"), "Empty": F.lit(None).cast("string")}, refs, shown=2).alias("md"))


@query("k07_cards", """SELECT p_partkey, '<div class="card"><h2>' || p_name || ' &lt;b&gt; &amp; &quot;</h2><p>' || p_type || '</p></div>' AS html FROM part""")
def _(spark, t):
    return t("part").select("p_partkey", sinks.html_card(F.concat("p_name", F.lit(' <b> & "')), F.col("p_type")).alias("html"))


@query("k08_k16_k22_k24_k31_report", """WITH {R}, s AS (SELECT model, count(*) AS n FROM r GROUP BY 1) SELECT 'Run' AS value UNION ALL SELECT 'model: ' || model || '  n: ' || n FROM s""".replace("{R}", RESULTS_SQL))
def _(spark, t):
    return sinks.report("Run", results(t).groupBy("model").agg(F.count("*").alias("n")), ["model"])


@query("k09_stream_files", "SELECT p_partkey, lpad(p_size::VARCHAR, 3, '0') || '_' AS prefix, length(p_type) + length(p_name) + 80 * 2 + 40 + length(p_size::VARCHAR) + 36 AS n FROM part")
def _(spark, t):
    name, text = sinks.stream_file(F.col("p_name"), F.col("p_size"), F.col("p_type"))
    return t("part").select("p_partkey", F.substring(name, 1, 4).alias("prefix"), F.length(text).alias("n"))


@query("k30_plot_table", "SELECT least(19, floor(p_size / 2.5))::INT AS bin, min(floor(least(19, floor(p_size / 2.5))) * 2.5)::DOUBLE AS \"left\", count(*) AS n FROM part WHERE p_size BETWEEN 0 AND 50 GROUP BY 1")
def _(spark, t):
    return sinks.plot_table(t("part").withColumn("x", F.col("p_size").cast("double")), "x", 0.0, 50.0, 20).select("bin", "left", "n")


@query("k32_error_log", "SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || event_type || ': e' || event_id AS value FROM events WHERE event_type = 'error'")
def _(spark, t):
    e = t("events").where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("category"), F.concat(F.lit("e"), "event_id").alias("message"))
    return sinks.error_lines(e)


@query("p01_reference_answers", f"WITH {QA_SQL} SELECT conv_id, turn, question, CASE WHEN turn % 4 = 0 THEN answer ELSE 'x' END AS answer FROM qa WHERE conv_id % 3 <> 0 AND question <> '' AND (turn % 4 <> 0 OR answer <> '')")
def _(spark, t):
    q = questions(t).withColumn("reference_answer", F.when(F.col("conv_id") % 3 == 0, "").when(F.col("turn") % 4 == 0, F.col("answer")).otherwise("x"))
    return E.reference_answers(q.drop("answer"))


@query("p04_g02_relevance_gate", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 3 END AS score, doc_id % 3 <> 2 AS is_relevant FROM documents")
def _(spark, t):
    r = F.when(F.col("doc_id") % 3 == 1, "RELEVANCE_SCORE: 8\nREASONING: x").when(F.col("doc_id") % 3 == 2, "RELEVANCE_SCORE: 3")
    return t("documents").select("doc_id", providers.relevance(r).alias("r")).select("doc_id", "r.score", "r.is_relevant")


@query("p16_o07_alive_models", "SELECT 'm' || n_nationkey AS model FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, t):
    m = t("nation").select(F.concat(F.lit("m"), "n_nationkey").alias("model"))
    return providers.alive(m, _none(spark), _even)


def _none(spark):
    return spark.createDataFrame([], "prompt_hash string, response string")


def _even(prompts: list[str]) -> list[str | None]:
    return ["ok" if int(p.split("\n")[0][7:]) % 2 == 0 else None for p in prompts]


def _upper(prompts: list[str]) -> list[str | None]:
    return [None if "7" in p else p.upper() for p in prompts]


@query("p18_relevant_papers", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0")
def _(spark, t):
    r = F.expr("CASE doc_id % 4 WHEN 0 THEN ' Relevant ' WHEN 1 THEN 'not relevant' WHEN 2 THEN 'irrelevant' END")
    return t("documents").where(providers.is_relevant(r)).select("doc_id")


@query("p19_document_kinds", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'TOOL' WHEN 1 THEN 'PROBLEM' WHEN 2 THEN 'TOOL' WHEN 3 THEN 'UNKNOWN' ELSE 'ERROR' END AS kind, doc_id % 5 NOT IN (0, 2) AS kept FROM documents")
def _(spark, t):
    r = F.expr("CASE doc_id % 5 WHEN 0 THEN 'tool' WHEN 1 THEN ' Problem.' WHEN 2 THEN 'a PROBLEM of a Tool' WHEN 3 THEN 'neither' END")
    k = providers.document_kind(r)
    return t("documents").select("doc_id", k.alias("kind"), providers.wanted(k, "PROBLEM").alias("kept"))


@query("p24_n06_synthesis", "SELECT doc_id, s AS section, CASE WHEN (doc_id + length(s)) % 3 = 0 THEN 'again' ELSE 'ok ' || s END AS content, CASE WHEN (doc_id + length(s)) % 3 = 0 THEN 'synthesised' END AS note FROM documents, (VALUES ('methods'), ('results')) v(s)")
def _(spark, t):
    return pipelines.structured_papers(t("documents").select("doc_id", F.col("doc_id").cast("string").alias("text")), ("methods", "results"), ("Not Available",), _none(spark), _sections)


def _sections(prompts: list[str]) -> list[str | None]:
    out = []
    for p in prompts:
        section = p.split("section ", 1)[1].split(" ", 1)[0]
        k = int(p.rsplit("\n", 1)[1]) + len(section)
        out.append('{"content": "again"}' if "missing" in p else None if k % 6 == 0 else '{"content": "not available here"}' if k % 3 == 0 else f'Sure:\n```json\n{{"content": "ok {section}"}}\n```')
    return out


@query("p27_strata", f"WITH {RESULTS_SQL} SELECT stratum, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN score = 1 AND c = 'high' THEN 'correct_high' END, CASE WHEN score <> 1 THEN 'incorrect' END, CASE WHEN c = 'low' THEN 'low' END], lambda x: x IS NOT NULL)) AS stratum FROM (SELECT score, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence < 0.3 THEN 'low' ELSE 'medium' END AS c FROM r)) GROUP BY 1")
def _(spark, t):
    c = F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") < 0.3, "low").otherwise("medium")
    return results(t).select(F.explode(E.stratum(F.col("score") == 1, c)).alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))


_ARG_SQL = "a AS (SELECT l_orderkey AS doc, l_linenumber AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'modus_ponens' ELSE l_linestatus END AS kind, l_discount * 10 AS confidence, l_tax < 0.05 AS validity FROM lineitem)"


def _arguments(t):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "modus_ponens").otherwise(F.col("l_linestatus"))
    return t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), kind.alias("kind"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") < 0.05).alias("validity"))


@query("p28_fallacies", f"WITH {_ARG_SQL} SELECT doc, id, 'weak_argument' AS fallacy FROM a WHERE confidence < 0.3 UNION ALL SELECT doc, id, 'affirming_consequent' FROM a WHERE kind = 'modus_ponens' AND NOT validity")
def _(spark, t):
    return L.fallacies(_arguments(t)).select("doc", "id", "fallacy")


@query("a31_argument_summary", f"WITH {_ARG_SQL} SELECT doc, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, count(*) FILTER (validity) / count(*) AS deductive_ratio, count(DISTINCT kind) AS kinds FROM a GROUP BY doc")
def _(spark, t):
    return L.argument_summary(_arguments(t)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("j04_wrong_with_stream", f"WITH {ITEMS_SQL} SELECT i.doc_id, d.lang FROM items i JOIN documents d ON d.doc_id = i.doc_id AND d.doc_id % 4 <> 0 WHERE i.k <> 2")
def _(spark, t):
    faults = items(t).select("doc_id", F.lit("2").alias("prediction"), F.col("k").cast("string").alias("correct"))
    wrong = faults.where(E.wrong(F.col("prediction"), F.col("correct"), normalise=False))
    return wrong.join(t("documents").where("doc_id % 4 <> 0").select("doc_id", "lang"), "doc_id").select("doc_id", "lang")


@query("j08_topics_of_files", "SELECT d.doc_id, c.topic FROM documents d LEFT JOIN (SELECT source || '.v' AS file_id, upper(source) AS topic FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src1')) c ON c.file_id = d.source || '.v'")
def _(spark, t):
    d = t("documents")
    named = d.select("doc_id", T.stem(F.concat(F.lit("/a/b/"), "source", F.lit(".v.pdf"))).alias("file_id"))
    topics = d.where("source <> 'src1'").select(F.concat("source", F.lit(".v")).alias("file_id"), F.upper("source").alias("topic")).distinct()
    return named.join(topics, "file_id", "left").select("doc_id", "topic")


@query("j09_premises", f"WITH {REASONED_SQL}, {_SE} SELECT a.doc, 0 AS id, p1.s || '|' || p2.s AS premises, c.s AS conclusion_text FROM (SELECT DISTINCT doc FROM se) a JOIN se p1 ON p1.doc = a.doc AND p1.ord = 1 JOIN se p2 ON p2.doc = a.doc AND p2.ord = 0 JOIN se c ON c.doc = a.doc AND c.ord = a.doc % 40")
def _(spark, t):
    c = L.clauses(reasoned(t), "doc_id", "text")
    a = c.select("doc").distinct().select("doc", F.lit(0).alias("id"), F.array(F.lit(1), F.lit(0)).alias("premises"), (F.col("doc") % 40).cast("int").alias("conclusion"))
    return L.with_premises(a, c).select("doc", "id", F.array_join("premises", "|").alias("premises"), "conclusion_text")


@query("j11_modus_tollens", "SELECT p_partkey AS doc, 0 AS p_ord, 1 AS q_ord, 2 AS not_q, 3 AS not_p FROM part")
def _(spark, t):
    text = F.concat(F.lit("The valve "), F.col("p_partkey").cast("string"), F.lit(" opens now. The pump "), F.col("p_partkey").cast("string"), F.lit(" runs today. The pump "), F.col("p_partkey").cast("string"), F.lit(" never runs today. The valve "), F.col("p_partkey").cast("string"), F.lit(" never opens now. Quite another matter here."))
    c = L.clauses(spread(t("part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), "doc_id", "text")
    return L.modus_tollens(c, F.col("ord") == 0, F.col("ord") == 1)


@query("j27_relations", "SELECT p_partkey AS doc, 0 AS i, 1 AS j, CASE p_size % 3 WHEN 0 THEN 'implies' WHEN 1 THEN 'contrast' ELSE 'conditional' END AS relation FROM part WHERE p_size % 4 <> 3")
def _(spark, t):
    between = F.element_at(F.array(F.lit(" Thus: "), F.lit(" However, "), F.lit(" When; ")), F.col("p_size") % 3 + 1)
    p = t("part").select(F.col("p_partkey").alias("doc"), F.when(F.col("p_size") % 4 == 3, " ... ").otherwise(between).alias("m"))
    c = p.select("doc", F.posexplode(F.array(F.lit("first clause"), F.lit("next clause"), F.lit("last"))).alias("ord", "text"))
    return L.relations(c, p.select("doc", F.concat(F.lit("first clause"), "m", F.lit("next clause"), F.lit("."), F.lit("last")).alias("text")))


@query("j28_windowed_detectors", f"WITH {REASONED_SQL}, {_SE}, a AS (SELECT * FROM se WHERE contains(lower(s), 'evidence')), b AS (SELECT * FROM se WHERE contains(lower(s), 'wait')) SELECT a.doc, a.ord AS a_ord, b.ord AS b_ord FROM a JOIN b ON a.doc = b.doc AND b.ord > a.ord AND b.ord <= a.ord + 2")
def _(spark, t):
    low = F.lower("text")
    return L.band_pairs(L.clauses(reasoned(t), "doc_id", "text"), low.contains("evidence"), low.contains("wait"), 2)


@query("a12_a13_run_breakdown", f"""WITH {RESULTS_SQL}, x AS (SELECT CASE WHEN confidence IS NOT NULL THEN score >= 0.5 END AS correct, CASE WHEN price > 50000 THEN 'high' WHEN price > 20000 THEN 'medium' ELSE 'low' END AS confidence FROM r)
  SELECT (SELECT count(DISTINCT question_id // 1000) FROM r) AS batches, count(*) AS n, count(correct) AS graded, count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(correct) AS accuracy, count(*) FILTER (correct AND confidence = 'high') / count(correct) FILTER (confidence = 'high') AS high_accuracy FROM x""")
def _(spark, t):
    c = F.when(F.col("price") > 50000, "high").when(F.col("price") > 20000, "medium").otherwise("low")
    x = results(t).select("question_id", F.when(F.col("confidence").isNotNull(), F.col("score") >= 0.5).alias("correct"), c.alias("confidence"))
    return E.merged_summaries(E.batch_summaries(x, "question_id", 1000)).select("batches", "n", "graded", "correct", "accuracy", "high_accuracy")


@query("t06_t07_seeded_samples", "SELECT least(100, count(*)) AS n, least(100, count(*)) AS distinct_rows, true AS repeatable FROM documents")
def _(spark, t):
    d = t("documents").select("doc_id")
    one, two = (E.sample_by_hash(d, "doc_id", 100, 42) for _ in range(2))
    both = one.withColumn("k", F.lit(1)).union(two.withColumn("k", F.lit(2))).groupBy("doc_id").agg(F.count_if(F.col("k") == 1).alias("a"), F.count_if(F.col("k") == 2).alias("b"))
    return both.agg(F.sum("a").alias("n"), F.count("*").alias("distinct_rows"), F.bool_and(F.col("a") == F.col("b")).alias("repeatable"))


@query("t13_top_terms", f"WITH {_TOK}, {_TFIDF} SELECT term, round(sum(weight) / any_value(n), 9) AS score FROM ws, nn GROUP BY term ORDER BY score DESC, term LIMIT 10")
def _(spark, t):
    return K.tfidf_keywords(_tokens(t), k=10).select("term", F.round("score", 9).alias("score"))


@query("u05_clause_similarity", r"""WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b, p_size % 2 = 0 AS same, p_size % 3 = 0 AS shared FROM part)
  SELECT p_partkey, round(least(1.0, len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) + CASE WHEN same THEN 0.3 ELSE 0 END + CASE WHEN shared THEN 0.2 ELSE 0 END), 9)::DOUBLE AS s FROM p""")
def _(spark, t):
    p = t("part")
    a = F.struct(F.lower("p_name").alias("normalized_form"), F.lit("x").alias("predicate"), F.array(F.lit("s")).alias("subjects"))
    b = F.struct(F.lower("p_type").alias("normalized_form"), F.when(F.col("p_size") % 2 == 0, "x").otherwise("y").alias("predicate"), F.array(F.when(F.col("p_size") % 3 == 0, "s").otherwise("t")).alias("subjects"))
    return p.select("p_partkey", F.round(C.similarity(a, b), 9).alias("s"))


@query("u08_unique_steps", f"WITH {REASONED_SQL}, {FLOW_SQL} SELECT doc_id, count(DISTINCT step) AS n FROM fl GROUP BY 1")
def _(spark, t):
    return reasoned(t).select("doc_id", F.size(F.array_distinct(C.flow(F.col("text")))).cast("long").alias("n"))


@query("c04_r07_options", f"WITH {ITEMS_SQL} SELECT i.doc_id, array_to_string(list_transform(range(1, 6), lambda j: j::VARCHAR || ') ' || w.w[j + 1]), chr(10)) AS text FROM items i JOIN w USING (doc_id)")
def _(spark, t):
    return items(t).select("doc_id", R.options_text(R.line_options(F.col("question"))).alias("text"))


@query("c10_kept_and_filtered", "SELECT 'kept' AS side, count(*) AS n FROM part WHERE p_size >= 6 AND p_size % 10 >= 7 UNION ALL SELECT 'filtered', count(*) FROM part WHERE NOT (p_size >= 6 AND p_size % 10 >= 7)")
def _(spark, t):
    kept, rest = E.kept_and_filtered(t("part"), E.route(F.col("p_size"), F.col("p_size") % 10, F.col("p_name")))
    return kept.select(F.lit("kept").alias("side")).union(rest.select(F.lit("filtered"))).groupBy("side").agg(F.count("*").alias("n"))


@query("c11_clauses", f"WITH {REASONED_SQL}, {_SE} SELECT doc, count(*) AS n, sum(length(s))::BIGINT AS chars FROM se GROUP BY doc")
def _(spark, t):
    return L.clauses(reasoned(t), "doc_id", "text").groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("c13_split_and_merged", "SELECT cluster, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY p_size) >= 5 THEN p_size ELSE -1 END AS cluster FROM part) GROUP BY 1")
def _(spark, t):
    return V.split_and_merged(t("part").select("p_partkey", F.col("p_size").alias("cluster")), "cluster", 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query("f13_clean_answers", "SELECT p_partkey, p_name || ' ends|' || p_type AS clean FROM part")
def _(spark, t):
    a = F.array(F.concat(F.lit("The question is clear, yes. "), "p_name", F.lit(" ends")), F.concat("p_type", F.lit(" (B) ")))
    return t("part").select("p_partkey", F.array_join(F.transform(T.cleaned_answers(a), lambda x: F.trim(x)), "|").alias("clean"))


@query("f16_g31_long_labels", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'gene ' || p_type WHEN 1 THEN 'Research Topic ' || p_size || ' papers' WHEN 2 THEN substr(p_name || ' and ' || p_name || ' and ' || p_name, 1, 50) ELSE 'Research Topic ' || p_size || ' papers' END AS label FROM part")
def _(spark, t):
    r = F.element_at(F.array(F.concat(F.lit('Topic label: "is focused on gene '), "p_type", F.lit('"\nmore')), F.lit("The answer"), F.concat(F.lit("Theme: "), "p_name", F.lit(" and "), "p_name", F.lit(" and "), "p_name"), F.lit("Label: Research on x")), F.col("p_size") % 4 + 1)
    return t("part").select("p_partkey", T.long_label(r, F.col("p_size")).alias("label"))


@query("f20_wrapped", "SELECT doc_id, true AS fits, regexp_replace(text, '\\s+', '', 'g') AS bare FROM documents")
def _(spark, t):
    w = T.wrapped(F.col("text"), 80)
    # a word longer than a line is broken, so that no line is longer
    return t("documents").select("doc_id", F.forall(F.split(w, "\n"), lambda x: F.length(x) <= 80).alias("fits"), F.regexp_replace(w, r"\s+", "").alias("bare"))


_PARTS = "'The ' || p_name || ' is ' || p_type || ', and Alice quickly mends pumps in ' || p_brand || '.'"
_VERB = " , ".join(f"nullif(regexp_extract(s, '(?i){p}', {g}), '')" for p, g in X.VERBS)
_OBJ = "list_concat(" + ", ".join(f"regexp_extract_all(s, '(?i){p}', 1)" for p in X.OBJECTS) + ")"
_MOD = "list_concat(" + ", ".join(f"regexp_extract_all(s, '(?i){p}', {g})" for p, g in X.MODIFIERS) + ")"


@query("f28_clause_parts", f"WITH x AS (SELECT p_partkey, {_PARTS} AS s FROM part) SELECT p_partkey, coalesce({_VERB}, 'relates') AS predicate, array_to_string(list_filter(list_transform({_OBJ}, lambda o: trim(o)), lambda o: length(o) > 2), '|') AS objects, array_to_string({_MOD}, '|') AS modifiers, true AS alice FROM x")
def _(spark, t):
    s = F.expr(_PARTS)
    return t("part").select("p_partkey", X.predicate(s).alias("predicate"), F.array_join(X.objects(s), "|").alias("objects"), F.array_join(X.modifiers(s), "|").alias("modifiers"), F.array_contains(X.subjects(s), "Alice").alias("alice"))


@query("f35_c12_propositions", r"""WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^ -~\n]', 'x', 'g'), '\s+'), lambda w: w <> '') AS w FROM documents)
  SELECT doc_id, coalesce(list_filter(w, lambda v: length(v) > 3 AND (ends_with(v, 's') OR ends_with(v, 'ed') OR ends_with(v, 'ing')))[1], 'relates') AS verb, array_to_string(list_filter(w, lambda v: regexp_matches(v, '^[A-Z][A-Za-z]*$'))[1:2], '|') AS entities FROM x""")
def _(spark, t):
    s = F.regexp_replace("text", r"[^ -~\n]", "x")
    return t("documents").select("doc_id", X.simple_verb(s).alias("verb"), F.array_join(X.entities(s), "|").alias("entities"))


@query("r03_wide_choices", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'letter' WHEN 1 THEN 'number' ELSE 'letter' END AS kind, CASE p_size % 3 WHEN 0 THEN chr(70 + (p_size % 5)::INT) WHEN 1 THEN (6 + p_size % 4)::VARCHAR ELSE 'J' END AS id FROM part")
def _(spark, t):
    letter, number = F.chr((70 + F.col("p_size") % 5).cast("long")), (6 + F.col("p_size") % 4).cast("string")
    a = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The answer is "), letter, F.lit("."))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("So\n"), number, F.lit(") this"))).otherwise("I take option J here")
    c = R.choice(a, "A-J", "1-9")
    return t("part").select("p_partkey", c["kind"].alias("kind"), c["id"].alias("id"))


@query("r16_g07_g08_grades", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 ELSE CASE WHEN p_size % 2 = 0 THEN 0.0 END END::DOUBLE AS score, CASE WHEN p_size % 2 = 0 THEN CASE p_size % 4 WHEN 0 THEN 'A' ELSE 'C' END END AS correct_letter, CASE WHEN p_size % 2 = 0 THEN 'mc' ELSE 'qa' END AS format FROM part")
def _(spark, t):
    text = F.expr("""CASE p_size % 4 WHEN 0 THEN '{"match": true, "correct_choice": "A"}' WHEN 1 THEN '{"match": false}' WHEN 2 THEN '{"score": 0.25, "correct_choice": "B", "correct_letter": "C"}' ELSE '{}' END""")
    fmt = F.when(F.col("p_size") % 2 == 0, "mc").otherwise("qa")
    g = R.normalised_grade(F.from_json(text, R.GRADE), fmt)
    return t("part").select("p_partkey", g["score"].alias("score"), g["correct_letter"].alias("correct_letter"), g["format"].alias("format"))


@query("n02_n04_n05_n07_repaired_json", "SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN p_size END AS a, CASE WHEN p_size % 5 = 3 THEN '\\alpha' WHEN p_size % 5 < 4 THEN p_type END AS b FROM part")
def _(spark, t):
    body = F.concat(F.lit('{"a": '), F.col("p_size").cast("string"), F.lit(', "b": "'), F.when(F.col("p_size") % 5 == 3, F.lit("\\alpha")).otherwise(F.col("p_type")), F.lit('"}'))
    text = F.when(F.col("p_size") % 5 == 0, body).when(F.col("p_size") % 5 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(F.col("p_size") % 5 == 2, F.concat(F.lit("Answer: "), body, F.lit(" ok"))).when(F.col("p_size") % 5 == 3, body).otherwise("no json")
    p = N.parsed(text, "struct<a:int,b:string>")
    return t("part").select("p_partkey", p["a"].alias("a"), p["b"].alias("b"))


@query("m14_m15_labels", "SELECT p_partkey, CASE WHEN abs(x) < 3 AND abs(y) < 3 THEN 'Core Mechanisms' WHEN x > 15 THEN CASE WHEN y > 0 THEN 'Advanced Therapeutics' ELSE 'Applied Interventions' END WHEN x < -15 THEN CASE WHEN y > 0 THEN 'Fundamental Pathways' ELSE 'Clinical Applications' END WHEN y > 15 THEN 'Theoretical Models' WHEN y < -15 THEN 'Experimental Methods' WHEN x > 8 THEN CASE WHEN y > 0 THEN 'Therapeutic Approaches' ELSE 'Treatment Protocols' END WHEN x < -8 THEN CASE WHEN y > 0 THEN 'Molecular Mechanisms' ELSE 'Diagnostic Methods' END WHEN y > 8 THEN 'Pathway Analysis' WHEN y < -8 THEN 'Cellular Responses' ELSE 'Biomedical Mechanisms' END || ' Studies' AS label, CASE WHEN abs(x) < 5 AND abs(y) < 5 THEN 'Core' WHEN x > 10 THEN CASE WHEN y > 0 THEN 'Advanced' ELSE 'Applied' END WHEN x < -10 THEN CASE WHEN y > 0 THEN 'Fundamental' ELSE 'Clinical' END WHEN y > 10 THEN 'Theoretical' WHEN y < -10 THEN 'Experimental' ELSE 'General' END || ' Medical Studies' AS place, round(sqrt(x * x + y * y), 9) AS distance FROM (SELECT p_partkey, p_size::DOUBLE - 25 AS x, (floor(p_retailprice)::BIGINT % 50 - 25)::DOUBLE AS y FROM part)")
def _(spark, t):
    x, y = F.col("x"), F.col("y")
    p = t("part").select("p_partkey", (F.col("p_size").cast("double") - 25).alias("x"), (F.floor("p_retailprice") % 50 - 25).cast("double").alias("y"))
    return p.select("p_partkey", V.specific_label(x, y, F.lit(60)).alias("label"), V.position_label(x, y, F.lit(60)).alias("place"), F.round(F.sqrt(x * x + y * y), 9).alias("distance"))


def _lengths(texts: list[str]) -> list[list[float]]:
    if any("almond" in x for x in texts):
        raise RuntimeError("no embedding")
    return [[float(len(x)), 1.0] for x in texts]


@query("m16_embeddings", "SELECT p_partkey, CASE WHEN contains(p_name, 'almond') THEN 0.0 ELSE length(p_name) END::DOUBLE AS x, CASE WHEN contains(p_name, 'almond') THEN 0.0 ELSE 1.0 END::DOUBLE AS y FROM part")
def _(spark, t):
    e = providers.embedded(t("part").select("p_partkey", "p_name"), "p_partkey", "p_name", _lengths, 2, batch=1)
    return e.select("p_partkey", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


@query("m18_remaining_time", "SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN least(86400.0, 5000.0 / (p_size % 7) * (100 - p_size % 7)) END::DOUBLE AS seconds FROM part")
def _(spark, t):
    return t("part").select("p_partkey", T.remaining(F.col("p_size") % 7, F.lit(100), F.lit(5000.0)).alias("seconds"))


_PDF = {"good": "%PDF-1.4\n1 0 obj <</Type /Page>> stream\nBT (x) Tj ET\nendstream\n%%EOF", "encrypted": "%PDF-1.4\n1 0 obj <</Type /Page>>\ntrailer <</Encrypt 5 0 R>>\n%%EOF", "scanned": "%PDF-1.4\n1 0 obj <</Type /Page>> stream\nq 1 0 0 1 Do Q\nendstream\n%%EOF", "invalid": "%PDF-1.4\n1 0 obj <</Type /Page>>"}


@query("v02_v08_pdf_states", "SELECT 'f' || p_partkey AS path, CASE p_partkey % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'encrypted' WHEN 2 THEN 'scanned' WHEN 3 THEN 'invalid' WHEN 4 THEN 'bad header' ELSE 'empty' END AS state FROM part")
def _(spark, t):
    pad = " " * 100
    texts = [x.replace("%PDF-1.4", "%PDF-1.4" + pad) for x in _PDF.values()] + ["<html>" + pad, ""]
    content = F.encode(F.element_at(F.array(*(F.lit(x) for x in texts)), (F.col("p_partkey") % 6 + 1).cast("int")), "UTF-8")
    return files.validated(t("part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content")))


@query("i02_upserted_counters", "SELECT s AS status, count(*) AS n FROM (SELECT arg_max(event_type, event_id) AS s FROM events GROUP BY user_id) GROUP BY 1")
def _(spark, t):
    e = t("events").select("user_id", "event_id", F.col("event_type").alias("status"))
    state = I.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")
    return I.counters(state, "status")


@query("i03_i04_saved_state", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS p_size, 'new' AS stage FROM part")
def _(spark, t):
    path = _folder(spark, "state")
    I.save_state(t("part").select("p_partkey", F.lit(0).alias("p_size")), path)
    I.save_state(t("part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("p_size")), path)
    return I.filled(I.load_state(spark, path), {"p_size": "-1", "stage": "'new'"})


@query("i06_i07_batched_appends", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(spark, t):
    source, path, checkpoint = (_folder(spark, x) for x in ("in", "out", "offsets"))
    p = t("part").select("p_partkey", "p_brand")
    p.repartition(3).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        I.saved_in_batches(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(source), path, checkpoint)
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("o01_o04_o06_g01_g06_ordered_calls", "SELECT p_partkey, upper('ask ' || p_partkey) AS response FROM part WHERE NOT contains(p_partkey::VARCHAR, '7')")
def _(spark, t):
    rows = t("part").select("p_partkey")
    return providers.ordered(rows, "p_partkey", F.concat(F.lit("ask "), F.col("p_partkey").cast("string")), _none(spark), providers.retrying(_upper, tries=2, jitter=(0.0, 0.0)))


@query("g10_g16_g18_g21_g30_json_calls", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'high' ELSE 'unknown' END AS plausibility, p_size % 3 = 0 AS is_match, CASE p_size % 3 WHEN 0 THEN 'logic' ELSE 'unknown' END AS fault_type, CASE p_size % 3 WHEN 0 THEN 0.75 ELSE 0.0 END::DOUBLE AS overall, CASE p_size % 3 WHEN 0 THEN 'd' ELSE '' END AS diagnosis, CASE p_size % 3 WHEN 0 THEN '4' ELSE '1' END AS predicted, CASE p_size % 3 WHEN 0 THEN 2 ELSE 0 END AS clauses, CASE p_size % 3 WHEN 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS quality FROM part""")
def _(spark, t):
    text = '{"analysis": "a", "plausibility": "high", "is_match": true, "fault_type": "logic", "severity": "low", "sound": true, "consistency": 1, "disagreement": 0, "grounding": 1, "overall": 0.75, "diagnosis": "d", "best": "4", "predicted": "4", "confidence": "high", "clauses": ["x", "y"], "quality": 0.9}'
    r = F.when(F.col("p_size") % 3 == 0, F.lit(f"Sure.\n```json\n{text}\n```")).when(F.col("p_size") % 3 == 1, "I can't say")
    g = {k: providers.CALLS[k][1](r) for k in ("G10", "G15", "G16", "G17", "G18", "G21", "G30")}
    return spread(t("part"), "p_partkey").select("p_partkey", g["G10"]["plausibility"].alias("plausibility"), g["G15"].alias("is_match"), g["G16"]["fault_type"].alias("fault_type"), g["G17"]["overall"].alias("overall"), g["G18"]["diagnosis"].alias("diagnosis"), g["G21"]["predicted"].alias("predicted"), F.size(g["G30"]["clauses"]).alias("clauses"), g["G30"]["quality"].alias("quality"))


@query("g13_g19_g22_g29_g32_text_calls", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS told, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'ERROR: no answer' END AS extracted, 'Compare the two predictions.' || chr(10) || 'FIRST: ' || p_size || chr(10) || 'SECOND: ' AS prompt FROM part")
def _(spark, t):
    r = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n "), "p_name", F.lit(" \n")))
    told = [providers.CALLS[k][1](r) for k in ("G13", "G19", "G22", "G32")]
    same = F.when((told[0] == told[1]) & (told[1] == told[2]) & (told[2] == told[3]), told[0])
    return t("part").select("p_partkey", same.alias("told"), providers.CALLS["G29"][1](r).alias("extracted"), providers.call_prompt("G13", one=F.col("p_size"), two=F.lit(None)).alias("prompt"))


@query("g23_g25_scores_and_keywords", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::DOUBLE AS score, CASE WHEN p_size % 2 = 0 THEN p_name || '|' || p_type || '|3|4|5' ELSE '' END AS phrases FROM part")
def _(spark, t):
    on = F.col("p_size") % 2 == 0
    score = F.when(on, F.concat(F.lit("ok\nSCORE: "), F.col("p_size").cast("string")))
    lines = F.when(on, F.concat(F.lit("1. "), "p_name", F.lit("\n\n- "), "p_type", F.lit("\n* 3\n4) 4\n5\n6")))
    return t("part").select("p_partkey", providers.CALLS["G23"][1](score).alias("score"), F.array_join(providers.CALLS["G25"][1](lines), "|").alias("phrases"))


@query("g26_paper_scores", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2.5 * p_size + 1.1 * 2 ELSE 0.0 END::DOUBLE AS total FROM part")
def _(spark, t):
    r = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"scientific_significance": '), F.col("p_size").cast("string"), F.lit(', "experimental_elegance": 2, "other": 9}')))
    return t("part").select("p_partkey", F.round(E.weighted_total(providers.CALLS["G26"][1](r)), 9).alias("total"))


@query("g11_g12_g14_g20_full_trace")
def _(spark, t):
    tr = pipelines.full_trace(items(t).select("doc_id", "question", "answer"), _none(spark), providers.stub)
    return tr.select("doc_id", "one.predicted", "one_correct", "two_correct", F.col("fault").isNotNull().alias("has_fault"))


@query("o08_reasoning_suite", f"WITH {REASONED_SQL}, {FLOW_SQL} SELECT lang, step, count(*) AS n FROM fl GROUP BY 1, 2")
def _(spark, t):
    return pipelines.reasoning_suite(reasoned(t), "lang")["flow"]


@query("o09_incorrect_logic", f"WITH {REASONED_SQL}, {_SE} SELECT doc, count(*) AS n FROM se WHERE doc % 5 + 1 <> 2 GROUP BY doc")
def _(spark, t):
    faults = t("documents").select(F.col("doc_id").alias("doc"), F.lit("2").alias("prediction"), (F.col("doc_id") % 5 + 1).cast("string").alias("correct"))
    return pipelines.incorrect_logic(faults, reasoned(t).select(F.col("doc_id").alias("doc"), "text")).groupBy("doc").agg(F.count("*").alias("n"))
