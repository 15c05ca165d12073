"""Queries of gates, rollups, set operations, joins, ranking and incremental state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholia.functions import choices as R
from scholia.functions.text import question_hash
from scholia.operators import evaluation as E
from scholia.plans.base import ITEMS_SQL, QA_SQL, RESULTS_SQL, items, query, questions, results

_INCORRECT = "(CASE WHEN format = 'mc' THEN score < 1 ELSE score < 0.5 END)"
_ACC = f"""count(*) AS total, count(*) FILTER (NOT skipped) AS processed, count(*) FILTER (NOT skipped AND format = 'mc') AS mc_count, count(*) FILTER (NOT skipped AND format = 'qa') AS qa_count,
  avg(score) FILTER (NOT skipped) AS accuracy, avg(score) FILTER (NOT skipped AND format = 'mc') AS mc_accuracy, avg(score) FILTER (NOT skipped AND format = 'qa') AS qa_accuracy,
  avg(coalesce(confidence, 0)) FILTER (NOT skipped AND format = 'mc') AS mc_confidence, count(*) FILTER (NOT skipped AND {_INCORRECT}) AS incorrect,
  count(*) FILTER (NOT skipped AND {_INCORRECT}) / greatest(count(*) FILTER (NOT skipped), 1) AS incorrect_rate"""


@query("a01_a04_accuracy_by_model", f"WITH {RESULTS_SQL} SELECT model, {_ACC} FROM r GROUP BY model")
def _(spark, t):
    return E.accuracy(results(t), ["model"])


@query("a02_accuracy_overall", f"WITH {RESULTS_SQL} SELECT {_ACC} FROM r")
def _(spark, t):
    return E.accuracy(results(t), [])


@query("a03_confidence_bands", f"""WITH {RESULTS_SQL} SELECT model, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.25 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS n, avg(score) AS accuracy FROM r GROUP BY ALL""")
def _(spark, t):
    c = F.col("confidence")
    band = F.when(c.isNull(), "unknown").when(c >= 0.75, "high").when(c >= 0.25, "medium").otherwise("low")
    return results(t).groupBy("model", band.alias("band")).agg(F.count("*").alias("n"), F.avg("score").alias("accuracy"))


@query("a05_w01_running_accuracy", f"WITH {RESULTS_SQL} SELECT model, question_id, ord, price, avg(score) OVER (PARTITION BY model ORDER BY question_id, ord, price ROWS UNBOUNDED PRECEDING) AS running FROM r")
def _(spark, t):
    return E.running_accuracy(results(t), ["model"], ["question_id", "ord", "price"]).select("model", "question_id", "ord", "price", "running")


@query("a06_format_vote", rf"""WITH {ITEMS_SQL}, q AS (SELECT question FROM items UNION ALL SELECT text FROM conversations WHERE role = 'user'),
  m AS (SELECT regexp_matches(question, '(?i)(?:^|\n)\s*(?:[A-E]|[1-5])[.):]\s|\n\s*(?:Option|Choice|Answer)\s+[A-E][.:)]') AS mc FROM q)
  SELECT count(*) AS n, count(*) FILTER (mc) AS mc_count, CASE WHEN count(*) FILTER (mc) / count(*) > 0.6 THEN 'mc' ELSE 'qa' END AS format FROM m""")
def _(spark, t):
    q = items(t).select("question").union(t("conversations").where("role = 'user'").select("text"))
    m = R.is_multiple_choice(F.col("question"))
    return q.agg(F.count("*").alias("n"), F.count_if(m).alias("mc_count"), F.when(F.count_if(m) / F.count("*") > 0.6, "mc").otherwise("qa").alias("format"))


_TRI = "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE l_quantity > 25 END"


@query("a07_a09_graded_accuracy", f"SELECT l_returnflag AS grp, count(c) AS graded, count(*) FILTER (c) * 100.0::DOUBLE / count(c) AS graded_accuracy, avg(CASE WHEN coalesce(c, FALSE) THEN 100.0 ELSE 0.0 END) AS strict_accuracy FROM (SELECT l_returnflag, {_TRI} AS c FROM lineitem) GROUP BY 1")
def _(spark, t):
    d = t("lineitem").select(F.col("l_returnflag").alias("grp"), F.expr(_TRI).alias("c"))
    return d.groupBy("grp").agg(F.count("c").alias("graded"), (F.count_if("c") * 100.0 / F.count("c")).alias("graded_accuracy"), F.avg(F.when(F.coalesce("c", F.lit(False)), 100.0).otherwise(0.0)).alias("strict_accuracy"))


@query("a08_accuracy_by_confidence", "SELECT lower(o_orderpriority) AS level, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS accuracy FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high', '5-low') GROUP BY 1")
def _(spark, t):
    d = t("orders").withColumn("level", F.lower("o_orderpriority")).where(F.col("level").isin("1-urgent", "2-high", "5-low"))
    return d.groupBy("level").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("accuracy"))


@query("a10_method_truth_table", """WITH x AS (SELECT l_returnflag AS grp, l_quantity > 20 AS one, l_discount > 0.03 AS two, l_linenumber % 5 AS n1, l_partkey % 5 AS n2 FROM lineitem)
  SELECT grp, count(*) AS n, count(*) FILTER (one AND two) AS both_correct, count(*) FILTER (NOT one AND NOT two) AS both_incorrect, count(*) FILTER (one AND NOT two) AS only_one, count(*) FILTER (NOT one AND two) AS only_two,
  count(*) FILTER (NOT one AND NOT two AND n1 = n2) AS agree_but_wrong, (count(*) FILTER (one AND two) + count(*) FILTER (NOT one AND NOT two AND n1 = n2)) / count(*) AS agreement_rate FROM x GROUP BY grp""")
def _(spark, t):
    d = t("lineitem").selectExpr("l_returnflag AS grp", "l_quantity > 20 AS one", "l_discount > 0.03 AS two", "l_linenumber % 5 AS n1", "l_partkey % 5 AS n2")
    return E.truth_table(d, ["grp"], F.col("one"), F.col("two"), F.col("n1"), F.col("n2"))


@query("a11_j26_regressions", """SELECT l_returnflag AS grp, count(*) FILTER (a = b) AS matches, count(*) FILTER (a <> b) AS discrepancies, count(*) FILTER (a AND NOT b) AS regressions, count(*) FILTER (NOT a AND b) AS improvements, count(*) FILTER (b IS NULL) AS failures
  FROM (SELECT l_returnflag, l_quantity > 20 AS a, CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_discount > 0.03 END AS b FROM lineitem) GROUP BY 1""")
def _(spark, t):
    d = t("lineitem").selectExpr("l_returnflag AS grp", "l_quantity > 20 AS a", "CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_discount > 0.03 END AS b")
    a, b = F.col("a"), F.col("b")
    return d.groupBy("grp").agg(F.count_if(a == b).alias("matches"), F.count_if(a != b).alias("discrepancies"), F.count_if(a & ~b).alias("regressions"), F.count_if(~a & b).alias("improvements"), F.count_if(b.isNull()).alias("failures"))


@query("a14_disagreement", "SELECT o_orderkey, len(list_filter(list_distinct([a, b, c]), lambda x: x NOT IN ('unknown', 'not_available'))) > 1 AS disagree FROM (SELECT o_orderkey, (o_orderkey % 2)::VARCHAR AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE (o_orderkey % 4)::VARCHAR END AS b, CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE 'not_available' END AS c FROM orders)")
def _(spark, t):
    k = F.col("o_orderkey")
    votes = F.array((k % 2).cast("string"), F.when(k % 3 == 0, "unknown").otherwise((k % 4).cast("string")), F.when(k % 5 == 0, "1").otherwise("not_available"))
    return t("orders").select("o_orderkey", (F.size(F.array_except(F.array_distinct(votes), F.array(F.lit("unknown"), F.lit("not_available")))) > 1).alias("disagree"))


@query("a15_method_errors", "SELECT count(*) FILTER (a) AS method1, count(*) FILTER (b) AS method2, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only1, count(*) FILTER (b AND NOT a) AS only2, count(*) FILTER (a AND b) / greatest(least(count(*) FILTER (a), count(*) FILTER (b)), 1) AS agreement FROM (SELECT l_quantity > 40 AS a, l_discount > 0.07 AS b FROM lineitem)")
def _(spark, t):
    d = t("lineitem").selectExpr("l_quantity > 40 AS a", "l_discount > 0.07 AS b")
    a, b = F.col("a"), F.col("b")
    n = F.count_if
    return d.agg(n(a).alias("method1"), n(b).alias("method2"), n(a & b).alias("both"), n(a & ~b).alias("only1"), n(b & ~a).alias("only2"), (n(a & b) / F.greatest(F.least(n(a), n(b)), F.lit(1))).alias("agreement"))


@query("a16_fault_frequencies", "SELECT fault, severity, scope, grouping_id(fault, severity, scope) AS level, count(*) AS n FROM (SELECT p_type AS fault, p_brand AS severity, (p_size % 4)::VARCHAR AS scope FROM part) GROUP BY GROUPING SETS ((fault), (severity), (scope), ())")
def _(spark, t):
    t("part").selectExpr("p_type AS fault", "p_brand AS severity", "cast(p_size % 4 as string) AS scope").createOrReplaceTempView("faults_")
    return spark.sql("SELECT fault, severity, scope, grouping_id(fault, severity, scope) AS level, count(*) AS n FROM faults_ GROUP BY GROUPING SETS ((fault), (severity), (scope), ())")


@query("a17_most_common_fault", "SELECT p_brand, arg_max(p_type, n * 1000 - k) AS top, max(n) AS n, max(n) / sum(n)::DOUBLE AS share FROM (SELECT p_brand, p_type, count(*) AS n, dense_rank() OVER (ORDER BY p_type) AS k FROM part GROUP BY 1, 2) GROUP BY 1")
def _(spark, t):
    c = t("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "p_type"))
    return c.groupBy("p_brand").agg(best["p_type"].alias("top"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))


_FILES = "f AS (SELECT text, source AS file, doc_id AS ord FROM documents UNION ALL SELECT text, 'bench', 1000000 + item_id FROM benchmark)"
_H = r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))"


def _files(t):
    return t("documents").selectExpr("text", "source AS file", "doc_id AS ord").union(t("benchmark").selectExpr("text", "'bench'", "1000000 + item_id"))


@query("a18_u03_intersection", f"WITH {_FILES} SELECT {_H} AS h, count(*) AS occurrences, count(DISTINCT file) AS distinct_files, min(ord) AS first_ord FROM f GROUP BY 1 HAVING count(*) >= 2")
def _(spark, t):
    return E.intersection(_files(t), "text")


@query("a18_occurrence_distribution", f"WITH {_FILES} SELECT n AS occurrences, count(*) AS questions FROM (SELECT count(*) AS n FROM f GROUP BY {_H}) GROUP BY n")
def _(spark, t):
    return E.intersection(_files(t), "text", 1).groupBy("occurrences").agg(F.count("*").alias("questions"))


@query("a19_u02_union_distinct", f"WITH {_FILES} SELECT ord, file FROM f QUALIFY row_number() OVER (PARTITION BY {_H} ORDER BY ord) = 1")
def _(spark, t):
    return E.first_wins(_files(t), question_hash(F.col("text")), [F.col("ord")]).select("ord", "file")


@query("u01_union_all", f"WITH {_FILES} SELECT file, count(*) AS n FROM f GROUP BY file")
def _(spark, t):
    return _files(t).groupBy("file").agg(F.count("*").alias("n"))


@query("u04_except_processed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("a20_k05_benchmark_summary", f"""WITH {RESULTS_SQL} SELECT model, count(*) AS total, count(*) FILTER (NOT skipped) AS succeeded, count(*) FILTER (skipped) AS failed, min(price) AS least, max(price) AS most FROM r GROUP BY model""")
def _(spark, t):
    return results(t).groupBy("model").agg(F.count("*").alias("total"), F.count_if(~F.col("skipped")).alias("succeeded"), F.count_if("skipped").alias("failed"), F.min("price").alias("least"), F.max("price").alias("most"))


@query("a21_topic_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"))


_ROUTE = "CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'dropped' WHEN relevance < 6 THEN 'low_relevance' WHEN quality < 7 THEN 'low_quality' ELSE 'kept' END"
_GATE = f"g AS (SELECT doc_id, {_ROUTE} AS route FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 50 = 0 THEN '  ' ELSE text END AS text, d.doc_id * 7 % 10 + 1 AS relevance, l.quality * 5 + d.doc_id % 4 AS quality FROM documents d JOIN labels l USING (doc_id)))"


def _gated(t):
    d = t("documents").join(t("labels"), "doc_id")
    text = F.when(F.col("doc_id") % 50 == 0, "  ").otherwise(F.col("text"))
    return d.select("doc_id", E.route(F.col("doc_id") * 7 % 10 + 1, F.col("quality") * 5 + F.col("doc_id") % 4, text).alias("route"))


@query("p05_two_stage_gate", f"WITH {_GATE} SELECT * FROM g")
def _(spark, t):
    return _gated(t)


@query("a22_cleaning_stats", f"WITH {_GATE} SELECT route, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM g GROUP BY route")
def _(spark, t):
    c = _gated(t).groupBy("route").agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


@query("p06_score_gate", "SELECT doc_id, CASE WHEN doc_id % 10 + quality >= 7 THEN 'completed' ELSE 'low_score' END AS status FROM labels")
def _(spark, t):
    return t("labels").select("doc_id", E.status(F.col("doc_id") % 10 + F.col("quality")).alias("status"))


@query("p07_p09_incorrect_rows", f"WITH {RESULTS_SQL} SELECT question_id, model, ord, price FROM r WHERE NOT skipped AND {_INCORRECT}")
def _(spark, t):
    return results(t).where(~F.coalesce("skipped", F.lit(False)) & E.incorrect(F.col("format"), F.col("score"))).select("question_id", "model", "ord", "price")


_PRED = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || k || ' ' ELSE '2' END"
_OPT = r"coalesce(nullif(regexp_extract(c, '\(Option (\d+)\)', 1), ''), trim(c, ' '))"


@query("p11_p13_wrong_readings", rf"""WITH {ITEMS_SQL}, x AS (SELECT doc_id, {_PRED} AS p, option || ' (Option ' || k || ')' AS c FROM items)
  SELECT doc_id, coalesce(p <> '' AND trim(p, ' ') <> {_OPT}, FALSE) AS lenient, coalesce(p <> '' AND p <> c, FALSE) AS plain, p IS DISTINCT FROM c AS strict FROM x""")
def _(spark, t):
    k = F.col("k").cast("string")
    m = F.col("doc_id") % 4
    p = F.when(m == 0, F.lit(None)).when(m == 1, "").when(m == 2, F.concat(F.lit(" "), k, F.lit(" "))).otherwise("2")
    d = items(t).select("doc_id", p.alias("p"), F.concat("option", F.lit(" (Option "), k, F.lit(")")).alias("c"))
    p, c = F.col("p"), F.col("c")
    return d.select("doc_id", E.wrong(p, c).alias("lenient"), E.wrong(p, c, normalise=False).alias("plain"), E.wrong(p, c, missing_is_wrong=True).alias("strict"))


@query("p14_fault_routing", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(u, 'MCQA') THEN 'mcqa' WHEN contains(u, 'REASONING') OR contains(u, 'METHOD') OR contains(u, 'LOGIC') THEN 'reasoning' WHEN contains(u, 'KNOWLEDGE') THEN 'knowledge' ELSE 'other' END AS class FROM (SELECT upper(CASE o_orderkey % 6 WHEN 0 THEN 'mcqa flaw' WHEN 1 THEN 'Method error' WHEN 2 THEN 'logic gap' WHEN 3 THEN 'knowledge gap' WHEN 4 THEN 'mcqa knowledge' ELSE 'x' END) AS u FROM orders)) GROUP BY class")
def _(spark, t):
    fault = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'mcqa flaw' WHEN 1 THEN 'Method error' WHEN 2 THEN 'logic gap' WHEN 3 THEN 'knowledge gap' WHEN 4 THEN 'mcqa knowledge' ELSE 'x' END")
    return t("orders").groupBy(E.fault_class(fault).alias("class")).agg(F.count("*").alias("n"))


@query("p15_model_selection", f"WITH {RESULTS_SQL} SELECT model, count(*) AS n FROM r WHERE model IN ('m1', 'm3', 'm4') AND model NOT IN ('m3') GROUP BY model")
def _(spark, t):
    return results(t).where(F.col("model").isin("m1", "m3", "m4") & ~F.col("model").isin("m3")).groupBy("model").agg(F.count("*").alias("n"))


@query("p20_p21_length_filters", "SELECT doc_id FROM documents WHERE length(trim(text, ' ')) > 100 AND strlen(text) >= 500")
def _(spark, t):
    return t("documents").where((F.length(F.trim("text")) > 100) & (F.octet_length("text") >= 500)).select("doc_id")


@query("p23_key_prefix", "SELECT p_partkey FROM part WHERE NOT starts_with(upper(p_name), 'RED') AND NOT starts_with(upper(p_name), 'SMALL')")
def _(spark, t):
    u = F.upper("p_name")
    return t("part").where(~u.startswith("RED") & ~u.startswith("SMALL")).select("p_partkey")


@query("p29_error_breaker", "SELECT event_type, count(*) AS n, count(*) >= 200 AS tripped FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def _(spark, t):
    return t("events").where(F.col("event_type").isin("error", "signup")).groupBy("event_type").agg(F.count("*").alias("n"), (F.count("*") >= 200).alias("tripped"))


_LETTERS = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, CASE WHEN l_returnflag = 'N' THEN 'qa' ELSE 'mc' END AS format, 0.5::DOUBLE AS score,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE chr((65 + l_partkey % 3)::INT) END AS c, CASE WHEN l_linenumber = 2 THEN '' ELSE chr((65 + l_suppkey % 3)::INT) END AS m FROM lineitem)"""


@query("r15_score_repair", f"WITH {_LETTERS} SELECT l_orderkey, l_linenumber, l_partkey, price, CASE WHEN format = 'mc' AND c <> '' AND m <> '' THEN (c = m)::INT::DOUBLE ELSE score END AS repaired FROM x")
def _(spark, t):
    d = t("lineitem").withColumns({"format": F.expr("CASE WHEN l_returnflag = 'N' THEN 'qa' ELSE 'mc' END"), "c": F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.chr(65 + F.col("l_partkey") % 3)), "m": F.when(F.col("l_linenumber") == 2, "").otherwise(F.chr(65 + F.col("l_suppkey") % 3))})
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), R.repaired_score(F.col("format"), F.lit(0.5), F.col("c"), F.col("m")).alias("repaired"))


@query("a23_extension_rollup", r"""SELECT dir, ext, grouping_id(dir, ext) AS level, count(*) AS n FROM (SELECT split_part(url, '/', 4) AS dir, lower(regexp_extract(split_part(url, '?', 1), '[^/]*$', 0)) AS ext FROM pages) GROUP BY ROLLUP (dir, ext)""")
def _(spark, t):
    d = t("pages").select(F.split("url", "/")[3].alias("dir"), F.lower(F.regexp_extract(F.split("url", r"\?")[0], r"[^/]*$", 0)).alias("ext"))
    return d.rollup("dir", "ext").agg(F.grouping_id("dir", "ext").alias("level"), F.count("*").alias("n"))


@query("a24_validation_summary", "SELECT count(*) AS n, count(*) FILTER (strlen(html) > 0) AS valid, count(*) FILTER (strlen(html) > 2000) * 100.0::DOUBLE / count(*) AS pct_large, sum(strlen(html))::BIGINT AS total, avg(strlen(html)) AS mean FROM pages")
def _(spark, t):
    n = F.octet_length("html")
    return t("pages").agg(F.count("*").alias("n"), F.count_if(n > 0).alias("valid"), (F.count_if(n > 2000) * 100.0 / F.count("*")).alias("pct_large"), F.sum(n).alias("total"), F.avg(n).alias("mean"))


@query("v01_basic_checks", "SELECT page_id, CASE WHEN strlen(h) = 0 THEN 'empty' WHEN strlen(h) < 100 THEN 'too small' WHEN substr(h, 1, 5) <> '%PDF-' THEN 'bad header' ELSE 'ok' END AS verdict FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1' WHEN 2 THEN html ELSE '%PDF-' || html END AS h FROM pages)")
def _(spark, t):
    from scholia.sources.files import verdict

    h = F.expr("CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1' WHEN 2 THEN html ELSE concat('%PDF-', html) END")
    return t("pages").select("page_id", verdict(F.encode(h, "UTF-8")).alias("verdict"))


@query("a32_i01_status", """WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
  SELECT event_type AS status, count(*) AS n FROM l GROUP BY 1""")
def _(spark, t):
    from scholia.streaming.incremental import latest_status

    return latest_status(t("events"), "user_id", "event_type", ["ts", "event_id"]).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("a33_success_rate", "SELECT count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type IN ('purchase', 'click', 'error')), 1) AS rate FROM events")
def _(spark, t):
    return t("events").agg((F.count_if(F.col("event_type") == "purchase") / F.greatest(F.count_if(F.col("event_type").isin("purchase", "click", "error")), F.lit(1))).alias("rate"))


@query("a34_error_counters", "SELECT CASE WHEN event_type IN ('error', 'click') THEN event_type ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1")
def _(spark, t):
    return t("events").groupBy(F.when(F.col("event_type").isin("error", "click"), F.col("event_type")).otherwise("other").alias("category")).agg(F.count("*").alias("n"))


@query("i05_p26_resume", """WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
  SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM l WHERE event_type IN ('purchase', 'view'))""")
def _(spark, t):
    from scholia.streaming.incremental import latest_status, pending

    return pending(t("events").select("user_id").distinct(), latest_status(t("events"), "user_id", "event_type", ["ts", "event_id"]), "user_id", "event_type", ("purchase", "view"))


_SCORES = "[" + ", ".join(f"CASE WHEN p_size % {k + 2} = 0 THEN 0 ELSE (p_partkey * {k + 3} % 10 + 1) * {w}::DOUBLE END" for k, w in enumerate(E.CRITERIA.values())) + "]"


def _scored(t):
    pairs = [x for k, c in enumerate(E.CRITERIA) for x in (F.lit(c), F.when(F.col("p_size") % (k + 2) != 0, (F.col("p_partkey") * (k + 3) % 10 + 1).cast("double")))]
    return t("part").withColumn("scores", F.create_map(*pairs))


@query("a35_p22_t03_paper_scores", f"SELECT p_partkey, list_sum({_SCORES}) AS total FROM part WHERE list_sum({_SCORES}) >= 60")
def _(spark, t):
    return _scored(t).withColumn("total", E.weighted_total(F.col("scores"))).where("total >= 60").select("p_partkey", "total")


@query("t12_top_criteria")
def _(spark, t):
    entries = F.filter(F.map_entries("scores"), lambda e: e["value"].isNotNull())
    order = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return _scored(t).select("p_partkey", F.array_join(F.transform(F.slice(order, 1, 3), lambda e: e["k"]), ",").alias("top"))


@query("j01_match_scores", f"""WITH {QA_SQL}, q AS (SELECT conv_id * 100 + turn AS question_id, trim(substr(trim(question, ' '), 1, 100), ' ') AS print, length(answer) AS score, conv_id * 100 + turn AS ord FROM qa),
  tr AS (SELECT CASE WHEN question_id % 3 = 0 THEN -question_id ELSE question_id END AS question_id, print FROM q), s AS (SELECT * FROM q WHERE question_id % 5 <> 0),
  b AS (SELECT question_id, arg_max(score, ord) AS s1 FROM s GROUP BY 1), p AS (SELECT print, arg_max(score, ord) AS s2 FROM s GROUP BY 1)
  SELECT tr.question_id, coalesce(s1, s2) AS prior, CASE WHEN s1 IS NOT NULL THEN 'id' WHEN s2 IS NOT NULL THEN 'text' END AS match_method FROM tr LEFT JOIN b USING (question_id) LEFT JOIN p USING (print)""")
def _(spark, t):
    qid = F.col("conv_id") * 100 + F.col("turn")
    q = questions(t).select(qid.alias("question_id"), R.fingerprint(F.col("question")).alias("print"), F.length("answer").alias("score"), qid.alias("ord"))
    traces = q.select(F.when(F.col("question_id") % 3 == 0, -F.col("question_id")).otherwise(F.col("question_id")).alias("question_id"), "print")
    return E.match_scores(traces, q.where("question_id % 5 <> 0")).select("question_id", "prior", "match_method")


@query("j02_semi_incorrect", "SELECT d.doc_id, i.id FROM documents d JOIN (SELECT text, max(doc_id) AS id FROM documents WHERE doc_id % 3 = 0 GROUP BY text) i USING (text)")
def _(spark, t):
    inc = t("documents").where("doc_id % 3 = 0").groupBy("text").agg(F.max("doc_id").alias("id"))
    return t("documents").join(inc, "text").select("doc_id", "id")


@query("j03_inner_and_anti", "SELECT d.doc_id, l.quality IS NOT NULL AS has_stream FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, t):
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("has_stream"))


@query("j05_positional", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE doc_id % 2 = 0), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM benchmark) SELECT doc_id, item_id FROM a JOIN b USING (i)""")
def _(spark, t):
    from scholia.operators.positional import zip_by_order

    return zip_by_order(t("documents").where("doc_id % 2 = 0").select("doc_id"), t("benchmark").select("item_id"), "doc_id", "item_id")


@query("j07_chunks_of_files", "SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def _(spark, t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), ids.alias("ids"))


@query("t01_t02_benchmark_order", f"WITH {RESULTS_SQL}, s AS (SELECT model, avg(score) AS acc, count(*) FILTER (skipped) < 5 AS success FROM r GROUP BY model) SELECT model, row_number() OVER (ORDER BY success DESC, CASE WHEN coalesce(acc, 0) = 0 THEN -1 ELSE acc END DESC, model) AS place FROM s")
def _(spark, t):
    s = results(t).groupBy("model").agg(F.avg("score").alias("acc"), (F.count_if("skipped") < 5).alias("success"))
    acc = F.when(F.coalesce("acc", F.lit(0.0)) == 0, -1.0).otherwise(F.col("acc"))
    return s.select("model", F.row_number().over(Window.orderBy(F.desc("success"), acc.desc(), "model")).alias("place"))


@query("t04_most_common", "SELECT p_name, count(*) AS n, min(p_partkey) AS first_ord FROM part GROUP BY p_name ORDER BY n DESC, first_ord LIMIT 10")
def _(spark, t):
    return E.top_counts(t("part"), "p_name", "p_partkey", 10)


@query("t05_sample_by_hash")
def _(spark, t):
    return E.sample_by_hash(t("documents").select("doc_id"), "doc_id", 100)


@query("t10_t11_head_and_offset", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 10")
def _(spark, t):
    return t("documents").select("doc_id").orderBy("doc_id").offset(10).limit(50)


@query("t15_stratified", """WITH s AS (SELECT doc_id, 'correct_high' AS stratum, 2 AS k FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT doc_id, 'incorrect', 2 FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'low', 1 FROM labels WHERE toxic = 1)
  SELECT stratum, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR), doc_id) <= k""")
def _(spark, t):
    parts = (("correct_high", "quality = 1 and toxic = 0", 2), ("incorrect", "quality = 0", 2), ("low", "toxic = 1", 1))
    out = None
    for name, rule, k in parts:
        # top-k by hash: bounded heaps in every task, no window over a stratum
        top = t("labels").where(rule).select(F.lit(name).alias("stratum"), "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(k)
        out = top if out is None else out.union(top)
    return out


@query("t16_sample_per_directory", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) <= 20")
def _(spark, t):
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return t("documents").select("source", "doc_id", F.row_number().over(w).alias("k")).where("k <= 20").drop("k")


@query("t17_cap_per_keyword", "SELECT user_id, event_id FROM (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) WHERE b < 3")
def _(spark, t):
    return E.capped(t("events"), "user_id", ["event_id"], F.col("event_type") == "purchase", 3).select("user_id", "event_id")


@query("w07_weighted_moving_average", "SELECT user_id, event_id, list_sum(list_transform(v, lambda x, i: x * i)) / (len(v) * (len(v) + 1) / 2) AS wma FROM (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v FROM events)")
def _(spark, t):
    v = F.collect_list("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0))
    weighted = F.aggregate(F.transform(F.col("v"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    d = t("events").withColumn("v", v)
    return d.select("user_id", "event_id", (weighted / (F.size("v") * (F.size("v") + 1) / 2)).alias("wma"))


@query("w11_average_rank", "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank FROM lineitem")
def _(spark, t):
    from scholia.operators.stats import average_rank

    return average_rank(t("lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), "avg_rank")


@query("k23_w12_conflict_names", "SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def _(spark, t):
    from scholia.sources.sinks import conflict_names

    return conflict_names(t("part"), "p_name", "p_partkey").select("p_partkey", "name")


@query("k27_page_split", "SELECT page_id, least(i // (n // 7), 6)::BIGINT AS part FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM pages)")
def _(spark, t):
    from scholia.operators.positional import split_parts

    return split_parts(t("pages").select("page_id"), "page_id", 7)


@query("s14_s17_envelopes", f"WITH {RESULTS_SQL} SELECT model, count(*) AS n, count(*) FILTER (NOT skipped) AS kept, avg(score) AS accuracy FROM r GROUP BY model")
def _(spark, t):
    from scholia.sources.sinks import envelope
    from scholia.sources.files import read_envelopes

    # a round trip: results to a JSON envelope a model, or parts of one, and back to rows
    env = envelope(results(t), "model", {"kind": F.lit("results")})
    rows = read_envelopes(env.select(F.col("json").alias("value")), "model string, score double, skipped boolean")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(~F.col("skipped")).alias("kept"), F.avg("score").alias("accuracy"))


@query("n01_n03_grade_parsing", r"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE o_orderkey % 2 = 0 END AS correct, CASE o_orderkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.2 ELSE 0.5 END::DOUBLE AS confidence FROM orders""")
def _(spark, t):
    from scholia.functions.jsonx import grade

    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.lit('```json\n{"is_correct": true, "confidence": 0.9}\n```')).when(k % 3 == 1, F.lit('{"is_correct": false, "confidence": 0.2}')).otherwise(F.concat(F.lit('broken "is_correct": '), (k % 2 == 0).cast("string"), F.lit(" {")))
    g = grade(raw)
    return t("orders").select("o_orderkey", g["is_correct"].alias("correct"), g["confidence"].alias("confidence"))


@query("n09_map_explode", "SELECT user_id, k AS name, n FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2)")
def _(spark, t):
    c = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("files"))
    return m.select("user_id", F.explode("files").alias("name", "n"))
