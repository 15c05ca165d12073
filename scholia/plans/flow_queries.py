"""Queries of cluster flows, order statistics, keyed state and limited calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import clusters as L
from scholia.operators import stats as S
from scholia.operators import vectors as V
from scholia.plans import providers
from scholia.plans.base import query
from scholia.plans.wider_queries import _folder
from scholia.streaming import incremental as I


def plane(t) -> DataFrame:
    """Places of the embeddings: their first two numbers."""
    return t("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("m10_density_sweep")
def _(spark, t):
    told, _ = L.spatial_clusters(plane(t), "vec_id", "x", "y")
    return told.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


#: Labels that the stand-in for a model gives, by a checksum of the cluster's name and the kind of call.
LABELS = ("dna repair pathway", "Mixed Research Topic", "Label: protein kinase signaling", "general words")


def by_checksum(members: DataFrame, kind: str) -> DataFrame:
    k = (F.crc32(F.concat("cluster", F.lit(":" + kind))) % len(LABELS)).cast("int")
    return members.select("cluster").distinct().withColumn("label", F.get(F.array(*map(F.lit, LABELS)), k))


def part_clusters(t) -> tuple[DataFrame, DataFrame]:
    p = t("part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("c"), (F.col("p_size") % 7).cast("string")).alias("cluster"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    label = F.when(F.col("cluster").endswith("0"), "dna repair pathway").otherwise("Mixed Research Topic")
    return p, p.select("cluster").distinct().withColumn("label", label)


@query("l01_l06_refined_clusters")
def _(spark, t):
    told, _ = L.refined_clusters(*part_clusters(t), by_checksum)
    return told.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


def near_groups(t, k: int = 5) -> DataFrame:
    e = t("embeddings")
    return V.top_neighbours(e, e, "vec_id", "embedding", k).select(F.col("src").alias("doc"), F.col("dst").alias("near"))


@query("u07_l07_centres")
def _(spark, t):
    groups = L.written(near_groups(t), "groups")
    centres = L.disjoint_centres(groups, F.crc32(F.col("doc").cast("string")), 5)
    return L.assigned(t("embeddings").select(F.col("vec_id").alias("doc")), groups, centres)


@query("a26_quantiles", "SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS mid, quantile_cont(l_extendedprice, 0.9) AS q9 FROM lineitem GROUP BY 1, 2")
def _(spark, t):
    return S.quantiles(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"q1": 0.25, "mid": 0.5, "q9": 0.9})


@query("i01_keyed_work", """WITH e AS (SELECT user_id::VARCHAR AS k, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'extracted' END AS status FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, status) AS i FROM e),
d AS (SELECT k, min(i) AS i FROM o WHERE status = 'completed' GROUP BY k),
f AS (SELECT o.*, row_number() OVER (PARTITION BY o.k ORDER BY o.i) AS nth FROM o LEFT JOIN d USING (k) WHERE status = 'error' AND (d.i IS NULL OR o.i < d.i))
SELECT k, 'start' AS action, 0 AS failures FROM o WHERE i = 1
UNION ALL SELECT d.k, 'done', (SELECT count(*) FROM f WHERE f.k = d.k)::INT FROM d
UNION ALL SELECT k, 'give_up', 3 FROM f WHERE nth = 3""")
def _(spark, t):
    source, path, checkpoint = (_folder(spark, x) for x in ("in", "out", "offsets"))
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("extracted")
    e = t("events").select(F.col("user_id").cast("string").alias("k"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    for _ in range(2):  # the second run takes up where the first ended and repeats nothing
        I.run_once(I.keyed_work(stream, "k", "ts", "status", "10 minutes", 3, "1 hour"), path, checkpoint)
    return spark.read.parquet(path).where("action <> 'retry'").select("k", "action", "failures")


@query("o05_limited_scores")
def _(spark, t):
    none = spark.createDataFrame([], "prompt_hash string, response string")
    asked = t("benchmark").select("item_id", providers.relevance_prompt(F.col("text")).alias("prompt"))
    got, _ = providers.respond(asked, none, providers.stub, limit=providers.Limit(2000.0, 8))
    return got.select("item_id", providers.relevance(F.col("response"))["score"].alias("score"))


def _errors(t) -> DataFrame:
    """Wrong answers: which of two methods failed, from the numbers of a part."""
    k = F.col("p_partkey")
    reason = F.when(k % 3 == 0, "method1").when(k % 3 == 1, "method2").otherwise("method1, method2")
    return t("part").select(F.concat(F.lit("q"), F.lpad(k.cast("string"), 8, "0")).alias("base_name"), reason.alias("reason"), (k % 5).cast("string").alias("correct"), (k % 4).cast("string").alias("one"), (k % 7).cast("string").alias("two"))


def _share_sql(n: str, total: str) -> str:
    return f"printf('%.1f', CASE WHEN {total} = 0 THEN 0 ELSE {n} * 100.0 / {total} END::DOUBLE) || '%'"


_ERROR_SQL = f"""WITH e AS (SELECT 'q' || lpad(p_partkey::VARCHAR, 8, '0') AS b, p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'method1' WHEN 1 THEN 'method2' ELSE 'method1, method2' END AS reason FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY b) AS i, CASE reason WHEN 'method1' THEN 0 WHEN 'method2' THEN 1 ELSE 2 END AS g FROM e),
n AS (SELECT count(*) AS n, count(*) FILTER (g IN (0, 2)) AS n1, count(*) FILTER (g IN (1, 2)) AS n2, count(*) FILTER (g = 2) AS nb FROM r),
lists AS (SELECT g, count(*) AS m, unnest([0, 1, 2]) AS part FROM r GROUP BY g)
SELECT 0 AS section, unnest(generate_series(0, 11))::BIGINT AS i, 0 AS j, unnest(['INCORRECT ANSWERS ANALYSIS REPORT', repeat('=', 80), '', 'SUMMARY STATISTICS:', repeat('-', 40), 'Total Questions with Errors: ' || n, 'Method 1 Errors: ' || n1, 'Method 2 Errors: ' || n2, 'Both Methods Error: ' || nb, 'Method 1 Only Errors: ' || (n1 - nb), 'Method 2 Only Errors: ' || (n2 - nb), '']) AS value FROM n
UNION ALL SELECT 1, unnest([0, 1]), 0, unnest(['ERROR BREAKDOWN BY QUESTION:', repeat('-', 40)])
UNION ALL SELECT 1, i + 999, unnest(generate_series(0, 5))::INT, unnest([lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, ' ') || '. ' || b, '     Error Type: ' || reason, '     Correct Answer: ' || (k % 5), '     Method 1 Predicted: ' || (k % 4), '     Method 2 Predicted: ' || (k % 7), '']) FROM r
UNION ALL SELECT 2, unnest([0, 1]), 0, unnest(['ERROR PATTERNS:', repeat('-', 40)])
UNION ALL SELECT 3 + 3 * g, 0, 0, CASE g WHEN 0 THEN 'Method 1 Only Errors' WHEN 1 THEN 'Method 2 Only Errors' ELSE 'Both Methods Error' END || ' (' || m || '):' FROM lists WHERE part = 0
UNION ALL SELECT 4 + 3 * g, 0, 0, '  - ' || b FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY b) AS w FROM r) WHERE w <= 10
UNION ALL SELECT 5 + 3 * g, 0, 0, '  ... and ' || (m - 10) || ' more' FROM lists WHERE part = 0 AND m > 10
UNION ALL SELECT 5 + 3 * g, 1, 0, '' FROM lists WHERE part = 0
UNION ALL SELECT 12, unnest(generate_series(0, 6))::BIGINT, 0, unnest(['BASIC INSIGHTS:', repeat('-', 40), '• Method 1 Error Rate: ' || {_share_sql("n1", "n")}, '• Method 2 Error Rate: ' || {_share_sql("n2", "n")}, '• Agreement in Errors: ' || {_share_sql("nb", "n")},
  CASE WHEN n1 > n2 THEN '• Method 1 appears more error-prone than Method 2' WHEN n2 > n1 THEN '• Method 2 appears more error-prone than Method 1' ELSE '• Both methods have similar error rates' END, '• Error Agreement Rate: ' || {_share_sql("nb", "least(n1, n2)")} || ' (when errors occur)']) FROM n"""


@query("k18_error_report", _ERROR_SQL)
def _(spark, t):
    from scholia.sources.reports import error_report

    return error_report(_errors(t))


@query("k21_extraction_text", "SELECT 0 AS section, row_number() OVER (ORDER BY '/x/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt') - 1 AS i, 0 AS j, '# ' || lpad(doc_id::VARCHAR, 9, '0') || '.txt' || chr(10) || chr(10) || trim(coalesce(text, ''), ' ') AS value FROM documents")
def _(spark, t):
    from scholia.sources.reports import extraction_text

    path = F.concat(F.lit("/x/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))
    return extraction_text(t("documents").select(path.alias("path"), "text"))
