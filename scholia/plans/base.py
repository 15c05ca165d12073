"""The driver's tables and the views that stand in for question sets, answers and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has, for costly expressions over a table whose files are few and small; a given
    number is not merged again by the sizes of what is dealt."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def query(name: str, sql: str | None = None):
    """Register a query (spark, table getter) with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return f

    return register


#: Results of a run: one row per (question, model); columns as text, read alike by both engines.
RESULTS = (
    "l_orderkey * 10 + l_linenumber AS question_id",
    "concat('m', CAST(l_suppkey % 5 AS STRING)) AS model",
    "CASE WHEN l_returnflag = 'N' THEN 'qa' ELSE 'mc' END AS format",
    "CASE WHEN l_returnflag = 'N' THEN (l_linenumber % 5) / 4.0D ELSE CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE 1.0 END END AS score",
    "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE (l_linenumber % 9) / 8.0D END AS confidence",
    "l_linestatus = 'O' AND l_linenumber = 7 AS skipped",
    "l_partkey AS ord",
    "l_extendedprice AS price",
)


def results(t) -> DataFrame:
    return t("lineitem").selectExpr(*RESULTS)


RESULTS_SQL = "r AS (SELECT " + ", ".join(RESULTS).replace("AS STRING", "AS VARCHAR").replace("4.0D", "4.0::DOUBLE").replace("8.0D", "8.0::DOUBLE").replace("0.0 ELSE 1.0", "0.0::DOUBLE ELSE 1.0::DOUBLE") + " FROM lineitem)"

#: Questions and answers: a user's turn and the assistant's turn after it.
QA_SQL = """qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def questions(t) -> DataFrame:
    from pyspark.sql import functions as F

    c = t("conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


#: Multiple-choice items made of a document's words: a stem, five options, one marked, an answer.
def items(t) -> DataFrame:
    from pyspark.sql import functions as F

    w = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")
    d = t("documents").withColumn("w", w).where(F.size("w") >= 12)
    k = (F.col("doc_id") % 5 + 1).cast("int")
    lines = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(i.cast("string"), F.lit(") "), F.get("w", i), F.when(i == k, " (*)").otherwise("")))
    question = F.concat(F.lit("What is "), F.get("w", F.lit(0)), F.lit("?\n\n"), F.array_join(lines, "\n"))
    answer = F.concat(F.lit("The correct answer is "), k.cast("string"), F.lit(") "), F.get("w", k), F.lit("."))
    return d.select("doc_id", question.alias("question"), answer.alias("answer"), k.alias("k"), F.get("w", k).alias("option"))


ITEMS_SQL = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT doc_id, 'What is ' || w[1] || '?' || chr(10) || chr(10) || array_to_string(list_transform(range(1, 6),
    lambda i: i::VARCHAR || ') ' || w[i + 1] || CASE WHEN i = doc_id % 5 + 1 THEN ' (*)' ELSE '' END), chr(10)) AS question,
  'The correct answer is ' || (doc_id % 5 + 1)::VARCHAR || ') ' || w[doc_id % 5 + 2] || '.' AS answer,
  (doc_id % 5 + 1)::INT AS k, w[doc_id % 5 + 2] AS option FROM w WHERE len(w) >= 12)"""
