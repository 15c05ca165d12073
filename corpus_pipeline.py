"""The corpus pipeline: language, near duplicates, repeated passages, mixture, sequences. Counted as part of scholia.llm.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of ``documents``; between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import language_id, minhash_dedup, mixing, packing, suffix_dedup
from scholia.llm.queries import WEIGHTS
from scholia.llm.scratch import Scratch


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages the table itself teaches: with letters, and told shorter by some language's contexts
    than without any."""
    return language_id.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id, and
    one of its rows where a text stands there twice under one doc_id. Rows without doc_id can't be named and stay."""
    gone = minhash_dedup.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti")
    th, n = _free(docs, "th_"), _free(docs, "n_")
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(th)
    twice = Scratch(spark, "rows").keep(out.where("doc_id is not null").select("doc_id", hashed).groupBy("doc_id", th).agg(F.count("*").alias(n)).where(F.col(n) > 1))
    if twice.limit(1).count():
        keyed = out.withColumn(th, hashed)
        again = keyed.join(twice.select("doc_id", th), ["doc_id", th], "left_semi").dropDuplicates(["doc_id", th])
        out = keyed.join(twice.select("doc_id", th), ["doc_id", th], "left_anti").unionByName(again)
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat: 400 bytes, or 50 words that stand in another document unless the rest does too.
    A document of which nothing but white space is left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # the other columns travel as one, so that none of their names meets the operator's
    out = suffix_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(*rest).alias("rest")), words=suffix_dedup.WORDS)
    whole = (F.col("n_removed") == 0) & (F.col("n_passages") == 0)
    out = out.where(whole | F.col("clear_text").rlike(r"[^\x20\x09-\x0D]"))
    told = {c: F.col("rest").getField(c) for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("clear_text")}
    told["n_chars"] = F.when(whole, told["n_chars"]).otherwise(F.length("clear_text"))
    return out.select(*(told[c].alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of WEIGHTS: each as often as its rate, rounded by its own hash, says; none, once or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = _free(docs, "copies_")
    copies = mixing.mix(docs, labels, WEIGHTS).where("copies <> 1 and doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias(name))
    # a document without a row there stays once; so do those without doc_id
    out = docs.join(copies, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(1)))
    out = out.where(F.col(name) > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name))))
    return out.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("sequences", sequences)]

#: SQL cannot express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = s.sweep(s.keep(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
