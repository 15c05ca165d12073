"""Evaluation core: gates, score repair, accuracy rollups, set operations over questions (P*, A*, R15, U*, J01-J09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import question_hash
from scholia.operators.positional import running_sums

# Criteria of paper scores and their weights.
CRITERIA = {
    "scientific_significance": 2.5,
    "novel_mechanisms": 2.0,
    "unexpected_outcomes": 1.8,
    "theoretical_breakthrough": 1.6,
    "methodological_innovation": 1.4,
    "cross_disciplinary_impact": 1.3,
    "paradigm_shift_potential": 1.5,
    "experimental_elegance": 1.1,
    "intellectual_depth": 1.2,
    "transformative_potential": 1.4,
}


def route(relevance: Column, quality: Column, text: Column, min_relevance: int = 6, min_quality: int = 7) -> Column:
    """Dropped, low_relevance, low_quality or kept."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "dropped").when(relevance < min_relevance, "low_relevance").when(quality < min_quality, "low_quality").otherwise("kept")


def status(score: Column, least: int = 7) -> Column:
    """P06."""
    return F.when(score >= least, "completed").otherwise("low_score")


def incorrect(fmt: Column, score: Column) -> Column:
    """Multiple choice below 1, free answers below 0.5."""
    return F.when(fmt == "mc", score < 1).otherwise(score < 0.5)


def wrong(prediction: Column, correct: Column, missing_is_wrong: bool = False, normalise: bool = True) -> Column:
    """Three readings of a wrong prediction."""
    from scholia.functions.text import option_number

    if missing_is_wrong:
        return ~prediction.eqNullSafe(correct)
    there = prediction.isNotNull() & (prediction != "")
    differs = F.trim(prediction) != option_number(correct) if normalise else prediction != correct
    return F.coalesce(there & differs, F.lit(False))


def fault_class(fault: Column) -> Column:
    """Ordered tests on the upper-case fault."""
    u = F.upper(fault)
    reasoning = u.contains("REASONING") | u.contains("METHOD") | u.contains("LOGIC")
    return F.when(u.contains("MCQA"), "mcqa").when(reasoning, "reasoning").when(u.contains("KNOWLEDGE"), "knowledge").otherwise("other")


def accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts, accuracies by format (null without rows) and mean confidence (missing counts as 0) of valid rows."""
    valid = ~F.coalesce(F.col("skipped"), F.lit(False))
    mc, qa = valid & (F.col("format") == "mc"), valid & (F.col("format") == "qa")
    bad = valid & incorrect(F.col("format"), F.col("score"))
    return results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(valid).alias("processed"),
        F.count_if(mc).alias("mc_count"),
        F.count_if(qa).alias("qa_count"),
        F.avg(F.when(valid, F.col("score"))).alias("accuracy"),
        F.avg(F.when(mc, F.col("score"))).alias("mc_accuracy"),
        F.avg(F.when(qa, F.col("score"))).alias("qa_accuracy"),
        F.avg(F.when(mc, F.coalesce("confidence", F.lit(0.0)))).alias("mc_confidence"),
        F.count_if(bad).alias("incorrect"),
        (F.count_if(bad) / F.greatest(F.count_if(valid), F.lit(1))).alias("incorrect_rate"),
    )


def running_accuracy(results: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Mean score of a run's rows so far."""
    sums = running_sums(results, by, order, {"sum_": F.coalesce("score", F.lit(0.0)), "n_": F.col("score").isNotNull().cast("long")})
    return sums.withColumn("running", F.col("sum_") / F.nullif(F.col("n_"), F.lit(0))).drop("sum_", "n_")


def first_wins(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key (in ascending order of some columns): a minimum with partial sums, so that a key
    with many rows is no hot group."""
    first = F.min(F.struct(*(o.alias(f"o{k}_") for k, o in enumerate(order)), F.struct(*df.columns).alias("row_")))
    return df.groupBy(key.alias("key_")).agg(first.alias("first_")).select("first_.row_.*")


def intersection(rows: DataFrame, question: str, least: int = 2) -> DataFrame:
    """Questions that occur in at least `least` rows of all files, with occurrences and distinct files."""
    hashed = rows.withColumn("h", question_hash(F.col(question)))
    return hashed.groupBy("h").agg(F.count("*").alias("occurrences"), F.count_distinct("file").alias("distinct_files"), F.min("ord").alias("first_ord")).where(F.col("occurrences") >= least)


def weighted_total(scores: Column, weights: dict[str, float] = CRITERIA) -> Column:
    """Sum of raw score times weight; a missing criterion counts as 0."""
    return sum((F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))


def truth_table(df: DataFrame, by: list[str], one: Column, two: Column, n1: Column, n2: Column) -> DataFrame:
    """How two methods agree; n1 and n2 are the numbers they answered."""
    both = one & two
    neither = ~one & ~two
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(both).alias("both_correct"),
        F.count_if(neither).alias("both_incorrect"),
        F.count_if(one & ~two).alias("only_one"),
        F.count_if(~one & two).alias("only_two"),
        F.count_if(neither & (n1 == n2)).alias("agree_but_wrong"),
        ((F.count_if(both) + F.count_if(neither & (n1 == n2))) / F.count("*")).alias("agreement_rate"),
    )


def match_scores(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """Prior score by question_id, else by fingerprint; of equal keys the last row wins. Adds match_method."""
    last = lambda key: scores.groupBy(key).agg(F.max_by("score", "ord").alias(f"score_{key}"))
    out = traces.join(last("question_id"), "question_id", "left").join(last("print"), "print", "left")
    method = F.when(F.col("score_question_id").isNotNull(), "id").when(F.col("score_print").isNotNull(), "text")
    return out.withColumns({"prior": F.coalesce("score_question_id", "score_print"), "match_method": method}).drop("score_question_id", "score_print")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows in the order of a hash of their key: seeded, distributed and repeatable."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """T08."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def top_counts(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The k most common values; ties in order of first appearance."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_ord")).orderBy(F.desc("n"), "first_ord").limit(k)


def capped(df: DataFrame, by: str, order: list[str], accepted: Column, most: int) -> DataFrame:
    """Rows of each key until `most` have been accepted."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before_", F.coalesce(F.sum(accepted.cast("int")).over(w), F.lit(0))).where(F.col("before_") < most).drop("before_")


def reference_answers(rows: DataFrame) -> DataFrame:
    """Question and answer (the reference answer) of rows that have both."""
    return rows.select(*(c for c in rows.columns if c not in ("answer", "reference_answer")), F.col("reference_answer").alias("answer")).where("question <> '' and answer <> ''")


def stratum(correct: Column, confidence: Column) -> Column:
    """Strata of a sample: correct with high confidence, not correct, low confidence; an array, as they overlap."""
    strata = F.array(F.when(correct & (confidence == "high"), "correct_high"), F.when(~F.coalesce(correct, F.lit(False)), "incorrect"), F.when(confidence == "low", "low"))
    return F.array_compact(strata)


def kept_and_filtered(rows: DataFrame, route: Column) -> tuple[DataFrame, DataFrame]:
    """The two sides of a gate."""
    routed = rows.withColumn("reason", route)
    return routed.where("reason = 'kept'").drop("reason"), routed.where("reason <> 'kept'")


def batch_summaries(traces: DataFrame, order: str, size: int) -> DataFrame:
    """Per batch of `size` rows in order of a number from 0: counts, graded counts, correct ones, and by confidence."""
    graded = F.col("correct").isNotNull()
    cells = [F.count_if(graded & (F.col("confidence") == c)).alias(f"{c}_graded") for c in ("high", "medium", "low")]
    cells += [F.count_if(F.col("correct") & (F.col("confidence") == c)).alias(f"{c}_correct") for c in ("high", "medium", "low")]
    return traces.groupBy(F.floor(F.col(order) / size).alias("batch")).agg(F.count("*").alias("n"), F.count_if(graded).alias("graded"), F.count_if(F.col("correct")).alias("correct"), *cells)


def merged_summaries(batches: DataFrame) -> DataFrame:
    """The whole run from its batches: sums, and accuracies (null where nothing is graded)."""
    sums = batches.agg(F.count("*").alias("batches"), *(F.sum(c).alias(c) for c in batches.columns if c != "batch"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.withColumns({"accuracy": share("correct", "graded"), **{f"{c}_accuracy": share(f"{c}_correct", f"{c}_graded") for c in ("high", "medium", "low")}})
