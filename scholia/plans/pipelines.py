"""The reference's work flows as plans (O*, §3): generation, scoring, analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions import choices as R
from scholia.functions import text as X
from scholia.operators import evaluation as E
from scholia.plans import providers as G
from scholia.sources.tables import written


MOST_MODELS = 1000


def generate_items(docs: DataFrame, done: DataFrame, responses: DataFrame, provider: G.Provider, size: int = 500, least: int = 7) -> DataFrame:
    """Chunks not yet done, relevance gate, item, status. Filters stand before every call."""
    chunks = X.chunks(docs.select("doc_id", "text"), size=size).withColumn("chunk_id", X.chunk_id(F.col("doc_id"), F.col("chunk_index")))
    chunks = chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")
    rated, _ = G.respond(chunks.select("chunk_id", "chunk", G.relevance_prompt(F.col("chunk")).alias("prompt")), responses, provider)
    kept = rated.withColumn("r", G.relevance(F.col("response"))).where("r.is_relevant").select("chunk_id", "chunk")
    made, _ = G.respond(kept.select("chunk_id", G.question_prompt(F.col("chunk"), "multiple-choice").alias("prompt")), responses, provider)
    score = X.score_field(F.coalesce("response", F.lit("")), r"(?m)^SCORE", 0)
    return made.select("chunk_id", "response", score.alias("score"), E.status(score, least).alias("status"))


def score_answers(questions: DataFrame, models: DataFrame, responses: DataFrame, provider: G.Provider) -> DataFrame:
    """Every model answers every question, and is graded. Models are a run's setting, so their names are
    read by the driver, MOST_MODELS at most."""
    names = [r["model"] for r in models.select("model").limit(MOST_MODELS + 1).collect()]
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    asked = questions.withColumn("model", F.explode(F.array(*(F.lit(x) for x in names)).cast("array<string>"))).withColumn("prompt", F.concat(F.lit("MODEL "), "model", F.lit("\n"), G.answer_prompt(F.col("question"))))
    answered, _ = G.respond(asked, responses, provider)
    answered = answered.withColumnRenamed("response", "model_answer").drop("prompt", "prompt_hash")
    to_grade = answered.withColumn("prompt", G.grade_prompt(F.col("question"), F.col("answer"), F.coalesce("model_answer", F.lit(""))))
    done, _ = G.respond(to_grade, responses, provider)
    g = G.graded(F.col("response"))
    out = done.withColumn("g", g).withColumns({"score": F.col("g.is_correct").cast("double"), "confidence": F.col("g.confidence"), "format": F.when(R.is_multiple_choice(F.col("question")), "mc").otherwise("qa"), "skipped": F.col("model_answer").isNull()})
    return out.drop("g", "prompt", "prompt_hash", "response")


def benchmark(scored: DataFrame) -> DataFrame:
    """Accuracy by model, best first; models without rows last."""
    return E.accuracy(scored, ["model"]).orderBy(F.desc_nulls_last("accuracy"), "model")


def full_trace(questions: DataFrame, responses: DataFrame, provider: G.Provider) -> DataFrame:
    """Both methods on every question (doc_id, question, answer), graded: thoughts on each option and their
    synthesis, and a direct prediction; then a comparison, and a fault analysis of what is wrong. Each step is written, since
    the calls of the next read it twice and would make all steps before it anew each time."""
    questions = written(questions, "questions")
    options = questions.select("doc_id", "question", F.posexplode(R.line_options(F.col("question"))).alias("k", "option"))
    asked = options.withColumn("prompt", G.call_prompt("G10", option=F.col("option"), question=F.col("question")))
    thought, new = G.respond(asked, responses, provider)
    thoughts = thought.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", G.CALLS["G10"][1](F.col("response"))["analysis"].alias("a")))), lambda x: x["a"]), "\n").alias("thoughts"))
    one = questions.join(written(thoughts, "thoughts"), "doc_id", "left").withColumn("prompt", G.call_prompt("G22", thoughts=F.col("thoughts")))
    first, _ = G.respond(one, responses, provider)
    first = written(first.select("doc_id", "question", "answer", G.predicted(F.col("response")).alias("one")), "first")
    second, _ = G.respond(first.withColumn("prompt", G.answer_prompt(F.col("question"))), responses, provider)
    both = written(second.select("doc_id", "question", "answer", "one", G.predicted(F.col("response")).alias("two")), "both")
    marked = both.withColumn("right", R.correct_option(F.col("question")).cast("string"))
    verdict = marked.withColumns({"one_correct": F.col("one.predicted") == F.col("right"), "two_correct": F.col("two.predicted") == F.col("right")})
    compared, _ = G.respond(verdict.withColumn("prompt", G.call_prompt("G13", one=F.col("one.predicted"), two=F.col("two.predicted"))), responses, provider)
    told = written(compared.withColumn("comparison", G.CALLS["G13"][1](F.col("response"))).drop("prompt", "prompt_hash", "response"), "told")
    wrong, _ = G.respond(told.where("not one_correct").withColumn("prompt", G.call_prompt("G16", question=F.col("question"), trace=F.col("comparison"))), responses, provider)
    faults = wrong.select("doc_id", G.CALLS["G16"][1](F.col("response")).alias("fault"))
    return told.join(faults, "doc_id", "left")


def structured_papers(papers: DataFrame, sections: tuple[str, ...], phrases: tuple[str, ...], responses: DataFrame, provider: G.Provider) -> DataFrame:
    """Each section of each paper (doc_id, text); a section that holds a fallback phrase or is missing is
    written from the text in a second call, and noted."""
    from scholia.functions import jsonx as N

    asked = papers.withColumn("section", F.explode(F.array(*(F.lit(x) for x in sections))))
    asked = asked.withColumn("prompt", G.call_prompt("G27", section=F.col("section"), text=F.col("text")))
    got, _ = G.respond(asked, responses, provider)
    got = got.withColumn("content", G.CALLS["G27"][1](F.col("response"))).drop("prompt", "prompt_hash", "response")
    bad = F.col("content").isNull() | N.needs_synthesis(F.struct("content"), phrases)
    again, _ = G.respond(got.where(bad).withColumn("prompt", G.call_prompt("G28", section=F.col("section"), text=F.col("text"))), responses, provider)
    made = again.select("doc_id", "section", G.CALLS["G28"][1](F.col("response")).alias("content"), F.lit("synthesised").alias("note"))
    return got.where(~bad).select("doc_id", "section", "content", F.lit(None).cast("string").alias("note")).union(made)


def reasoning_suite(structures: DataFrame, group: str) -> dict[str, DataFrame]:
    """Analysis, plot tables and comparison of reasoning structures (group, text) in one go."""
    from scholia.functions import reasoning as C
    from scholia.sources import sinks

    s = structures.select(group, C.structure(F.col("text")).alias("s"))
    feats = s.select(group, *(c.alias(k) for k, c in C.features(F.col("s")).items()))
    steps = s.select(group, F.explode("s.flow").alias("step")).groupBy(group, "step").agg(F.count("*").alias("n"))
    return {"features": feats, "flow": steps, "plot": sinks.plot_table(s.select(F.explode("s.uncertainty.position").alias("position")), "position", 0.0, 1.0, 20)}


def incorrect_logic(faults: DataFrame, streams: DataFrame) -> DataFrame:
    """Clauses of the streams (doc, text) of wrong answers (doc, prediction, correct), for J10-J20."""
    from scholia.operators import clauses as L

    wrong = faults.where(E.wrong(F.col("prediction"), F.col("correct"))).select("doc")
    return L.clauses(streams.join(wrong, "doc", "left_semi"), "doc", "text")
