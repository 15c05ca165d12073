"""Model calls behind one cached, pluggable provider (G*): prompts, lookups in a table of responses, calls for misses only.

A provider maps a list of prompts to a list of responses (null for a failure). Calls run where the partitions are, after
all filters. New answers are written before anything reads them, to the lasting table if its path is given, so neither a
second action nor a restart pays for a call twice.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import choices as R
from scholia.functions import jsonx as N
from scholia.functions import text as X
from scholia.sources.tables import written

Provider = Callable[[list[str]], list[str | None]]


def stub(prompts: list[str]) -> list[str | None]:
    """A deterministic provider for tests: a digest decides scores and choices."""
    out = []
    for p in prompts:
        d = int(hashlib.sha256(p.encode()).hexdigest(), 16)
        k = d % 5 + 1
        out.append(f'RELEVANCE_SCORE: {d % 10 + 1}\nREASONING: stub\nSCORE: {d // 10 % 10 + 1}\nThe correct answer is {k}) x\n{{"is_correct": {str(d % 2 == 0).lower()}, "confidence": 0.{d % 9 + 1}}}')
    return out


def retrying(call: Provider, tries: int = 5, longest: float = 300.0, jitter: tuple[float, float] = (0.1, 1.0), fatal: tuple[type, ...] = (PermissionError,)) -> Provider:
    """Exponential back-off with jitter; gives up at once on fatal errors; null after the last try."""

    def run(prompts: list[str]) -> list[str | None]:
        spent, wait = 0.0, 1.0
        for k in range(tries):
            try:
                return call(prompts)
            except fatal:
                break
            except Exception:
                if k == tries - 1 or spent + wait > longest:
                    break
                time.sleep(wait + random.uniform(*jitter))
                spent, wait = spent + wait, wait * 2
        return [None] * len(prompts)

    return run


def error_class(message: Column) -> Column:
    """What went wrong, by the message, in this order."""
    low = F.lower(message)
    return (
        F.when(message.contains("Invalid authentication") | message.contains("401"), "authentication")
        .when(low.contains("timeout") | low.contains("timed out"), "timeout")
        .when(low.contains("connection"), "connection")
        .when(message.contains("404") | low.contains("not found"), "not_found")
        .otherwise("other")
    )


class Bucket:
    """A token bucket: at most `rate` calls a second on average, `burst` at once. Clock and sleep can be replaced."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1, burst), clock, sleep
        self.held, self.at = float(self.burst), clock()

    def take(self) -> None:
        """Return when a call may be made. What is waited for is paid in advance, so a late sleeper gains nothing."""
        now = self.clock()
        self.held, self.at = min(float(self.burst), self.held + (now - self.at) * self.rate), now
        self.held -= 1
        if self.held < 0:
            self.sleep(-self.held / self.rate)


class Limit(NamedTuple):
    """A global rate (calls a second) shared by at most `tasks` tasks at a time, each with an equal part of it. A task that
    is tried again begins with an empty bucket, so that what its lost try has spent is not spent twice."""

    rate: float
    tasks: int = 8
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def bucket(self, attempt: int = 0) -> Bucket:
        out = Bucket(self.rate / self.tasks, 1, self.clock, self.sleep)
        if attempt:
            out.held = 0.0
        return out


def paced(prompts: list[str], provider: Provider, bucket: Bucket | None, batch: int) -> list[str | None]:
    """Responses in order: in batches, or one by one as the bucket allows."""
    out: list[str | None] = []
    for k in range(0, len(prompts), 1 if bucket else batch):
        if bucket:
            bucket.take()
        out += provider(prompts[k : k + (1 if bucket else batch)])
    return out


def respond(prompts: DataFrame, responses: DataFrame, provider: Provider, batch: int = 64, path: str | None = None, limit: Limit | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, prompt) with their response from the table (prompt_hash, response), and new rows of that table for misses,
    which are written once and, where a path is given, appended to the lasting table there. Failures are not kept there.
    Under a limit (O05) the misses are dealt to its number of tasks, each of which keeps its part of the global rate."""
    hashed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    misses = hashed.join(responses, "prompt_hash", "left_anti").groupBy("prompt_hash").agg(F.min("prompt").alias("prompt"))
    if limit:
        misses = misses.repartition(limit.tasks)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = limit.bucket(TaskContext.get().attemptNumber()) if limit else None
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                yield pd.DataFrame({"prompt_hash": part["prompt_hash"], "response": paced(part["prompt"].tolist(), provider, bucket, batch)})

    new = written(misses.mapInPandas(call, "prompt_hash string, response string"), "responses")
    if path:
        new.where("response is not null").write.mode("append").parquet(path)
    return hashed.join(responses.unionByName(new), "prompt_hash", "left"), new


def relevance_prompt(text: Column) -> Column:
    return F.concat(F.lit("Rate the relevance of this text from 1 to 10 as RELEVANCE_SCORE, with REASONING.\n\n"), text)


def relevance(response: Column, least: int = 6) -> Column:
    """Score and verdict; a failed call scores 5 and counts as relevant."""
    score = X.score_field(F.coalesce(response, F.lit("")), "RELEVANCE_SCORE", 5)
    return F.struct(score.alias("score"), (response.isNull() | (score >= least)).alias("is_relevant"))


def question_prompt(chunk: Column, kind: str, choices: int = 7) -> Column:
    """Asks for an item of a kind (multiple-choice, free_form, reasoning_trace) in labelled fields."""
    return F.concat(F.lit(f"Write a {kind} question with {choices} choices from this text. Use QUESTION:, ANSWER:, SCORE:.\n\n"), chunk)


def answer_prompt(question: Column) -> Column:
    return F.concat(F.lit("Answer the question.\n\n"), question)


def grade_prompt(question: Column, reference: Column, answer: Column) -> Column:
    return F.concat(F.lit("Grade the answer as JSON with is_correct and confidence.\nQUESTION: "), question, F.lit("\nREFERENCE: "), reference, F.lit("\nANSWER: "), answer)


def graded(response: Column) -> Column:
    """A failed call is wrong with confidence 0.1 and a parse error."""
    g = N.grade(F.coalesce(response, F.lit("")))
    return F.struct(F.coalesce(g["is_correct"], F.lit(False)).alias("is_correct"), F.when(response.isNull(), 0.1).otherwise(g["confidence"]).alias("confidence"), response.isNull().alias("parse_error"))


def predicted(response: Column) -> Column:
    """The choice a response names; a failed parse predicts 1 with low confidence."""

    def told(c: Column) -> Column:
        return F.struct(F.coalesce(R.normalised_choice(c["kind"], c["id"], "number"), F.lit("1")).alias("predicted"), F.when(c.isNull(), "low").otherwise("high").alias("confidence"))

    return X.bound(R.choice(response, "A-J", "1-9"), told)


def topic(response: Column, topics: tuple[str, ...]) -> Column:
    """An exact topic, else the first that holds or is held by the answer, else Other."""
    r = F.lower(F.trim(response))
    out = F.when(r.isin(*(t.lower() for t in topics)), F.initcap(r))
    for t in topics:
        out = out.when(r.contains(t.lower()) | F.lit(t.lower()).contains(r), t)
    return out.otherwise("Other")


def read_text(response: Column, fallback: str = "") -> Column:
    """A free answer, trimmed; a failed call gives the fallback."""
    return F.coalesce(F.nullif(F.regexp_replace(response, r"^\s+|\s+$", ""), F.lit("")), F.lit(fallback))


def read_lines(response: Column, most: int) -> Column:
    """Lines with text, without list marks, at most so many; none of a failed call."""
    lines = F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])?\s*|\s+$", ""))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def read_number(response: Column, field: str, fallback: float) -> Column:
    """A number in a labelled field."""
    return F.coalesce(F.regexp_extract(response, rf"{field}\s*:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(fallback))


def read_json(response: Column, schema: str, fallback: str) -> Column:
    """An object or array in any of the forms N07 knows; an answer that is none, or a failed call, gives the fallback (SQL)."""
    return F.coalesce(N.parsed(response, schema), F.expr(f"cast({fallback} as {schema})"))


#: Model calls by id: what is asked of the columns in braces, how the answer is read, and what counts where there is none.
CALLS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "G10": ("Analyse option {option} of the question.\n\n{question}", lambda r: read_json(r, "struct<analysis:string,plausibility:string>", "named_struct('analysis', '', 'plausibility', 'unknown')")),
    "G13": ("Compare the two predictions.\nFIRST: {one}\nSECOND: {two}", lambda r: read_text(r)),
    "G15": ("Do both texts ask the same question? Answer as JSON with is_match.\nA: {one}\nB: {two}", lambda r: read_json(r, "struct<is_match:boolean>", "named_struct('is_match', false)")["is_match"]),
    "G16": ("Why is the prediction wrong? Answer as JSON.\nQUESTION: {question}\nTRACE: {trace}", lambda r: read_json(r, "struct<fault_type:string,severity:string,sound:boolean>", "named_struct('fault_type', 'unknown', 'severity', 'unknown', 'sound', false)")),
    "G17": ("Rate consistency, disagreement and grounding of the trace as JSON.\n{trace}", lambda r: read_json(r, "struct<consistency:double,disagreement:double,grounding:double,overall:double>", "named_struct('consistency', 0.0D, 'disagreement', 0.0D, 'grounding', 0.0D, 'overall', 0.0D)")),
    "G18": ("The methods disagree. Diagnose as JSON.\nANSWERS: {answers}", lambda r: read_json(r, "struct<diagnosis:string,best:string>", "named_struct('diagnosis', '', 'best', '')")),
    "G19": ("Write the trace anew, mending: {diagnosis}\n{trace}", lambda r: read_text(r)),
    "G21": ("Think through every option, then answer as JSON with predicted and confidence.\n{question}", lambda r: read_json(r, "struct<predicted:string,confidence:string>", "named_struct('predicted', '1', 'confidence', 'low')")),
    "G22": ("Tell these thoughts as one stream.\n{thoughts}", lambda r: read_text(r)),
    "G23": ("Rate this question from 1 to 10 as SCORE.\n{question}", lambda r: read_number(r, "SCORE", 0.0)),
    "G25": ("Give five search phrases, one a line, for: {topic}", lambda r: read_lines(r, 5)),
    "G26": ("Score the paper on each criterion as a JSON object of numbers.\n{text}", lambda r: read_json(r, "map<string,double>", "map()")),
    "G27": ("Give the section {section} of the paper as JSON with content.\n{text}", lambda r: read_json(r, "struct<content:string>", "named_struct('content', cast(null as string))")["content"]),
    "G28": ("The section {section} is missing. Write it from the others as JSON with content.\n{text}", lambda r: read_json(r, "struct<content:string>", "named_struct('content', '')")["content"]),
    "G29": ("Extract {mode} from the text.\n{text}", lambda r: read_text(r, "ERROR: no answer")),
    "G30": ("Give the clauses of the text as a JSON object with clauses and quality.\n{text}", lambda r: read_json(r, "struct<clauses:array<string>,quality:double>", "named_struct('clauses', array(), 'quality', 0.5D)")),
    "G31": ("Name the topic of these papers in a few words.\n{titles}", lambda r: read_text(r)),
    "G32": ("Sum up the patterns in these errors.\n{errors}", lambda r: read_text(r)),
}


def call_prompt(name: str, **columns: Column) -> Column:
    """The prompt of a call, with its slots taken from columns (null: empty)."""
    out, rest = [], CALLS[name][0]
    while "{" in rest:
        before, slot = rest.split("{", 1)
        slot, rest = slot.split("}", 1)
        out += [F.lit(before), F.coalesce(columns[slot].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def is_relevant(response: Column) -> Column:
    """The one word *relevant*; a failed call is not."""
    return F.coalesce(F.lower(F.trim(response)) == "relevant", F.lit(False))


def document_kind(response: Column) -> Column:
    """TOOL before PROBLEM, else UNKNOWN; ERROR of a failed call."""
    up = F.upper(F.trim(response))
    return F.when(response.isNull(), "ERROR").when(up.contains("TOOL"), "TOOL").when(up.contains("PROBLEM"), "PROBLEM").otherwise("UNKNOWN")


def wanted(kind: Column, require: str) -> Column:
    """Only the opposite kind is left out; unknown documents and errors go on."""
    return kind != F.lit({"PROBLEM": "TOOL", "TOOL": "PROBLEM"}[require])


def alive(models: DataFrame, responses: DataFrame, provider: Provider) -> DataFrame:
    """The models that answer a probe."""
    got, _ = respond(models.withColumn("prompt", F.concat(F.lit("MODEL "), "model", F.lit("\nSay ok."))), responses, provider)
    return models.join(got.where("response is not null").select("model"), "model", "left_semi")


#: Rows of vectors that leave a task at once, whatever the size of a call's batch.
TOLD = 1000


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64) -> DataFrame:
    """Key and embedding by a provider, in batches; a batch that fails gives zero vectors. The answers of many calls make
    one frame, since a frame costs about as much for one row as for a thousand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = max(batch, TOLD // batch * batch)
            for at in range(0, len(b), held):
                part = b.iloc[at : at + held]
                texts, got = part[text].fillna("").tolist(), []
                for k in range(0, len(part), batch):
                    asked = texts[k : k + batch]
                    try:
                        answer = embed(asked)
                    except Exception:
                        answer = [[0.0] * size] * len(asked)
                    if len(answer) != len(asked):
                        raise ValueError(f"{len(answer)} vectors for {len(asked)} texts")
                    got += answer
                yield pd.DataFrame({key: part[key].array, "embedding": got})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def ordered(rows: DataFrame, order: str, prompt: Column, responses: DataFrame, provider: Provider) -> DataFrame:
    """Every row's response, failures left out, in the order of a column whichever task finished first."""
    got, _ = respond(rows.withColumn("prompt", prompt), responses, provider)
    return got.where("response is not null").drop("prompt", "prompt_hash").orderBy(order)
