"""Mixing documents to target weights by soft membership, in DataFrame functions only.

1. Classifier: a Bernoulli naive Bayes over a table of labels. Features of a text are the presence of WORDS telling words
   and of one bin each for length, distinct words, symbols, capitals and word length. It is fitted to at most FIT_ROWS
   labelled rows, chosen by hash; everything after it covers all rows.
2. Posteriors are rounded to one part in PARTS. Rates depend on the posterior alone (a step in the metric of the token
   counts), so rows with equal posteriors are summed to one.
3. Projected gradient: rates r >= 0 minimise m' H^-1 m, where m[k] = sum_d t[d] p[d][k] r[d] - target[k] and
   H = sum_d t[d] p[d] p[d]'. In that metric the gradient of a rate is p[d]' H^-1 m and a step of 1 is safe. A step is first
   tried with the H of the rates that are not cut off at 0, which meets all targets at once if no more are cut off; it is
   taken back if the miss grows. Each step is one distributed sum; only numbers by domain reach the driver. It ends when
   every domain is within TOLERANCE of its own target, or when a safe step shrinks the miss by less than STALL: then no
   rates meet the targets and these are about the nearest (targets of 0 are such a case, as posteriors are soft). Every
   document's rate follows from its posterior and the list of steps, without a join. The misses are returned with the rates,
   and with them a certificate: how far the rates are from the conditions that hold at the optimum (gradient 0 where a rate
   is above 0, none below 0 elsewhere), as a share of the gradient that
   the targets alone would give; 0 when they are met.
4. A rate is rounded to a number of copies by the document's own hash, so expected totals are kept.

Defined results: a null text has no words and 0 tokens; rows without label are predicted like others; labels of unknown
documents and null labels do not train; several labels of a document count once (the greatest); with no labelled row there
is one domain, ``unlabelled``, with rate 1; domains without a target get target 0; empty tables give empty tables.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.scratch import Scratch

FIT_ROWS = 20_000
WORDS = 64
#: Rows of the pooled rate that each domain's rates are shrunk by.
SHRINK = 10.0
LIFT = 3.0
PARTS = 10_000
STEPS = 60
#: Of a domain's target; a target under LEAST_SHARE of all tokens (or none) counts as so much.
TOLERANCE, LEAST_SHARE = 5e-3, 1e-3
STALL = 0.02
UNLABELLED = "unlabelled"

_SPACE = r"[\x20\x09-\x0D]+"


def _bin(name: str, value: Column, cuts: list[float]) -> Column:
    out = F.lit(f"\x00{name}0")
    for k, c in enumerate(cuts):
        out = F.when(value >= c, F.lit(f"\x00{name}{k + 1}")).otherwise(out)
    return out


def features(docs: DataFrame) -> DataFrame:
    """docs' columns, n_tokens (words) and feats: distinct lower-case words and bins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # trimmed first, so that splitting leaves no empty word to filter out
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    df = docs.withColumn("words_", F.when(bare != "", F.split(bare, _SPACE)).otherwise(F.expr("cast(array() as array<string>)")))
    df = df.withColumn("distinct_", F.array_distinct("words_"))
    n = F.greatest(F.size("words_"), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    # a regex scan costs a fraction of translate(), which looks up every character
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>!]"))
    bins = F.array(
        _bin("length", F.size("words_"), [1, 20, 100, 400]),
        _bin("distinct", F.size("distinct_") / n, [0.1, 0.3, 0.5, 0.7]),
        _bin("symbols", symbols / chars, [0.005, 0.02, 0.05]),
        _bin("capitals", capitals / chars, [0.05, 0.2, 0.5]),
        _bin("word", F.length(text) / n, [4, 6, 8, 12]),
    )
    return df.withColumns({"n_tokens": F.size("words_").cast("long"), "feats_": F.concat(F.col("distinct_"), bins)}).drop("words_", "distinct_")


class Classifier:
    """Domains, prior and presence weights: score[k] = prior[k] + sum of weights[f][k] over the features present."""

    def __init__(self, domains: list[str], prior: list[float], weights: dict[str, list[float]]):
        self.domains, self.prior, self.weights = domains, prior, weights

    def with_posteriors(self, feats: DataFrame) -> DataFrame:
        """feats with parts: the posterior by domain, array<int> in PARTS; the first of the largest gets what rounding leaves.

        Each step is a column of its own: the optimiser does not repeat a costly column that is used more than once.
        """
        if len(self.domains) == 1:
            return feats.withColumn("parts", F.array(F.lit(PARTS)))
        known = F.array(*(F.lit(w) for w in self.weights))
        table = F.create_map(*(x for w, v in self.weights.items() for x in (F.lit(w), F.array(*(F.lit(y) for y in v)))))
        start = F.array(*(F.lit(x) for x in self.prior))
        score = F.aggregate(F.array_intersect("feats_", known), start, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
        df = feats.withColumn("score_", score).withColumn("top_", F.array_max("score_"))
        df = df.withColumn("odds_", F.transform("score_", lambda x: F.exp(x - F.col("top_"))))
        df = df.withColumn("total_", F.aggregate("odds_", F.lit(0.0), lambda a, b: a + b))
        df = df.withColumn("low_", F.transform("odds_", lambda x: F.round(PARTS * x / F.col("total_")).cast("int")))
        df = df.withColumn("rest_", F.lit(PARTS) - F.aggregate("low_", F.lit(0), lambda a, b: a + b)).withColumn("best_", F.array_position("low_", F.array_max("low_")) - 1)
        df = df.withColumn("parts", F.transform("low_", lambda x, i: x + F.when(i == F.col("best_"), F.col("rest_")).otherwise(0)))
        return df.drop("score_", "top_", "odds_", "total_", "low_", "rest_", "best_")


def train(docs: DataFrame, labels: DataFrame, s: Scratch, fit_rows: int = FIT_ROWS, words: int = WORDS) -> Classifier:
    """The classifier of domain ``quality/toxic`` over labelled rows of docs (doc_id, text)."""
    domain = F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    named = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(domain).alias("domain"))
    chosen = named.orderBy(F.xxhash64("doc_id")).limit(fit_rows)
    # at most fit_rows rows of a number and a label: a proven bound
    fit = docs.join(F.broadcast(s.keep(chosen, "labels")), "doc_id")
    rows = s.keep(features(fit).select("domain", "feats_"), "labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier([UNLABELLED], [0.0], {})
    domains, total = sorted(sizes), sum(sizes.values())
    by = s.keep(rows.select("domain", F.explode("feats_").alias("f")).groupBy("f").pivot("domain", domains).agg(F.count(F.lit(1))).na.fill(0), "features")
    n = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    # telling words are LIFT times as frequent in some domain as in all: common words say more of the language than of the domain
    rates = [(F.col(f"`{d}`") + SHRINK * n / total) / (sizes[d] + SHRINK) for d in domains]
    lift = F.greatest(*(r / (n / total) for r in rates), F.lit(0.0))
    gain = sum((F.abs(r - n / total) * F.lit(math.sqrt(sizes[d] / total)) for d, r in zip(domains, rates, strict=True)), F.lit(0.0))
    words_only = by.where(~F.col("f").startswith("\x00") & (n >= 5)).withColumn("gain", gain)
    telling = words_only.where(lift >= LIFT).orderBy(F.desc("gain"), "f").limit(words).drop("gain")
    table = telling.union(by.where(F.col("f").startswith("\x00"))).collect()
    prior = [math.log(sizes[d] / total) for d in domains]
    weights = {}
    for r in table:
        pooled = (sum(r[d] for d in domains) + 0.5) / (total + 1)
        p = [(r[d] + SHRINK * pooled) / (sizes[d] + SHRINK) for d in domains]
        weights[r["f"]] = [math.log(x / (1 - x)) for x in p]
        prior = [a + math.log(1 - x) for a, x in zip(prior, p, strict=True)]
    return Classifier(domains, prior, weights)


def rate(parts: Column, steps: list[list[float]]) -> Column:
    """The rate after these steps of a row with this posterior (in PARTS); it begins at 1."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*(F.lit(float(x)) for x in e)) for e in steps))

    def move(r: Column, e: Column) -> Column:
        change = F.aggregate(F.zip_with(e, parts, lambda a, p: a * p / PARTS), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(0.0), r - change)

    return F.aggregate(moves, F.lit(1.0), move)


class Fit(NamedTuple):
    #: Steps of the rates, by domain.
    steps: list[list[float]]
    #: Token totals by domain less their targets.
    misses: list[float]
    #: 0 if the targets are met; else the largest breach of the optimum's conditions, as a share of the targets' gradient.
    residual: float


def fit(groups: DataFrame, targets: list[float], s: Scratch, most: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """The projected gradient over groups (parts, tokens), toward token totals by domain."""
    k = len(targets)
    p = [F.element_at("parts", i + 1) / float(PARTS) for i in range(k)]
    t = F.col("tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def gram(got, name: str) -> np.ndarray:
        return np.array([[got[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    h = gram(groups.agg(*(F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in pairs)).first(), "c")
    if not h.any():
        return Fit([], [0.0] * k, 0.0)
    inverse = np.linalg.pinv(h, rcond=1e-10, hermitian=True)
    goal = np.array(targets)
    allowed = tolerance * np.maximum(goal, LEAST_SHARE * goal.sum())
    steps: list[list[float]] = []
    met = True
    rows, kept, safe, before = groups.withColumn("r", F.lit(1.0)), None, False, math.inf
    free = (F.col("r") > 0).cast("double")
    while True:
        got = rows.agg(*(F.sum(t * p[i] * F.col("r")).alias(f"s{i}") for i in range(k)), *(F.sum(free * t * p[i] * p[j]).alias(f"f{i}_{j}") for i, j in pairs)).first()
        miss = np.array([got[f"s{i}"] for i in range(k)]) - goal
        now, taken = float(miss @ inverse @ miss), gram(got, "f")
        if (np.abs(miss) <= allowed).all():
            break
        if now > before and not safe:
            steps.pop()
            (rows, miss, taken, now), safe = kept, True
        elif now >= (1 - STALL) * before and safe or len(steps) == most:
            met = False
            break
        else:
            safe = now >= (1 - STALL) * before
        kept, before = (rows, miss, taken, now), now
        steps.append(((inverse if safe else np.linalg.pinv(taken, rcond=1e-10, hermitian=True)) @ miss).tolist())
        move = sum((F.lit(float(x)) * p[i] for i, x in enumerate(steps[-1])), F.lit(0.0))
        rows = rows.withColumn("r", F.greatest(F.lit(0.0), F.col("r") - move))
        if len(steps) % 4 == 0:
            rows = s.keep(rows, "rates")
    if met:
        return Fit(steps, miss.tolist(), 0.0)

    def gradient(m: np.ndarray) -> Column:
        return sum((F.lit(float(x)) * p[i] for i, x in enumerate(inverse @ m)), F.lit(0.0))

    breach = F.when(F.col("r") > 0, F.abs(gradient(miss))).otherwise(F.greatest(F.lit(0.0), -gradient(miss)))
    got = rows.agg(F.max(breach).alias("now"), F.max(F.abs(gradient(goal))).alias("whole")).first()
    return Fit(steps, miss.tolist(), got["now"] / got["whole"] if got["whole"] else 0.0)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], seed: int = 11) -> DataFrame:
    """doc_id, n_tokens, parts (the posterior by domain), rate, copies and the likeliest domain of every row of docs, with that
    domain's miss (tokens beyond its target, as a share of it) and the fit's residual; weights are shares of the tokens by
    domain ``quality/toxic``."""
    s = Scratch(docs.sparkSession, "mixing")
    slim = docs.select("doc_id", "text")
    model = train(slim, labels, s)
    rows = s.keep(model.with_posteriors(features(slim).select("doc_id", "n_tokens", "feats_")).select("doc_id", "n_tokens", "parts"), "posteriors")
    groups = s.keep(rows.groupBy("parts").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "groups")
    total = groups.agg(F.sum("tokens")).first()[0] or 0
    share = [weights.get(x, 0.0) for x in model.domains] if model.domains != [UNLABELLED] else [1.0]
    targets = [x * total / (sum(share) or 1.0) for x in share]
    found = fit(groups, targets, s)
    if found.residual:
        warnings.warn(f"no rates meet the targets; token totals miss them by {found.misses}", stacklevel=2)
    misses = [m / max(t, LEAST_SHARE * total, 1.0) for m, t in zip(found.misses, targets, strict=True)]
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 32)) / float(1 << 32)
    out = rows.withColumn("rate", rate(F.col("parts"), found.steps))
    out = out.withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))
    out = out.withColumn("domain", F.element_at(F.array(*(F.lit(x) for x in model.domains)), F.array_position("parts", F.array_max("parts")).cast("int")))
    own = F.array_position("parts", F.array_max("parts")).cast("int")
    out = out.withColumns({"miss": F.element_at(F.array(*(F.lit(float(x)) for x in misses)), own), "residual": F.lit(float(found.residual))})
    return s.sweep(out)
