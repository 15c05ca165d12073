"""Language identification by partial matching: one variable-order byte context tree per language.

A tree's contexts are the last 0, 1, 2 or 3 bytes (A-Z folded; all 256 byte values are symbols). Contexts of two and three
bytes are grown where statistics suffice: those that hold at least one part in GROWN of their language's training bytes, so
a tree has at most 256 + 2 * GROWN contexts whatever the input. Training counts the symbols after each context over all
labelled training rows, one pass with map-side sums for each order; a pass knows from the one before which contexts to grow.
Escape probabilities (method C, lower orders without the symbols already seen) are folded in once on the driver: from then on
the statistics are frozen, and a text's exact code length under a language is a sum of table entries, each taken from the
longest grown context. Every language is learned, LANGUAGES at a time in name order: the driver holds and broadcasts the trees of one such
group (at most LANGUAGES * (256 + 2 * GROWN) * 256 entries, 69 MB as broadcast and 138 MB while trained), and each group's pass over the texts
carries the shortest code so far and the sum of the shares, so a table with more languages takes more passes, not more
memory. Between passes the texts are written; the usual table of few languages takes one pass.

Prediction: the language with the shortest code (ties: first in name order); score is its share when 2 ** -code lengths are
compared at a temperature of one part in 32 bytes, so that it does not saturate with length. The same text's code length under
bytes without context, of all languages together, tells whether any language explains it (see reject()).

Defined results: a null text, one without letters, or no training row at all give ``und`` with score 0; rows with a null
lang do not train; empty tables give empty tables; very long texts are scored whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.scratch import TEXTS, Scratch
from scholia.llm.textblock import _LOWER, Block, blocks

#: A context of two or three bytes is grown if it holds one part in GROWN of its language's bytes.
GROWN = 4096
#: Languages learned and compared in one pass.
LANGUAGES = 8
#: Counters that a task may hold as one dense array; beyond, a block's counts are sorted.
DENSE = 1 << 23
UNKNOWN = "und"


def _history(b: Block) -> tuple[np.ndarray, ...]:
    """Folded bytes, and those one, two and three places before; texts begin after spaces."""
    here = _LOWER[b.data].astype(np.int32)
    out = [here]
    begin = b.off[:-1][np.diff(b.off) > 0]
    for k in (1, 2, 3):
        x = np.full(len(here), 32, np.int32)
        x[k:] = here[:-k] if k < len(here) else here[:0]
        for j in range(k):  # places whose byte k before lies outside the text
            at = begin + j
            at = at[at < len(x)]
            x[at[_same_text(b, begin, at, j)]] = 32
        out.append(x)
    return tuple(out)


def _same_text(b: Block, begin: np.ndarray, at: np.ndarray, j: int) -> np.ndarray:
    """Whether place begin + j still lies in the text that begins there."""
    return (b.row_of(at) == b.row_of(begin[: len(at)])) if j else np.ones(len(at), bool)


class Tree:
    """A language's grown contexts: two[pair] and three[state of two * 256 + byte before] give states, or -1."""

    def __init__(self, two: np.ndarray, three: np.ndarray | None = None):
        self.two, self.three = two, three

    @property
    def n2(self) -> int:
        return int(self.two.max(initial=-1)) + 1

    @property
    def n3(self) -> int:
        return 0 if self.three is None else int(self.three.max(initial=-1)) + 1

    def states(self, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States of the grown contexts of two and of three bytes before each place; -1 where none is grown."""
        s2 = self.two[two * 256 + one]
        if self.three is None:
            return s2, np.full(len(s2), -1, np.int32)
        s3 = np.where(s2 >= 0, self.three[np.maximum(s2, 0) * 256 + three], -1)
        return s2, s3


class Model:
    """bits[l][state * 256 + byte]: code length; states are the 256 contexts of one byte, then the grown ones."""

    def __init__(self, langs: list[str], trees: list[Tree], bits: list[np.ndarray], symbols: np.ndarray):
        self.langs, self.trees, self.bits, self.symbols = langs, trees, bits, symbols

    @property
    def plain(self) -> np.ndarray:
        """Code lengths of bytes without context, from the counts of all languages together."""
        p = escape(self.symbols, np.full(256, 1 / 256))
        return -np.log2(np.maximum(p / p.sum(), 1e-12))

    def code_lengths(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text (row) under each language (column), and without context."""
        out, plain = np.zeros((b.n, len(self.langs))), np.zeros(b.n)
        full = np.flatnonzero(np.diff(b.off) > 0)
        if len(full):
            here, one, two, three = _history(b)
            begin = b.off[:-1][full]
            plain[full] = np.add.reduceat(self.plain[here], begin, dtype=np.float64)
            for k, tree in enumerate(self.trees):
                s2, s3 = tree.states(one, two, three)
                state = np.where(s3 >= 0, 256 + tree.n2 + s3, np.where(s2 >= 0, 256 + s2, one))
                out[full, k] = np.add.reduceat(self.bits[k][state * 256 + here], begin, dtype=np.float64)
        return out, plain


def escape(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of method C with exclusion: counts (..., S) blended with the lower order's (..., S)."""
    n = counts.sum(-1, keepdims=True)
    seen = counts > 0
    d = seen.sum(-1, keepdims=True)
    rest = np.where(seen, 0.0, lower)
    left = rest.sum(-1, keepdims=True)
    free = (d > 0) & (left > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        high = np.where(free, counts / (n + d), counts / n)
        low = np.where(free, d / (n + d), 0.0) * rest / left
    return np.where(d == 0, lower, np.where(seen, high, np.nan_to_num(low)))


def _summed(rows: DataFrame, code: dict[str, int], sizes: list[int], key) -> list[np.ndarray]:
    """For each language, counts (sizes[l] x 256) of the keys (state * 256 + byte, -1 for none) of its rows."""
    begin = np.concatenate(([0], np.cumsum(sizes))) * 256
    total = int(begin[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(total if total <= DENSE else 0, np.int64)
        for part, b in blocks(batches):
            lang = np.array([code.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)
            of = np.repeat(lang, np.diff(b.off))
            history = _history(b)
            for k in np.unique(lang[lang >= 0]):
                mine = of == k
                got = key(int(k), *(x[mine] for x in history))
                got = got[got >= 0] + begin[k]
                if len(dense):
                    dense += np.bincount(got, minlength=total)
                else:
                    at, n = np.unique(got, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["key", "n"])
        at = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], names=["key", "n"])

    # a group of LANGUAGES trees of 256 + 2 * GROWN contexts at most: a proven bound
    got = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(total)
    flat[got["key"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return [flat[a:z].reshape(-1, 256) for a, z in zip(begin[:-1], begin[1:], strict=True)]


def _grow(counts: np.ndarray, least: float) -> np.ndarray:
    """States, by flat index, of the entries of at least this count; -1 for the others."""
    flat = counts.ravel()
    out = np.full(len(flat), -1, np.int32)
    grown = np.flatnonzero(flat >= least)
    out[grown] = np.arange(len(grown))
    return out


def languages(rows: DataFrame) -> list[str]:
    """The values of lang in name order; their names alone reach the driver."""
    return sorted(r["lang"] for r in rows.select("lang").distinct().collect())


def train(rows: DataFrame, grown: int = GROWN, langs: list[str] | None = None) -> Model | None:
    """The frozen trees of these languages (all, if none are named) from rows (lang not null, text)."""
    langs = languages(rows) if langs is None else langs
    if not langs:
        return None
    rows = rows.where(F.col("lang").isin(langs))
    code = {x: k for k, x in enumerate(langs)}
    first = _summed(rows, code, [256] * len(langs), lambda k, here, one, two, three: one * 256 + here)
    least = [max(4.0, c.sum() / grown) for c in first]
    trees = [Tree(_grow(c, m)) for c, m in zip(first, least, strict=True)]  # an entry of `first` is the pair of the byte before and the byte
    second = _summed(rows, code, [max(1, t.n2) for t in trees], lambda k, here, one, two, three: _key(trees[k].states(one, two, three)[0], here))
    for t, c, m in zip(trees, second, least, strict=True):
        t.three = _triples(t, c[: t.n2], m)
    third = _summed(rows, code, [max(1, t.n3) for t in trees], lambda k, here, one, two, three: _key(trees[k].states(one, two, three)[1], here))
    bits = []
    for t, c1, c2, c3 in zip(trees, first, second, third, strict=True):
        p0 = escape(c1.sum(0), np.full(256, 1 / 256))
        p1 = escape(c1, np.broadcast_to(p0, (256, 256)))
        pair = np.flatnonzero(t.two >= 0)  # in order of state
        p2 = escape(c2[: t.n2], p1[pair % 256])
        triple = np.flatnonzero(t.three >= 0)
        p3 = escape(c3[: t.n3], p2[triple // 256])
        p = np.concatenate((p1, p2, p3))
        p = p / p.sum(-1, keepdims=True)
        bits.append(-np.log2(np.maximum(p, 1e-12)).ravel().astype(np.float32))
    return Model(langs, trees, bits, sum(c.sum(0) for c in first))


def _key(state: np.ndarray, here: np.ndarray) -> np.ndarray:
    return np.where(state >= 0, state.astype(np.int64) * 256 + here, -1)


def _triples(t: Tree, counts: np.ndarray, least: float) -> np.ndarray:
    """States of the contexts (a, b, c) that occur `least` times: at [state of (b, c)] * 256 + a, in that order."""
    out = np.full(max(1, t.n2) * 256, -1, np.int32)
    pair = np.flatnonzero(t.two >= 0)
    state, c = np.nonzero(counts >= least)
    a, b = pair[state] // 256, pair[state] % 256
    s2 = t.two[b * 256 + c]
    at = np.sort((s2.astype(np.int64) * 256 + a)[s2 >= 0])
    out[at] = np.arange(len(at))
    return out


_STATE = {"bits_": "double", "best_": "string", "odds_": "double"}
_MADE = {"lang_pred": "string", "score": "double", "bits_per_byte": "double", "plain_bits_per_byte": "double"}


def _typed(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def _compared(docs: DataFrame, model: Model, last: bool) -> DataFrame:
    """docs with the state after this model's languages (the shortest code, its language, the sum of shares relative to it), or,
    with the last model, with the prediction in its place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in _STATE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, b in blocks(batches):
            bits, plain = m.code_lengths(b)
            n = np.maximum(np.diff(b.off), 1)
            scale = np.maximum(1.0, n / 32)
            at = bits.argmin(1)
            here = bits[np.arange(b.n), at]
            odds = np.exp2(-np.minimum((bits - here[:, None]) / scale[:, None], 900)).sum(1)
            before, total = part.column("bits_").to_numpy(), part.column("odds_").to_numpy()
            best = np.where(here < before, np.array(m.langs, object)[at], np.array(part.column("best_").to_pylist(), object))
            least = np.minimum(here, before)
            share = lambda x: np.exp2(-np.minimum((x - least) / scale, 900))  # noqa: B023, E731
            total = np.where(np.isinf(before), odds, total * share(np.where(np.isinf(before), 0, before)) + odds * share(here))
            if not last:
                made, names = [pa.array(least), pa.array(best, pa.string()), pa.array(total)], list(_STATE)
            else:
                letters = part.column("letters_").to_numpy(zero_copy_only=False)
                made, names = [pa.array(np.where(letters, best, UNKNOWN), pa.string()), pa.array(np.where(letters, 1 / total, 0.0)), pa.array(least / n, mask=~letters), pa.array(plain / n, mask=~letters)], list(_MADE)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *made], names=[*own, *names])

    made = _MADE if last else _STATE
    return docs.mapInArrow(run, f"{_typed(docs.select(*own))}, {', '.join(f'{c} {t}' for c, t in made.items())}")


def _begun(docs: DataFrame) -> DataFrame:
    docs = docs.drop(*_MADE, *_STATE, "letters_")
    return docs.withColumns({"letters_": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), "bits_": F.lit(float("inf")), "best_": F.lit(UNKNOWN), "odds_": F.lit(0.0)})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with lang_pred, score, bits_per_byte and plain_bits_per_byte (without context), the last two null
    for ``und``; they replace columns of these names."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.drop(*_MADE, *_STATE, "letters_").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": none, "plain_bits_per_byte": none})
    return _compared(_begun(docs), model, True).drop("letters_")


def predict_all(docs: DataFrame, rows: DataFrame, grown: int = GROWN, group: int = LANGUAGES) -> DataFrame:
    """predict() by the trees of all languages of rows, a group of them at a time."""
    langs = languages(rows)
    if len(langs) <= group:
        return predict(docs, train(rows, grown, langs))
    s, state, symbols = Scratch(docs.sparkSession, "languages"), _begun(docs), np.zeros(256)
    for a in range(0, len(langs), group):
        model = train(rows, grown, langs[a : a + group])
        symbols = model.symbols = symbols + model.symbols
        last = a + group >= len(langs)
        state = _compared(state, model, last)
        if not last:
            state = s.sweep(s.keep(state, "state", TEXTS))
    return state.drop("letters_")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the table's own training rows and predict every row from its text alone."""
    return predict_all(docs.select("doc_id", "text"), training_rows(docs))


def reject(docs: DataFrame) -> DataFrame:
    """The rows of docs in a known language: with letters, and a code that context shortens. A text whose best language
    needs more bits than bytes without context do is in none of the languages learned."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    found = predict_all(rows, training_rows(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= F.col("plain_bits_per_byte"))).select("row.*")
