"""Edit-aware token counts: a segment tree of token sums per document, of which an edit renews only what it touches.

A text is cut into segments at places where the tokenizer's pre-tokens always break: before a lone space between two
characters that are no white space. Tokens never cross such a place, whatever stands further away, so the text's count is
the sum over its segments. An edit is a span with a replacement; the segments it touches are encoded anew, together with
a neighbour where the edit reaches the characters that make the shared border safe, and the sums above them are updated.

Defined results: a null text counts as empty (no segments, 0 tokens); repeated rows are counted one by one; empty tables
give empty tables; very long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.packing import encode
from scholia.llm.textblock import blocks

SEGMENT = 256

Edit = tuple[int, int, str]


def _safe(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def borders(text: str, segment: int = SEGMENT) -> list[int]:
    """Places of the cuts, with 0 and the length at the ends."""
    cuts, at = [0], segment
    while at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if _safe(text, at):
            cuts.append(at)
            at += segment
        else:
            at += 1
    if text:
        cuts.append(len(text))
    return cuts


class Tree:
    """Segments in order and a heap of sums: node k has children 2k and 2k + 1, leaves begin at `width`."""

    def __init__(self, text: str, count: Callable[[str], int], segment: int = SEGMENT):
        self.count, self.encoded = count, 0
        cuts = borders(text, segment)
        self.parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self._fill([self._leaf(p) for p in self.parts])

    def _leaf(self, part: str) -> int:
        self.encoded += len(part)
        return self.count(part)

    def _fill(self, leaves: list[int]) -> None:
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = [0] * self.width + leaves + [0] * (self.width - len(leaves))
        for k in range(self.width - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def text(self) -> str:
        return "".join(self.parts)

    def _set(self, at: int, part: str) -> None:
        self.parts[at] = part
        k = self.width + at
        self.sums[k] = self._leaf(part) if part else 0
        while k > 1:
            k //= 2
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def _beside(self, at: int, step: int) -> int:
        """The next segment with text to this side; `at` if there is none. Edits leave empty segments behind."""
        k = at + step
        while 0 <= k < len(self.parts) and not self.parts[k]:
            k += step
        return k if 0 <= k < len(self.parts) else at

    def apply(self, edits: list[Edit]) -> None:
        """Edits (start, end, replacement) in places of the text as it was, in order, without overlaps."""
        if not self.parts:
            new = "".join(r for _, _, r in edits)
            self.parts = [new] if new else []
            self._fill([self._leaf(p) for p in self.parts])
            return
        offsets = [0]
        for p in self.parts:
            offsets.append(offsets[-1] + len(p))
        # runs of segments touched, with the edits inside each
        runs: list[list] = []
        k = 0
        for start, end, new in edits:
            while k < len(self.parts) - 1 and offsets[k + 1] <= start:
                k += 1
            low = k
            if start <= offsets[low] + 1:
                low = self._beside(low, -1)  # the space that opens this segment, or the character after it, may go
            high = k
            while end >= offsets[high + 1] and (beside := self._beside(high, 1)) != high:
                high = beside  # the character before a border may go
            if runs and low <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], high)
                runs[-1][2].append((start, end, new))
            else:
                runs.append([low, high, [(start, end, new)]])
        for low, high, inside in runs:
            base = offsets[low]
            old = "".join(self.parts[low : high + 1])
            out, at = [], 0
            for start, end, new in inside:
                out += [old[at : start - base], new]
                at = end - base
            out.append(old[at:])
            # the run's text becomes its first segment; the others are empty until the tree is rebuilt
            self._set(low, "".join(out))
            for j in range(low + 1, high + 1):
                self._set(j, "")
        full = [k for k, p in enumerate(self.parts) if p]
        if 2 * len(full) < len(self.parts):  # rebuilt from the sums it has; nothing is encoded
            leaves = [self.sums[self.width + k] for k in full]
            self.parts = [self.parts[k] for k in full]
            self._fill(leaves)


#: Fixed patterns of the cleaning edits: e-mail addresses, then runs of five or more digits.
REDACTIONS = ((r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"), (r"[0-9]{5,}", "<number>"))
_FOUND = re.compile("|".join(f"({p})" for p, _ in REDACTIONS))


def redactions(text: str) -> list[Edit]:
    return [(m.start(), m.end(), REDACTIONS[m.lastindex - 1][1]) for m in _FOUND.finditer(text)] if "@" in text or _FOUND.search(text) else []


def count_with_edits(docs: DataFrame, edits: Callable[[str], list[Edit]] = redactions, segment: int = SEGMENT, text: str = "text") -> DataFrame:
    """doc_id, n_tokens before and n_tokens_edited after the edits, n_segments, n_edits, chars_encoded anew for the edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_tokens", "n_segments", "n_edits", "n_tokens_edited", "chars_encoded"]
        for batch, _ in blocks(batches):
            done: dict[str, tuple] = {}
            rows = []
            for t in batch.column("text"):
                t = t.as_py()
                if (row := done.get(t)) is None:
                    tree = Tree(t, lambda part: len(encode(part)), segment)
                    before, parts, first = tree.total, len(tree.parts), tree.encoded
                    found = edits(t)
                    if found:
                        tree.apply(found)
                    row = done[t] = (before, parts, len(found), tree.total, tree.encoded - first)
                rows.append(row)
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, n_segments long, n_edits long, n_tokens_edited long, chars_encoded long")
