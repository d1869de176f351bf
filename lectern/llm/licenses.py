"""License scans by patience alignment of texts with license templates.

Texts and templates are lower-cased words of letters and digits. Two word sequences are aligned by
taking off what they share at both ends, anchoring on the words that occur once in either, keeping
the longest run of anchors that rises in both, and aligning the gaps between them the same way. A
template's coverage is the share of its words that are aligned; it is found where that reaches
``threshold``.

Only stretches that can reach it are aligned: of any floor((1 - threshold) n) + 1 of a template's n words one must be
there, so a text without any of its longest ones is passed over, and a stretch starts at one of its
first ones and has enough words of the template in its length. Stretches of ``SLACK`` n words are aligned first. Between these
finds stretches of n + ``EXTRA`` words follow where that is more, as a few words put in make up much of a short template: "Released
under the terms and conditions of the MIT License" holds all five words of a notice; of the starts within such a find the last that
aligns as many words as any counts. This bounds what is found: a template of n words with more than ``EXTRA`` and more than
(``SLACK`` - 1) n words put in between is not.

Defined results: null and empty texts have no licenses; every copy in a text is reported; of overlapping finds the one with most
words stays, then the one of higher coverage, then the template listed first; repeated rows are reported each. Very long texts are read whole; an empty table has no finds.
Columns in ``keep`` are carried and must not clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.frames import mapped_schema, sliced, text_or_empty
from lectern.llm.license_texts import LICENSES

THRESHOLD = 0.8
SLACK = 1.25
EXTRA = 16
WORD = re.compile(r"[^\W_]+")


def rising(values: Sequence[int]) -> list[int]:
    """Positions of a longest strictly rising subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        place = bisect_left(ends, v)
        if place == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[place], at[place] = v, i
        before[i] = at[place - 1] if place else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """(position in text, position in template) of the aligned words, in order."""
    pairs = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1 and ours[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        kept = [anchors[i] for i in rising([t for _, t in anchors])]
        if not kept:
            continue
        pairs += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


@dataclass(frozen=True)
class Template:
    """A license's words, and what a text must have of them."""

    name: str
    words: tuple[str, ...]
    needed: int
    marks: tuple[str, ...]
    firsts: frozenset[str]

    @classmethod
    def of(cls, name: str, text: str, threshold: float) -> Template:
        words = tuple(WORD.findall(text.lower()))
        spare = floor((1 - threshold) * len(words) + 1e-9)
        longest = sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[: spare + 1]
        return cls(name, words, ceil(threshold * len(words) - 1e-9), tuple(dict.fromkeys(words[i] for i in longest)),
                   frozenset(words[: spare + 1]))


@dataclass(frozen=True)
class Find:
    """A template found in words ``first`` to ``last`` of a text."""

    template: int
    name: str
    matched: int
    coverage: float
    first: int
    last: int


def _in_words(words: Sequence[str], number: int, template: Template) -> Iterator[Find]:
    """Finds of one template, left to right, those of short stretches before those of longer ones between them."""
    n = len(template.words)
    known = set(template.words)
    hits = np.array([w in known for w in words], bool)
    total = np.concatenate([[0], np.cumsum(hits)])
    first = np.array([w in template.firsts for w in words], bool)

    def pass_of(width: int, low: int, high: int) -> Iterator[Find]:
        ends = np.minimum(np.arange(low, high) + width, high)
        enough = (total[ends] - total[low:high]) >= template.needed
        starts = (low + np.flatnonzero(enough & first[low:high])).tolist()

        def at_start(start: int) -> Find | None:
            pairs = aligned(words[start : min(start + width, high)], template.words)
            if len(pairs) < template.needed or pairs[0][0]:
                return None
            return Find(number, template.name, len(pairs), len(pairs) / n, start, start + pairs[-1][0])

        at = low
        for i, start in enumerate(starts):
            if start < at or not (found := at_start(start)):
                continue
            if width > short:
                inner = (at_start(s) for s in starts[i + 1 : bisect_left(starts, found.last)])
                found = max([found, *filter(None, inner)], key=lambda f: (f.matched, f.first))
            yield found
            at = found.last + 1

    short = ceil(SLACK * n)
    near = list(pass_of(short, 0, len(words)))
    yield from near
    if n + EXTRA > short:
        edges = [-1, *(x for f in near for x in (f.first, f.last)), len(words)]
        for before, after in zip(edges[::2], edges[1::2]):
            yield from pass_of(n + EXTRA, before + 1, after)


def finds(text: str, templates: Sequence[Template]) -> list[tuple[Find, int, int]]:
    """Finds that don't overlap, with their begin and end in code points, in order."""
    lowered = text.lower()
    wanted = [(i, t) for i, t in enumerate(templates) if t.words and any(m in lowered for m in t.marks)]
    if not wanted:
        return []
    # words of the text as it stands, so that places hold; lower() may change a text's length
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    out: list[Find] = []
    for found in sorted((f for i, t in wanted for f in _in_words(words, i, t)), key=lambda f: (-f.matched, -f.coverage, f.template, f.first)):
        if all(found.last < o.first or o.last < found.first for o in out):
            out.append(found)
    return [(f, spans[f.first][0], spans[f.last][1]) for f in sorted(out, key=lambda f: f.first)]


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", licenses: Mapping[str, str] = LICENSES,
         threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``license_id``, ``coverage``, ``begin`` and ``until`` (code points) of every find."""
    schema = mapped_schema(docs, keep, [
        T.StructField("license_id", T.StringType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("begin", T.LongType()), T.StructField("until", T.LongType())])
    templates = [Template.of(name, wording, threshold) for name, wording in licenses.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(i, *f) for i, t in enumerate(batch.column(len(keep)).to_pylist()) for f in finds(t, templates)]
            if found:
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    *(c.take(rows) for c in batch.columns[: len(keep)]),
                    pa.array([f[1].name for f in found]), pa.array([f[1].coverage for f in found]),
                    pa.array([f[2] for f in found]), pa.array([f[3] for f in found])], names=schema.names)

    return docs.select(*keep, text_or_empty(text).alias("__text")).mapInArrow(run, schema)
