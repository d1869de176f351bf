"""Quality classifier from weak labels.

Heuristic labellers look at a text's measures and vote good, bad or not at all. Expectation-maximisation
over the counts of all documents' vote patterns estimates how often each labeller votes what in either class, and
so the probability that a document with a pattern is good. These posterior labels train a linear scorer over hashed
shapes of the text (runs of letter, capital, digit and symbol classes, and the measures in steps), which scores every document.

The label model sees every document, as counts of at most 3^9 patterns; the scorer is fitted on the driver on a
sample of at most ``SAMPLED`` distinct whole texts, picked by hash, each weighing as much as it has copies.

Defined results: null text is empty; an empty text gets no votes, a score by its empty shape, and isn't kept; equal texts get equal scores;
an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.frames import mapped_schema, sliced, text_or_empty

SAMPLED = 3000
DIMENSIONS = 1 << 12
CHUNK = 1 << 18
EM_ROUNDS = 200
STEPS = 80
PENALTY = 1e-4
KEEP = 0.5
GOOD, BAD, ABSTAIN = 2, 1, 0

# (measure, good up to / from, bad from / up to): a labeller votes good on one side, bad beyond the other, else abstains. Most
# only ever vote bad: that a text isn't all capitals says nothing for it. Every kind of junk is seen by several.
LABELLERS = (
    ("symbols", None, 0.04),  # of all characters
    ("odd_words", None, 0.20),  # words with a character that is neither letter, digit nor plain mark
    ("plain_words", 0.90, 0.60),  # words of letters with one plain mark after them at most
    ("capitals", None, 0.30),  # of letters
    ("doubled_marks", None, 0.10),  # "!!" or "??" by word
    ("repeated_grams", None, 0.30),  # of runs of three words
    ("distinct_words", None, 0.25),  # of words, or of 400
    ("repeated_lines", None, 0.40),
    ("short_words", 0.15, 0.03),  # of words, three letters or fewer
)
RISING = {"plain_words", "distinct_words", "short_words"}  # good from the first bound on


@cache
def _shapes() -> np.ndarray:
    """Class of a code point: letters by case, digits and white space alike, others as they are."""
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = ord("A") if c.isupper() else ord("a")
        elif c.isdigit():
            table[point] = ord("0")
        elif c.isspace() and c != "\n":
            table[point] = ord(" ")
    return table


PLAIN_MARKS = ".,;:'\"?!()-’‘“”«»¿¡…–—"


def measures(text: str) -> dict[str, float] | None:
    """What the labellers look at; None without words."""
    words = text.split()
    if not words:
        return None
    letters = capitals = symbols = 0
    plain = np.array([ord(c) for c in PLAIN_MARKS], np.uint32)
    for low in range(0, len(text), CHUNK):
        shape = _shapes()[np.frombuffer(text[low : low + CHUNK].encode("utf-32-le"), "<u4")]
        small, large = int((shape == ord("a")).sum()), int((shape == ord("A")).sum())
        letters, capitals = letters + small + large, capitals + large
        other = shape[(shape != ord("a")) & (shape != ord("A")) & (shape != ord("0")) & (shape != ord(" ")) & (shape != ord("\n"))]
        symbols += int((~np.isin(other, plain)).sum())
    distinct = Counter(words)
    kinds = {w: _kind(w) for w in distinct}
    lines = [x for line in text.split("\n") if (x := line.strip())]
    total = len(words)
    return {
        "symbols": symbols / len(text),
        "odd_words": sum(n for w, n in distinct.items() if kinds[w] == "odd") / total,
        "plain_words": sum(n for w, n in distinct.items() if kinds[w] == "plain") / total,
        "capitals": capitals / max(letters, 1),
        "doubled_marks": (text.count("!!") + text.count("??")) / total,
        "repeated_grams": 1 - len(set(zip(words, words[1:], words[2:]))) / (total - 2) if total > 2 else 0.0,
        "distinct_words": len(distinct) / min(total, 400),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
        "short_words": sum(n for w, n in distinct.items() if len(w) <= 3) / total,
    }


def _kind(word: str) -> str:
    if word.isalpha() or word[:-1].isalpha() and word[-1] in PLAIN_MARKS:
        return "plain"
    return "other" if all(c.isalnum() or c in PLAIN_MARKS for c in word) else "odd"


def votes(found: dict[str, float] | None) -> list[int]:
    """Every labeller's vote."""
    if found is None:
        return [ABSTAIN] * len(LABELLERS)
    out = []
    for name, good, bad in LABELLERS:
        value, sign = found[name], -1 if name in RISING else 1
        is_good = good is not None and sign * value <= sign * good
        out.append(GOOD if is_good else BAD if sign * value >= sign * bad else ABSTAIN)
    return out


def pattern(cast: Sequence[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(cast))


def features(text: str, found: dict[str, float] | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed shapes of 2 to 4 characters (square roots, unit length) and the measures' steps."""
    counts = np.zeros(dimensions)
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    tail = np.zeros(3, np.uint32)
    for low in range(0, len(text), CHUNK):
        shape = np.concatenate([tail, _shapes()[np.frombuffer(text[low : low + CHUNK].encode("utf-32-le"), "<u4")]])
        rolled = shape[3:] * np.uint32(0x9E3779B1)
        for back, factor in ((1, 0x85EBCA77), (2, 0xC2B2AE3D), (3, 0x27D4EB2F)):
            rolled = (rolled ^ (rolled >> np.uint32(15))) + shape[3 - back : len(shape) - back] * np.uint32(factor)
            counts += np.bincount((rolled * np.uint32(0x165667B1)) >> shift, minlength=dimensions)
        tail = shape[-3:]
    roots = np.sqrt(counts)
    out = roots / max(float(np.linalg.norm(roots)), 1e-9)
    steps = {"none": 0.0} if found is None else found
    for name, value in steps.items():
        step = int(np.floor(10 * value)) if name != "word_length" else int(value)
        out[zlib.crc32(f"{name}:{step}".encode()) % dimensions] += 0.5
    return out.astype(np.float32)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, by labeller, class (bad, good) and vote, how often it is cast."""

    good: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern."""
        cast = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
        logs = np.log(self.rates)
        odds = np.log(self.good / (1 - self.good)) + sum(
            logs[i, 1, cast[:, i]] - logs[i, 0, cast[:, i]] for i in range(len(LABELLERS)))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over pattern counts; begins with any vote for bad outweighing those for good."""
    cast = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good = np.where((cast == BAD).any(axis=1), 0.1, 0.9)
    model = None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        rates = np.array([[[w[cast[:, i] == v].sum() + 0.5 for v in range(3)] for w in weight] for i in range(len(LABELLERS))])
        rates /= rates.sum(axis=2, keepdims=True)
        share = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        last, model = model, LabelModel(share, rates)
        good = model.posterior(patterns)
        if last is not None and np.abs(model.rates - last.rates).max() < 1e-6:
            break
    return model


def fitted(x: np.ndarray, target: np.ndarray, copies: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights (the last is the offset) of a logistic scorer for targets between 0 and 1, both classes weighing the same.

    Every row counts ``copies`` times.
    """
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    good, bad = max(float((copies * target).sum()), 1e-3), max(float((copies * (1 - target)).sum()), 1e-3)
    weight = copies * (target / good + (1 - target) / bad) / 2
    w = np.zeros(x.shape[1], np.float32)
    ahead, pace, rate = w.copy(), 1.0, 1 / (0.25 * float((x * x).sum(axis=1).max()) + penalty)
    for _ in range(steps):
        miss = (weight * (1 / (1 + np.exp(-(x @ ahead))) - target)).astype(np.float32)
        step = ahead - np.float32(rate) * (miss @ x + np.float32(penalty) * ahead)
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, w, pace = step + np.float32((pace - 1) / next_pace) * (step - w), step, next_pace
    return w


@dataclass(frozen=True)
class Model:
    labels: LabelModel
    weights: np.ndarray


def _patterns(docs: DataFrame, text: str) -> DataFrame:
    """(pattern, hash): vote pattern and hash of every document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = [pattern(votes(measures(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), batch.column(1)], names=["pattern", "hash"])

    whole = text_or_empty(text)
    return docs.select(whole.alias("text"), F.xxhash64(whole, F.lit(11)).alias("hash")).mapInArrow(run, "pattern int, hash bigint")


def learn(docs: DataFrame, text: str = "text", sampled: int = SAMPLED) -> Model | None:
    """Label model of all documents, scorer of a sample; None of an empty table."""
    copies = _patterns(docs, text).groupBy("pattern", "hash").count()
    seen = [tuple(r) for r in copies.groupBy("pattern").agg(F.sum("count"), F.count("*")).collect()]
    if not seen:
        return None
    patterns, counts, texts = (np.array(x) for x in zip(*sorted(seen)))
    labels = estimated(patterns, counts)
    total = int(texts.sum())  # copies of a text share its hash: the cut is for distinct ones
    order = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30))
    sample = (
        docs.select(text_or_empty(text).alias("text")).withColumn("order", order)
        .where(F.col("order") < int(min(1.0, 2 * sampled / total + 100 / total) * (1 << 30)))
        .groupBy("order", "text").count().orderBy("order", "text").limit(sampled).select("text", "count")
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(t, measures(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([pattern(votes(m)) for _, m in found], pa.int32()),
                pa.array([features(t, m).tobytes() for t, m in found], pa.binary()), batch.column(1)],
                names=["pattern", "features", "copies"])

    rows = sorted((r.pattern, bytes(r.features), r.copies)
                  for r in sample.mapInArrow(featured, "pattern int, features binary, copies bigint").collect())
    x = np.array([np.frombuffer(f, np.float32) for _, f, _ in rows])
    return Model(labels, fitted(x, labels.posterior(np.array([p for p, _, _ in rows])), np.array([n for _, _, n in rows])))


def score(docs: DataFrame, model: Model | None, keep: Sequence[str] = ("doc_id",), text: str = "text",
          threshold: float = KEEP) -> DataFrame:
    """``keep`` columns, ``posterior`` of the label model, ``score`` of the scorer, and ``keep``: whether the score reaches ``threshold``."""
    schema = mapped_schema(docs, keep, [
        T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches):
            found = [(t, measures(t)) for t in batch.column(len(keep)).to_pylist()]
            posterior = known.labels.posterior(np.array([pattern(votes(m)) for _, m in found]))
            margins = np.array([float((features(t, m) * known.weights[:-1]).sum(dtype=np.float64)) for t, m in found])
            scores = 1 / (1 + np.exp(-(margins + known.weights[-1])))
            stays = (scores >= threshold) & np.array([bool(t) for t, _ in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(posterior), pa.array(scores), pa.array(stays)], names=schema.names)

    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.select(*keep, text_or_empty(text).alias("__text")).mapInArrow(run, schema)
