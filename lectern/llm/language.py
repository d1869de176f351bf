"""Language ID in two levels: the family first, then linear support vector machines within it.

A text's letters, lower-cased and with one space for any run of other characters, give counts of
hashed character 1- to 3-grams (square roots, unit length). One machine per family, against all others, picks the
family; one machine for every pair of its languages then votes on the language. The
machines are fitted on the driver, on a bounded sample of distinct whole texts: at most ``PER_LANGUAGE`` per language, picked by
hash, so a language's share does not depend on how common it is. Prediction reads whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing can be learned; with one language only it is predicted with score 1. Equal texts get equal results.
Columns in ``keep`` are carried and must not clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.frames import mapped_schema, sliced, text_or_empty

# Families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af fy lb sv da no nb nn is fo yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi ur bn pa gu mr ne sa si or as",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "austronesian": "id ms jv su tl mg mi",
}
UNKNOWN = "und"
PER_LANGUAGE = 250
MOST_SAMPLED = 6000
DIMENSIONS = 1 << 12
STEPS = 100
PENALTY = 1e-5
SLOPE = 2.0  # of the curve from a machine's margin to a share
CHUNK = 1 << 18
MARGIN = 0.2  # learning asks for 1; small, as mixed and very short clean texts have little, too


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members.split()), lang)


@cache
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Hashed n-gram features of a text, of unit length; None if it has no letter."""
    counts = np.zeros(dimensions, np.float64)
    letters = _letter_table()
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    tail = np.array([32, 32], np.uint32)  # what stands before the text
    found = False
    for low in range(0, len(text), CHUNK):
        points = np.frombuffer(text[low : low + CHUNK].lower().encode("utf-32-le"), "<u4")
        is_letter = letters[points]
        found = found or bool(is_letter.any())
        points = np.concatenate([tail, np.where(is_letter, points, np.uint32(32))])
        stays = np.ones(len(points), bool)
        stays[2:] = (points[2:] != 32) | (points[1:-1] != 32)
        points = points[stays]
        if len(points) > 2:
            first, second, third = (points[2:] * np.uint32(0x9E3779B1), points[1:-1] * np.uint32(0x85EBCA77),
                                    points[:-2] * np.uint32(0xC2B2AE3D))
            for grams in (first, first + second + np.uint32(1), (first ^ second) + third + np.uint32(2)):
                counts += np.bincount((grams * np.uint32(0x27D4EB2F)) >> shift, minlength=dimensions)
        tail = points[-2:]
    if not found:
        return None
    roots = np.sqrt(counts)
    return (roots / np.linalg.norm(roots)).astype(np.float32)


def fitted(x: np.ndarray, positive: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss, both sides weighing the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    sign = np.where(positive, 1, -1).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, pace, rate = w.copy(), 1.0, 1 / (2 * 2 + penalty)  # rows have length sqrt(2)
    for _ in range(steps):
        missing = np.maximum(0, 1 - sign * (x @ ahead))
        step = ahead - rate * (penalty * ahead - 2 * x.T @ (share * sign * missing))
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = step + np.float32((pace - 1) / next_pace) * (step - w)
        w, pace = step, next_pace
    return w


def _margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One machine's value for every row; summed row by row, so that equal rows agree to the last bit in any batch."""
    return (x * w[:-1]).sum(axis=1, dtype=np.float64) + w[-1]


@dataclass(frozen=True)
class Model:
    """Families with their languages, one machine per family, one per pair of languages of a family."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray
    pair_weights: Mapping[tuple[int, int, int], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of every row of features."""
        margins = np.stack([_margins(x, w) for w in self.family_weights], axis=1)
        shares = np.exp(SLOPE * (margins - margins.max(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        names = np.empty(len(x), object)
        scores = shares[np.arange(len(x)), best].astype(np.float64)
        for f, members in enumerate(self.languages):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            won = np.zeros((len(rows), len(members)))
            votes = np.zeros_like(won)
            for i, j in combinations(range(len(members)), 2):
                share = 1 / (1 + np.exp(-SLOPE * _margins(x[rows], self.pair_weights[f, i, j])))
                won[:, i] += share
                won[:, j] += 1 - share
                votes[:, i] += share >= 0.5
                votes[:, j] += share < 0.5
            pick = (votes * len(members) + won).argmax(axis=1)
            names[rows] = np.array(members, object)[pick]
            if len(members) > 1:
                scores[rows] *= won[np.arange(len(rows)), pick] / (len(members) - 1)
        return names.tolist(), scores


def trained(x: np.ndarray, langs: Sequence[str]) -> Model | None:
    """The machines of a sample; None of an empty one."""
    if not len(x):
        return None
    langs = np.array(langs, object)
    of = {lang: family_of(lang) for lang in sorted(set(langs))}
    families = tuple(sorted(set(of.values())))
    languages = tuple(tuple(lang for lang in of if of[lang] == f) for f in families)
    in_family = np.array([of[lang] for lang in langs], object)
    if len(families) == 2:  # one machine, seen from both sides
        one = fitted(x, in_family == families[0])
        family_weights = np.stack([one, -one])
    elif len(families) > 2:
        family_weights = np.stack([fitted(x, in_family == f) for f in families])
    else:
        family_weights = np.zeros((1, x.shape[1] + 1), np.float32)
    pairs = {}
    for f, members in enumerate(languages):
        for i, j in combinations(range(len(members)), 2):
            rows = (langs == members[i]) | (langs == members[j])
            pairs[f, i, j] = fitted(x[rows], langs[rows] == members[i])
    return Model(families, languages, family_weights, pairs)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: a fifth by the CRC of its id, and those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of labelled documents that aren't held out, from at most ``per_language`` whole texts of each language."""
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), held_out(doc_id).alias("out")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.col("out")).drop("out")
    # copies of a text share its hash: only distinct ones are counted, cut and ranked
    texts = known.select("lang", F.xxhash64("text", F.lit(7)).alias("hash")).distinct()
    counts = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(2, min(per_language, MOST_SAMPLED // len(counts)))
    # a hash cut leaves about twice as many texts as are wanted, so that ranking never meets a whole language
    cut = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 2 * each / n + 20 / n) * (1 << 30)))])
    order = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30))
    sample = (
        known.withColumn("order", order).where(F.col("order") < F.get(F.array(cut[F.col("lang")]), F.lit(0)))
        .distinct()
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order", "text")))
        .where(F.col("rank") <= each).select("lang", "rank", "text")
    )
    schema = "lang string, rank int, features binary"

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = [gram_counts(t) for t in batch.column(2).to_pylist()]
            packed = pa.array([None if v is None else v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed], names=["lang", "rank", "features"])

    rows = sorted((r.lang, r["rank"], r.features) for r in sample.mapInArrow(featured, schema).collect() if r.features)
    if not rows:
        return None
    x = np.array([np.frombuffer(f, np.float32) for _, _, f in rows]).reshape(len(rows), -1)
    return trained(x, [name for name, _, _ in rows])


def identify(docs: DataFrame, model: Model | None, keep: Sequence[str] = ("doc_id",), text: str = "text",
             names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1), or as named by ``names_out``, of every document."""
    added = [T.StructField(names_out[0], T.StringType()), T.StructField(names_out[1], T.DoubleType())]
    schema = mapped_schema(docs, keep, added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights per pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = shared.value
        for batch in sliced(batches):
            features = [gram_counts(t) for t in batch.column(len(keep)).to_pylist()]
            known = [i for i, f in enumerate(features) if f is not None]
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if known and machines is not None:
                found, scores[known] = machines.predict(np.stack([features[i] for i in known]))
                for i, name in zip(known, found):
                    names[i] = name
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=schema.names)

    return docs.select(*keep, text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def least_scores(model: Model, margin: float = MARGIN) -> dict[str, float]:
    """Score of a text that every machine which speaks for a language puts ``margin`` on its side.

    At margin 0 it is the level of chance: one by the number of families, halved in a family of several languages.
    """
    others = len(model.families) - 1
    family = 1 / (1 + others * float(np.exp(-2 * SLOPE * margin)))
    pair = 1 / (1 + float(np.exp(-SLOPE * margin)))
    return {lang: family * (pair if len(members) > 1 else 1.0) for members in model.languages for lang in members}


def without_unknown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    margin: float = MARGIN) -> DataFrame:
    """``docs`` without the rejected ones: texts without a letter, and those that suit no learned language.

    A text suits the predicted language if its score reaches the one of a text at ``margin`` (:func:`least_scores`);
    foreign and random texts lie near margin 0, though single sentences may pass. With one learned language there is nothing to tell apart, and every
    text with a letter suits it. Where no labelled document is there to learn from, texts with a letter stay, too.
    """
    model = learn(docs, doc_id, text, lang)
    if model is None:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    found = identify(docs, model, docs.columns, text, ("__lang", "__score"))
    least = F.create_map(*[F.lit(x) for pair in least_scores(model, margin).items() for x in pair])
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least[F.col("__lang")])).select(*docs.columns)
