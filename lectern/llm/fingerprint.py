"""Document fingerprints by consistent weighted sampling.

A text's words (lower-cased, cut at white space) are its terms, as 64-bit hashes, and weigh as often as they
occur. For each of ``SAMPLES`` samples and each term, r and c from Gamma(2, 1) and b from [0, 1) are fixed; a term of weight w gets
t = floor(ln w / r + b) and the value ln c - r (t - b + 1), and the sample is the (term, t) of least value.
Two texts agree in a sample with the probability of their generalised Jaccard similarity, sum of
least weights over sum of greatest. The fingerprint keeps 16 bits of each sample.

r, b and c are computed from the term's hash and the sample's salts, so any number of terms have numbers of their own and all
tasks agree on them without a table. A worker keeps those of ``KEPT`` terms at hand.

Defined results: null text is empty; a text without words has the fingerprint of zeros, is like any other such text and
unlike all others. Equal texts have equal fingerprints, and very long ones are sampled whole, ``TERMS_AT_ONCE`` terms at a time. An
empty table gives an empty one. Ids are whole numbers; text ids are an error. All rows without an id are one range. Columns in
``keep`` are carried and must not clash; ``compared`` reads id and text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.frames import mapped_schema, sliced, text_or_empty

SAMPLES = 128
KEPT = 1 << 16
SEED = 5
TERMS_AT_ONCE = 2048


def _mixed(values: np.ndarray, rounds: int = 2) -> np.ndarray:
    """64 well mixed bits of each value, in place."""
    values ^= values >> np.uint64(32)
    for _ in range(rounds):
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
    return values


def _gamma(bits: np.ndarray) -> np.ndarray:
    """A value of Gamma(2, 1) from 46 of 64 bits: -ln of a product of two uniform numbers between 0 and 1, both excluded."""
    halves = (bits.view(np.uint32) >> np.uint32(9)).astype(np.float32)
    halves += np.float32(0.5)
    halves *= np.float32(2.0**-23)
    product = halves[..., 0::2] * halves[..., 1::2]
    np.log(product, out=product)
    return np.negative(product, out=product)


@cache
def _salts(samples: int, seed: int) -> np.ndarray:
    """Two odd numbers per sample: one to draw from, one to cut a sample to 16 bits."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, (2, samples), np.uint64) * np.uint64(2) + np.uint64(1)


def drawn(terms: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """ln c - r + r b, r, and b by (term, sample)."""
    one = _mixed(terms[:, None] ^ _salts(samples, seed)[0])
    r = _gamma(one)
    # the 18 bits that r leaves
    low = one.view(np.uint32) & np.uint32(511)
    b = ((low[:, 0::2] << np.uint32(9)) | low[:, 1::2]).astype(np.float32)
    b += np.float32(0.5)
    b *= np.float32(2.0**-18)
    c = _gamma(_mixed(one, 1))
    np.log(c, out=c)
    c -= r
    c += r * b
    return c, r, b


@cache
def _kept(samples: int, seed: int) -> tuple[np.ndarray, ...]:
    """Terms and their drawn numbers, at the place of the term's last bits; no term has the number of an empty place there."""
    numbers = (np.zeros((KEPT, samples), np.float32) for _ in range(3))
    return (np.where(np.arange(KEPT) == 0, 1, 0).astype(np.uint64), *numbers)


def _parameters(terms: np.ndarray, samples: int, seed: int, wanted: int = 3) -> tuple[np.ndarray, ...]:
    """The first ``wanted`` of ``drawn``, from those at hand where they are."""
    tags, *tables = _kept(samples, seed)
    places = (terms & np.uint64(KEPT - 1)).astype(np.int64)
    missing = np.flatnonzero(tags[places] != terms)
    out = tuple(table[places] for table in tables[:wanted])
    if len(missing):
        fresh = drawn(terms[missing], samples, seed)
        for one, new in zip(out, fresh):
            one[missing] = new
        # of terms of one place one stays, whole
        at, which = np.unique(places[missing], return_index=True)
        tags[at] = terms[missing[which]]
        for table, new in zip(tables, fresh):
            table[at] = new[which]
    return out


def weighted_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a text in ascending order, and their weights."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().encode().split()), np.uint64)
    return np.unique(hashes, return_counts=True)


def signature(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray | None:
    """16 bits per sample; None without terms."""
    if not len(terms):
        return None
    best = np.full(samples, np.inf, np.float32)
    term = np.zeros(samples, np.uint64)
    level = np.zeros(samples, np.int64)
    # a term of weight 1 has t = 0 and the fixed value, whatever r and b are
    once, more = weights == 1, weights > 1
    for which in (once, more):
        found = terms[which]
        logs = np.log(weights[which]).astype(np.float32)
        for low in range(0, len(found), TERMS_AT_ONCE):
            some = found[low : low + TERMS_AT_ONCE]
            values, *others = _parameters(some, samples, seed, 3 if which is more else 1)
            t = None
            if which is more:
                r, b = others
                t = np.floor(logs[low : low + TERMS_AT_ONCE, None] / r + b)
                values = values - r * t
            at = values.argmin(axis=0)
            columns = np.arange(samples)
            least = values[at, columns]
            # ties go to the smaller term, so that the order of reading never matters
            better = (least < best) | ((least == best) & (some[at] < term))
            best[better] = least[better]
            term[better] = some[at][better]
            level[better] = 0 if t is None else t[at, columns][better]
    mixed = (term * np.uint64(0x9E3779B97F4A7C15)) ^ (level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (_mixed(mixed * _salts(samples, seed)[1]) >> np.uint64(48)).astype(">u2")


def likeness(one: np.ndarray | None, two: np.ndarray | None) -> float:
    """Share of samples that agree, less what 16 bits agree by chance."""
    if one is None or two is None:
        return float(one is two)
    agree = float((one == two).mean())
    return max(0.0, (agree - 2.0**-16) / (1 - 2.0**-16))


def as_text(sign: np.ndarray | None, samples: int = SAMPLES) -> str:
    return "0" * (4 * samples) if sign is None else sign.tobytes().hex()


def of_text(text: str) -> np.ndarray | None:
    return signature(*weighted_terms(text))


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``fingerprint`` (hexadecimal, four digits per sample)."""
    schema = mapped_schema(docs, keep, [T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            signs = [as_text(of_text(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(signs, pa.string())], names=schema.names)

    return docs.select(*keep, text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the beginning of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = ("doc_id {id}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next document's, by descending id.

    After the last document comes the first. Equal ids follow each other by their texts' hashes and texts;
    null ids come last. Documents are dealt into ranges of ids, each a partition of its own, and sorted there, so a text moves
    once; the first document of each range also goes to the range before it. The driver sees only the bounds of the ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = sorted(set(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    bounds = [int(b) for b in bounds]
    # range 0 has the largest ids; null ids have one of their own at the end
    falling = bounds[::-1]

    def number(low: int, high: int) -> Column:
        """The place among ``falling[low:high]``, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("id") > falling[middle], number(low, middle)).otherwise(number(middle + 1, high))

    last = len(bounds) + 1
    placed = rows.withColumn("range", F.when(F.col("id").isNull(), F.lit(last)).otherwise(number(0, len(bounds))))
    order = F.struct((-F.coalesce("id", F.lit(0))).alias("id"), F.xxhash64("text").alias("mark"))
    heads = sorted((r.range, -r.head.id, r.head.mark) for r in placed.groupBy("range").agg(F.min(order).alias("head")).collect())
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = T.StructType.fromDDL(COMPARED.format(id=kind))
    if not heads:
        return spark.createDataFrame([], schema)

    def by_range(values: dict[int, int]) -> Column:
        return F.get(F.array(*[F.lit(values.get(r)).cast("bigint") for r in range(last + 1)]), F.col("range"))

    before = by_range({r: heads[i - 1][0] for i, (r, _, _) in enumerate(heads)}).cast("int")
    is_head = F.col("id").eqNullSafe(by_range({r: id_ for r, id_, _ in heads if r != last})) & (
        F.xxhash64("text") == by_range({r: mark for r, _, mark in heads}))
    twice = placed.withColumn("to", F.explode(F.when(
        is_head, F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("guest")),
                         F.struct(before.alias("at"), F.lit(1).alias("guest")))
    ).otherwise(F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("guest"))))))
    dealt = (
        twice.select(F.col("to.at").alias("at"), F.col("to.guest").alias("guest"), "id", "text")
        .repartitionById(last + 1, "at")
        .sortWithinPartitions("at", "guest", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in sliced(batches, 64):
            out: list[tuple] = []
            for at, guest, id_, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sign = of_text(body)
                if held is not None and held[0] == at:
                    out.append(_row(held, body, sign))
                held = None if guest else (at, id_, body, sign)
            if out:
                yield pa.RecordBatch.from_pylist(out, pa_schema)

    def _row(held: tuple, following: str, sign: np.ndarray | None) -> dict:
        _, id_, body, own = held
        changed = edited(body, following)
        other = own if changed == body else of_text(changed)
        return dict(zip(names, (
            id_, len(body), hashlib.sha256(changed.encode()).hexdigest(), as_text(own), as_text(other),
            likeness(own, other), likeness(own, sign))))

    names = schema.names
    text_type, real = pa.string(), pa.float64()
    pa_schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), text_type, text_type, text_type, real, real))))
    wide = T.StructType([T.StructField("doc_id", T.LongType()), *schema.fields[1:]])
    return dealt.mapInArrow(run, wide).withColumn("doc_id", F.col("doc_id").cast(kind))
