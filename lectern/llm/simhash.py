"""SimHash near-duplicates, with Pigeonring filtering of candidates.

A text's words are cut at ASCII white space and lower-cased (A-Z); its shingles of three words,
repeats included, are hashed with XXH64 (seed 42) and vote on each of 64 bits. Fingerprints that
differ in at most ``radius`` bits are linked; documents are grouped by the links' components.

Candidates: a fingerprint is cut into ``radius + 1`` segments on a ring. If two fingerprints differ
in at most ``radius`` bits, then from some segment on every chain of l consecutive segments differs in
at most l * radius / (radius + 1) bits; its first segment is equal. So fingerprints meet in buckets of
equal segments, and a pair goes on to the full Hamming check only if the chains from
that segment on stay within their budgets.

Crowded buckets (over ``crowd`` members) aren't paired. Their members are linked through
the codes one bit away instead: two fingerprints within 2 bits share such a code, and at most 65
fingerprints meet in one, so no link is lost and the work stays in proportion to the members.

Defined results: null text is empty; a text without words has fingerprint zero and links like any
other; equal texts share a component; null ids have a fingerprint and component but never name one,
unless all of its documents have none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import smallest_reachable
from lectern.llm.frames import joined, mapped_schema, sliced, text_or_empty
from lectern.plans.sizing import staged

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
CROWD = 32
BITS = 64
BLOCK = 1 << 14  # hashes whose bits are counted at once


def text_fingerprint(data: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text in UTF-8, unsigned."""
    words = data.lower().split()  # of bytes: A-Z, and the six ASCII white space characters
    if len(words) > shingle:
        grams = [b" ".join(g) for g in zip(*[words[i:] for i in range(shingle)])]
    else:
        grams = [b" ".join(words)] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
    votes = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[low : low + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and ``simhash`` (64 bits as a long)."""
    schema = mapped_schema(docs, keep, [T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = [text_fingerprint(x, shingle) for x in batch.column(len(keep)).to_pylist()]
            column = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], column], names=schema.names)

    return docs.select(*keep, text_or_empty(text).cast("binary").alias("__text")).mapInArrow(run, schema)


def segment_masks(radius: int = RADIUS) -> list[int]:
    """One mask per segment of the ring, as signed longs."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    masks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _chains_hold(segment: Column, difference: Column, radius: int) -> Column:
    """Whether all chains that begin at ``segment`` (equal there) keep to their share of the radius."""
    masks = segment_masks(radius)
    m = len(masks)
    held = F.lit(False)
    for first in range(m):
        here = segment == first
        together = masks[first]
        for length in range(2, m + 1):
            together |= masks[(first + length - 1) % m]
            here = here & (F.bit_count(difference.bitwiseAND(F.lit(together))) <= length * radius // m)
        held = held | here
    return held


def links(codes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (src, dst) whose components are those of all pairs of distinct ``simhash`` within ``radius`` bits (2 at most)."""
    if radius > 2:
        raise ValueError("crowded buckets are linked through codes one bit away, which covers 2 bits")
    parts = F.array(*[
        F.struct(F.lit(i).alias("segment"), F.col("simhash").bitwiseAND(F.lit(m)).alias("part"))
        for i, m in enumerate(segment_masks(radius))
    ])
    rows = staged(codes.select("simhash", F.inline(parts)), "segments")
    sizes = rows.groupBy("segment", "part").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(sizes, ["segment", "part"])
    few = sized.where(F.col("n") <= crowd).drop("n")
    other = few.withColumnRenamed("simhash", "other")
    difference = F.col("simhash").bitwiseXOR(F.col("other"))
    near = few.join(other, ["segment", "part"]).where(
        (F.col("simhash") > F.col("other")) & _chains_hold(F.col("segment"), difference, radius)
        & (F.bit_count(difference) <= radius))
    pairs = near.select(F.col("simhash").alias("src"), F.col("other").alias("dst"))

    flips = [F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(BITS)]
    around = F.explode(F.concat(F.array("simhash"), F.array(*[F.col("simhash").bitwiseXOR(f) for f in flips])))
    met = (
        sized.where(F.col("n") > crowd).select("simhash").distinct()
        .select("simhash", around.alias("code"))
        .groupBy("code").agg(F.collect_set("simhash").alias("near")).where(F.size("near") > 1)
    )
    starred = met.select(F.explode("near").alias("src"), F.array_min("near").alias("dst")).where("src <> dst")
    return pairs.union(starred).distinct()


def grouped(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(simhash, root, component_id) for every distinct ``simhash`` of ``prints``."""
    codes = staged(prints.groupBy("simhash").agg(F.min(doc_id).alias("first_id")), "codes")
    roots = staged(smallest_reachable(links(codes, radius, crowd)).withColumnRenamed("node", "simhash"), "roots")
    known = codes.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    named = joined(roots, codes, ["simhash"], "inner").groupBy("root").agg(F.min("first_id").alias("least_id"))
    return known.join(named, "root", "left").select(
        "simhash", "root", F.coalesce("least_id", "first_id").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, simhash, component_id) of every row of ``docs``."""
    prints = staged(fingerprints(docs, (doc_id,), text), "simhash")
    return prints.join(grouped(prints, doc_id, radius), "simhash").select(doc_id, "simhash", "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                            radius: int = RADIUS) -> DataFrame:
    """The row of smallest id of every group, with all its columns; of equal rows one stays."""
    marked = docs.withColumn("__mark", F.xxhash64(F.col(text)))
    prints = staged(fingerprints(marked, (doc_id, "__mark"), text), "simhash")
    members = prints.join(grouped(prints, doc_id, radius).select("simhash", "root"), "simhash")
    counted = members.groupBy("root", doc_id, "__mark").agg(F.count("*").alias("n"))
    order = F.struct(F.col(doc_id).isNull(), doc_id, "__mark", "n")
    stay = staged(counted.groupBy("root").agg(F.min(order).alias("s")).select(f"s.{doc_id}", "s.__mark", "s.n"), "stay")

    def kept(which: str) -> DataFrame:
        return joined(marked, stay.where(which).drop("n").hint("shuffle_hash"), [doc_id, "__mark"], "left_semi")

    out = kept("n = 1")
    if not stay.where("n > 1").isEmpty():
        out = out.union(kept("n > 1").dropDuplicates([doc_id, "__mark"]))
    return out.drop("__mark")
