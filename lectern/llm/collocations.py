"""Collocations: phrases of a few words that stand together more often than their parts, by language.

Frequencies come from suffix subtrees of word sequences, built as ERA builds them: the prefixes of the suffixes are
partitioned first, then every group of prefixes is worked on by itself.

1. *Frequencies of prefixes.* One pass counts words by 64-bit hashes. A phrase is only as frequent as its rarest word, so
   words under ``least`` begin no subtree and end the suffixes before them. A bitmap of the frequent hashes (16 bits for each one, at most
   32 MB) tells the tasks; a clash lets a rare word through, which costs a few rows and changes no count.
2. *Vertical partitioning.* Prefixes are packed into groups of at most ``budget`` occurrences. A word that has more becomes
   the prefixes of two words that begin with it. Of these only pairs of two such words can be over the budget again; they
   become prefixes of three words, and so on down to the full depth. The budget is raised for a corpus of over 32768
   budgets, so that groups and over-large words stay that few.
3. *Subtrees.* A second pass cuts every suffix at its first rare word or at the depth, adds up equal ones in each window of
   text, and sends them to the task of their group. There they are sorted by a number made of their words' hashes, level by level (on
   disk, if need be); the runs of equal prefixes are the nodes of the subtree, and a node's frequency is the total of
   the leaves below it. Nodes over several groups or batches, or whose number is also another's, are added up afterwards.
4. *Scores.* Parts are looked up by joins. What is more frequent than the budget is looked up by broadcast (at most
   depth times 32768 rows), so no key of the shuffled joins has more than ``budget / least`` rows.

Tasks read text in windows of 4 MB, cut between pieces only, so very long texts take no more memory than short ones.

Defined results: null texts are empty; null languages are ``und``, together with that word itself; repeated rows count each time; texts without
words, and languages without candidates, give no rows; an empty table gives none. Other columns are not read. Equal
scores go by frequency, then by the phrase's bytes. Frequencies have to stay under 10^14.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.sizing import broadcast_within, staged, top_per_group

MAX_WORDS, LEAST, FIRST = 3, 10, 2000
COVERED = 50  # per cent of a phrase's occurrences inside a longer one that make it redundant
BUDGET = 1 << 20  # occurrences in a group
GROUPS = 1 << 15  # of them, about
SLOTS = 1 << 16
WINDOW = 1 << 22  # bytes
MAX_BITS = 1 << 28

# Of every byte: 0 in a word, 1 between words, 2 between pieces. All of the latter are ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2


# --- words of a window of text -------------------------------------------------

@dataclass
class Words:
    """Word occurrences in order of the text. A word is known by its place among the distinct (language, word) pairs."""

    langs: pa.Array  # of every distinct word
    names: pa.Array
    times: np.ndarray
    at: np.ndarray  # the distinct word of every occurrence
    goes_on: np.ndarray  # whether the next occurrence follows in the same piece

    def hashes(self) -> np.ndarray:
        seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in pc.unique(self.langs).to_pylist()}
        pairs = zip(self.names.to_pylist(), self.langs.to_pylist())
        return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in pairs), np.uint64, len(self.names))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _ends(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Windows of at least ``size`` bytes that end with a row or before a byte between pieces."""
    low = 0
    while low < len(data):
        high = min(low + size, len(data))
        row_end = int(offsets[np.searchsorted(offsets, high)])
        while high < row_end:
            breaks = np.flatnonzero(_CLASS[data[high : min(high + 65536, row_end)]] == 2)
            if len(breaks):
                high += int(breaks[0])
                break
            high = min(high + 65536, row_end)
        yield low, high
        low = high


def windows(texts: pa.Array, langs: pa.Array, size: int = WINDOW) -> Iterator[Words]:
    """Words of all texts, window by window; ASCII capitals are made small."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    coded = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    lang_names, lang_of_row = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    for low, high in _ends(data, offsets, size):
        found = _window(data[low:high], low, offsets, lang_names, lang_of_row)
        if found is not None:
            yield found
        del found
        pa.default_memory_pool().release_unused()


def _window(data: np.ndarray, low: int, offsets: np.ndarray, lang_names: pa.Array, lang_of_row: np.ndarray) -> Words | None:
    text = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    kind = _CLASS[text]
    inside = kind == 0
    first, last = np.searchsorted(offsets, [low, low + len(data)])
    begins = offsets[first:last] - low  # of rows
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[begins] = inside[begins]
    closes[:-1] &= ~inside[1:]
    before = begins[begins > 0] - 1
    closes[before] = inside[before]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(starts):
        return None
    breaks = kind == 2
    breaks[begins] = True
    piece = np.cumsum(breaks, dtype=np.int32)[starts]
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    names = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(text[inside])).dictionary_encode()
    # two languages may have a word in common
    if len(begins) and len(lang_names) > 1:
        firsts = np.searchsorted(starts, begins)  # of every row's words
        before = np.searchsorted(offsets, low, "right") - 1  # the row that the window begins in
        lang = np.repeat(lang_of_row[[before, *range(first, last)]], np.diff([0, *firsts, len(starts)]))
    else:
        lang = lang_of_row[np.searchsorted(offsets, starts[0] + low, "right") - 1]
    code = names.indices.to_numpy().astype(np.int64) * len(lang_names) + lang
    codes = pa.array(code).dictionary_encode()
    at, distinct = codes.indices.to_numpy().astype(np.int64), codes.dictionary.to_numpy()
    return Words(
        lang_names.take(pa.array(distinct % len(lang_names))), names.dictionary.take(pa.array(distinct // len(lang_names))),
        np.bincount(at, minlength=len(distinct)), at, np.append(piece[1:] == piece[:-1], False))


# --- which prefixes are frequent -----------------------------------------------

@dataclass(frozen=True)
class Frequent:
    """Bitmap of the frequent hashes, and the hashes of those over the budget."""

    bits: np.ndarray
    heavy: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes % np.uint64(8 * len(self.bits))
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def over(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes, self.heavy)


def _frequent(counted: DataFrame, budget: int) -> Frequent:
    """From the table (h, c) of frequent hashes; what comes to the driver has the size of the bitmap."""
    bits = 1 << 15
    while bits < min(16 * counted.count(), MAX_BITS):
        bits *= 2
    place = counted.select(F.expr(f"h & {bits - 1}").alias("place")).selectExpr("place + 1 as place")
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        whole[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    heavy = [r.h for r in counted.where(F.col("c") > budget).select("h").collect()]
    return Frequent(whole, np.array(heavy, np.int64).view(np.uint64))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(null, hash, count) of every distinct word of a window; (language, null, words in all)."""
    for batch in batches:
        for found in windows(batch.column(0), batch.column(1)):
            n = len(found.times)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.nulls(n, pa.string()), "h": pa.array(found.hashes().view(np.int64)), "c": pa.array(found.times)})
            coded = found.langs.dictionary_encode()
            total = np.bincount(coded.indices.to_numpy(), found.times, len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "lang": coded.dictionary, "h": pa.nulls(len(total), pa.int64()), "c": pa.array(total)})


# --- groups of prefixes and their subtrees -------------------------------------

@dataclass(frozen=True)
class Partitioning:
    """Which group a suffix goes to: by the slot of its first word, or, where that is over the budget, by a longer prefix."""

    words: Frequent
    group_of_slot: np.ndarray
    groups: int
    spread: int  # groups for longer prefixes, after the others


def _partitioning(counted: DataFrame, words: Frequent, budget: int) -> Partitioning:
    slot = F.expr(f"h & {SLOTS - 1}")
    light = F.col("c") <= budget
    loads = counted.groupBy(F.when(light, slot).alias("slot")).agg(F.sum("c").alias("c")).collect()
    load = np.zeros(SLOTS, np.int64)
    over = 0
    for r in loads:
        if r.slot is None:
            over = r.c
        else:
            load[r.slot] = r.c
    group, filled, group_of_slot = 0, 0, np.zeros(SLOTS, np.int32)
    for s in np.flatnonzero(load):
        if filled and filled + load[s] > budget:
            group, filled = group + 1, 0
        filled += load[s]
        group_of_slot[s] = group
    return Partitioning(words, group_of_slot, group + 1, -(-over // budget))


def _shifts(depth: int) -> list[int]:
    """Bits of the sort number below each level: the first word has 18 of 64, the others share the rest."""
    width = 46 // max(depth - 1, 1)
    return [width * (depth - 1 - d) for d in range(depth)]


def _distinct(at: np.ndarray, alive: list[np.ndarray], begin: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes, a row for each (word numbers from 1, 0 for none), and their counts."""
    parts = [at[begin] + 1] + [np.where(here, at[begin + d] + 1, 0) for d, here in enumerate(alive, 1)]
    if (words + 1) ** len(parts) < 1 << 63:
        path = parts[0]
        for part in parts[1:]:
            path = path * (words + 1) + part
        path = np.sort(path)
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1])) if len(path) else np.zeros(0, np.int64)
        count, path = np.diff(np.append(first, len(path))), path[first]
        rows = []
        for _ in parts:
            rows.append(path % (words + 1))
            path = path // (words + 1)
        return np.array(rows[::-1]), count
    rows, count = np.unique(np.array(parts), axis=1, return_counts=True)
    return rows, count


def _suffixes(found: Words, plan: Partitioning, depth: int) -> pa.RecordBatch:
    """The window's distinct suffixes, cut at the depth or at the first rare word, with their counts and groups.

    ``split`` tells how many words of the prefix belong to nodes that lie in several groups.
    """
    hashes = found.hashes()
    frequent = plan.words.holds(hashes)[found.at]
    begin = np.flatnonzero(frequent)
    follows = np.append(found.goes_on[:-1] & frequent[1:], np.zeros(depth, bool))
    at, alive, here = np.append(found.at, np.zeros(depth, np.int64)), [], np.ones(len(begin), bool)
    for d in range(1, depth):
        here = here & follows[begin + d - 1]
        alive.append(here)
    rows, count = _distinct(at, alive, begin, len(hashes))

    heavy = np.append(False, plan.words.over(hashes))
    hashes = np.append(np.uint64(0), hashes)
    first = hashes[rows[0]]
    group = plan.group_of_slot[first & np.uint64(SLOTS - 1)].astype(np.int64)
    shifts = _shifts(depth)
    number, prefix, above = (first >> np.uint64(46)) << np.uint64(46), first, 46
    open_here, split, route = heavy[rows[0]], np.zeros(len(count), np.int32), first
    for d in range(1, depth):
        prefix = np.where(rows[d] > 0, mixed(prefix, hashes[rows[d]]), np.uint64(0))
        width = above - shifts[d]
        number |= (prefix >> np.uint64(64 - width)) << np.uint64(shifts[d])
        above = shifts[d]
        split += open_here
        longer = open_here & (rows[d] > 0)
        route = np.where(longer, prefix, route)
        open_here = longer & heavy[rows[d]]  # the last level is never split
    if plan.spread:
        group = np.where(split > 0, plan.groups + (route % np.uint64(plan.spread)).astype(np.int64), group)
    words = [found.names.take(pa.array(rows[d] - 1, mask=rows[d] == 0)) for d in range(depth)]
    lang = found.langs.take(pa.array(rows[0] - 1)).cast(pa.large_string())
    path = pc.binary_join_element_wise(*words, lang, pa.scalar("\t", lang.type), null_handling="replace", null_replacement="")
    return pa.RecordBatch.from_pydict({
        "grp": pa.array(group, pa.int32()), "split": pa.array(split), "number": pa.array(number.view(np.int64)), "path": path,
        "c": pa.array(count)})


def _nodes(batches: Iterator[pa.RecordBatch], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the subtrees whose sorted leaves come in: (lang, size, phrase, f, whole).

    Nodes that go on in another batch or group, or that share their number with others, aren't whole; whole ones
    under ``least`` are left out.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        parts = pc.split_pattern(batch.column("path"), "\t", max_splits=depth)
        words, lang = [pc.list_element(parts, d) for d in range(depth)], pc.list_element(parts, depth)
        count, split = batch.column("c").to_numpy(), batch.column("split").to_numpy()
        number = batch.column("number").to_numpy().view(np.uint64)

        def changes(column: pa.Array) -> np.ndarray:
            return pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)

        new = changes(lang)
        for d, shift in enumerate(_shifts(depth)):
            new = new | changes(words[d])
            start = np.concatenate([[0], np.flatnonzero(new) + 1])
            level = number >> np.uint64(shift)
            alone = np.append(np.append(True, level[1:] != level[:-1])[start], False)
            total = np.add.reduceat(count, start)
            whole = alone[:-1] & alone[1:] & (split[start] <= d)
            whole[0] = False
            there = pc.not_equal(words[d].take(pa.array(start)), "").to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(there & (~whole | (total >= least)))
            row = pa.array(start[kept])
            phrase = words[0].take(row)
            for w in words[1 : d + 1]:
                phrase = pc.binary_join_element_wise(phrase, w.take(row), pa.scalar(" ", w.type))
            yield pa.RecordBatch.from_pydict({
                "lang": lang.take(row), "size": pa.array(np.full(len(kept), d + 1), pa.int32()),
                "phrase": phrase, "f": pa.array(total[kept]), "whole": pa.array(whole[kept])})


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, least: int = LEAST,
                  budget: int = BUDGET) -> tuple[DataFrame, DataFrame, int]:
    """((lang, size, phrase, f) of every phrase of up to ``max_words`` words with ``f >= least``, (lang, n), the budget in use)."""
    source = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    context = docs.sparkSession.sparkContext
    by_word = source.mapInArrow(_word_batches, "lang string, h bigint, c bigint")
    by_word = by_word.groupBy("lang", "h").agg(F.sum("c").alias("c"))
    by_word = staged(by_word.where(F.col("lang").isNotNull() | (F.col("c") >= least)), "words")
    sizes = by_word.where("lang is not null").select("lang", F.col("c").alias("n"))
    budget = max(budget, (sizes.agg(F.sum("n")).first()[0] or 0) // GROUPS)
    by_word = by_word.where("lang is null").select("h", "c")
    plan = _partitioning(by_word, _frequent(by_word, budget), budget)
    shared_plan = context.broadcast(plan)

    def suffix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in windows(batch.column(0), batch.column(1)):
                yield _suffixes(found, shared_plan.value, max_words)

    schema = "grp int, split int, number bigint, path string, c bigint"
    leaves = source.mapInArrow(suffix_batches, schema).repartitionById(plan.groups + plan.spread, "grp")
    leaves = leaves.sortWithinPartitions("number")
    nodes = staged(leaves.mapInArrow(
        lambda batches: _nodes(batches, max_words, least), "lang string, size int, phrase string, f bigint, whole boolean"),
        "nodes")
    parts = nodes.where("not whole").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    kept = ["lang", "size", "phrase", "f"]
    counts = nodes.where("whole").select(kept).unionByName(parts.where(F.col("f") >= least).select(kept))
    return counts, sizes, budget


# --- scores ----------------------------------------------------------------------

def _looked_up(cuts: DataFrame, counts: DataFrame, part: str, name: str, budget: int, rows: int) -> DataFrame:
    """``cuts`` with the frequency of their ``part``; the few most frequent parts are looked up by broadcast."""
    known = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    hot = broadcast_within(known.where(F.col(name) > budget), rows)
    return cuts.join(hot, ["lang", part]).unionByName(
        cuts.join(hot, ["lang", part], "left_anti").join(known.where(F.col(name) <= budget), ["lang", part]))


def _joined_words(words: str, low: str, number: str):
    return F.expr(f"array_join(slice({words}, {low}, {number}), ' ')")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, least: int = LEAST,
                 first: int = FIRST, covered: int = COVERED, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``first`` phrases of every language.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of the parts of its weakest cut, ``n`` the language's words, and ``score`` is
    ``floor(1000000 a a / (l r))``. Phrases that a longer one covers to ``covered`` per cent are left out.
    """
    counts, sizes, budget = phrase_counts(docs, lang, text, max_words, least, budget)
    candidates = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    # (begin, words) of every shorter phrase of at least two words inside
    inside = candidates.where("size > 2").select("lang", "f", "words", F.expr("explode(sequence(2, size - 1)) as m"), "size")
    inside = inside.select("lang", "f", "words", "m", F.expr("explode(sequence(1, size - m + 1)) as low"))
    longest = inside.groupBy("lang", _joined_words("words", "low", "m").alias("phrase")).agg(F.max("f").alias("longest"))
    kept = candidates.join(longest, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < covered * F.col("f")))
    cuts = staged(kept.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.expr("explode(sequence(1, size - 1)) as k")).select(
        "lang", "phrase", "a", "k", _joined_words("words", "1", "k").alias("first"), _joined_words("words", "k + 1", "size").alias("rest")),
        "cuts")
    hot = max_words * 2 * GROUPS
    scored = _looked_up(_looked_up(cuts, counts, "first", "l", budget, hot), counts, "rest", "r", budget, hot)
    wide = {c: f"cast({c} as decimal(14,0))" for c in "alr"}
    scored = scored.withColumn("score", F.expr(f"cast(1000000 as decimal(7,0)) * {wide['a']} * {wide['a']} div ({wide['l']} * {wide['r']})"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = top_per_group(
        weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), ["lang"],
        [F.desc("score"), F.desc("a"), F.asc("phrase")], first, rank="rank", spread_on=["phrase"])
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
